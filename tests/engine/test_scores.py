"""Pair scores against plain loops, and pinned values."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from motifloom.functions import alphabet, scores
from motifloom.functions.alphabet import ALPHABET, half_away, residue_similarities, substitution
from motifloom.functions.scores import align, alignment_similarity, anchor_bound, anchor_similarity, assignment, terminal_similarity
from motifloom.operators import nodes
from motifloom.plans.config import Config

rng = random.Random(8)
PINNED = {"ALVQRVKRF": 1000, "GALVQRVKRF": 895, "ALVQRVKRFT": 907, "GALVQRVKRFT": 808, "ALVSSSKRF": 872, "VALQRVKRF": 825, "GLVQRVKRF": 847, "VALQRVFKR": 587}
ANCHORS = {"ALVQRVKRF": 1000, "GALVQRVKRF": 631, "ALVQRVKRFT": 686, "GALVQRVKRFT": 317, "ALVSSSKRF": 1000, "VALQRVKRF": 854, "GLVQRVKRF": 750, "VALQRVFKR": 596}
BOUNDS = {"GALVQRVKRF": 783, "ALVQRVKRFT": 787, "GALVQRVKRFT": 529, "VALQRVKRF": 887, "GLVQRVKRF": 750, "VALQRVFKR": 854}
TERMINAL = {"ALVQRVKRF": 1000, "GALVQRVKRF": 500, "ALVQRVKRFT": 500, "GALVQRVKRFT": 0, "ALVSSSKRF": 1000, "VALQRVKRF": 500, "GLVQRVKRF": 833, "VALQRVFKR": 0}


def codes(s):
    return np.array([[ALPHABET.index(c) for c in s]])


def family():
    base = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(8, 14)))
    out = [base]
    for _ in range(3):
        s = list(base)
        s[rng.randrange(len(s))] = rng.choice(ALPHABET)
        out.append("".join(s))
    return [*out, base + rng.choice(ALPHABET), base[1:] if len(base) > 8 else base]


def hyps(s):
    t = [ALPHABET.index(c) for c in s[:3] + s[-3:]]
    return [t[f] * 20 + t[b] for f, b in nodes.HYPOTHESES if len(s) - 3 + (b - 3) - f >= 6]


@pytest.fixture(scope="module")
def pairs(spark):
    seqs = sorted({*PINNED, *(s for _ in range(6) for s in family())})
    rows = [(a, b) for a in seqs for b in seqs]
    df = spark.createDataFrame(rows, "x string, y string")
    feature = lambda c: df.select(c).distinct().select(F.col(c).alias(f"_{c}"), nodes.terminal_codes(F.col(c)).alias(f"t{c}"), nodes.hypotheses(nodes.terminal_codes(F.col(c)), F.length(c)).alias(f"h{c}"))
    both = df.join(feature("x"), F.col("x") == F.col("_x")).join(feature("y"), F.col("y") == F.col("_y"))
    got = both.select("x", "y", "hx", terminal_similarity(F.col("tx"), F.col("ty")).alias("terminal"), anchor_bound(F.col("hx"), F.col("hy")).alias("bound"), anchor_similarity(F.col("hx"), F.col("hy")).alias("anchor"), alignment_similarity(F.col("x"), F.col("y")).alias("alignment"))
    return got.collect()


def test_pinned_values(pairs):
    got = {r.y: r for r in pairs if r.x == "ALVQRVKRF"}
    for s, v in PINNED.items():
        assert (got[s].alignment, got[s].anchor, got[s].terminal) == (v, ANCHORS[s], TERMINAL[s])
    assert {s: got[s].bound for s in BOUNDS} == BOUNDS
    assert {r.x: r.bound for r in pairs if r.y == "ALVQRVKRF"}["GALVQRVKRF"] == 750


def test_scores_match_plain_loops(pairs):
    table = residue_similarities()
    by = {(r.x, r.y): r for r in pairs}
    for r in pairs:
        assert list(r.hx) == hyps(r.x)
        assert r.bound >= r.anchor and by[r.y, r.x].alignment == r.alignment and by[r.y, r.x].anchor == r.anchor and by[r.y, r.x].terminal == r.terminal
        a, b = hyps(r.x), hyps(r.y)
        if len(a) > len(b):
            a, b = b, a
        dimer = lambda p, q: table[p // 20 * 20 + q // 20] + table[p % 20 * 20 + q % 20]
        if rng.random() < 0.02:
            best = max(sum(dimer(p, q) for p, q in zip(a, chosen, strict=True)) for chosen in itertools.permutations(b, len(a)))
            assert r.anchor == min(1000, max(0, best) // (2 * len(a)))
        end = lambda s, q, at: min(1000, max(0, sum(table[ALPHABET.index(s[at + k]) * 20 + ALPHABET.index(q[at + k])] for k in range(3))) // 3)
        assert r.terminal == (end(r.x, r.y, 0) + end(r.x, r.y, -3) + 1) // 2


def plain_alignment(a, b, gaps=(-4.0, -1.0, -2.0, -1.0), need=2):
    """The same recursion, one cell at a time."""
    m, n, scores = len(a), len(b), substitution()
    go, ge, to, te = (int(g * 2000) for g in gaps)
    w = lambda i, k: 4 if i < 3 or i >= k - 3 else 1
    best = {(0, 0, 0, 0, 0): 0}
    for i in range(m + 1):
        for j in range(n + 1):
            for state in range(3):
                for p in range(need + 1):
                    for q in range(need + 1):
                        now = best.get((i, j, p, q, state))
                        if now is None:
                            continue
                        moves = []
                        if i < m and j < n:
                            p2 = min(need, p + (i < 3 and j < 3))
                            q2 = min(need, q + (i >= m - 3 and j >= n - 3))
                            moves.append(((i + 1, j + 1, p2, q2, 0), (w(i, m) + w(j, n)) * scores[ALPHABET.index(a[i])][ALPHABET.index(b[j])] * 1000))
                        if i < m and state != 2:
                            edge = j in (0, n)
                            moves.append(((i + 1, j, p, q, 1), (te if edge else ge) if state == 1 else (to if edge else go)))
                        if j < n and state != 1:
                            edge = i in (0, m)
                            moves.append(((i, j + 1, p, q, 2), (te if edge else ge) if state == 2 else (to if edge else go)))
                        for key, gain in moves:
                            best[key] = max(best.get(key, -(10**15)), now + gain)
    raw = max(best.get((m, n, need, need, s), -1) for s in range(3))
    own = lambda s: sum(2 * w(i, len(s)) * scores[ALPHABET.index(c)][ALPHABET.index(c)] * 1000 for i, c in enumerate(s))
    return 0 if raw <= 0 else min(1000, half_away(raw / (own(a) * own(b)) ** 0.5 * 1000))


def test_alignment_matches_plain_recursion():
    for _ in range(25):
        a, b = rng.choice(family()), rng.choice(family())
        assert align(codes(a), codes(b))[0] == plain_alignment(a, b)
        assert align(codes(a), codes(b), (-3.0, -0.5, 0.0, 0.0), 3)[0] == plain_alignment(a, b, (-3.0, -0.5, 0.0, 0.0), 3)
    assert assignment(np.zeros((2, 0), int), np.zeros((2, 3), int)).tolist() == [0, 0]


def test_config_rules():
    assert Config().primary_q == 500 and Config().anchor_q == 600 and Config(threshold=0.7).primary_q == 700
    assert Config(mode="separate_kmer_anchor").primary_q == 600 and Config(mode="combined_kmer_anchor", threshold=0.55).primary_q == 550
    for wrong in ({"mode": "x"}, {"threshold": 2}, {"gaps": (1, 0, 0, 0)}, {"terminal_matches": 4}, {"motif_count": 3}, {"method": "greedy", "prefilter": "force"}, {"method": "greedy", "selection": "lazy_exact", "order": "intrinsic"}):
        with pytest.raises(ValueError):
            Config(**wrong)


def test_bounds_of_packed_codes_are_those_of_hypotheses(spark):
    from motifloom.functions.scores import packed, packed_bounds
    from motifloom.operators.ends import scored

    letters = random.Random(8)
    rows = [tuple("".join(letters.choice(ALPHABET) for _ in range(letters.choice((8, 8, 9, 12)))) for _ in range(2)) for _ in range(400)]
    df = spark.createDataFrame(rows, "a string, b string")
    t = {c: nodes.terminal_codes(F.col(c)) for c in "ab"}
    code = [packed(t[c], F.length(c) == 8) for c in "ab"]
    h = [nodes.hypotheses(t[c], F.length(c)) for c in "ab"]
    got = df.select(scored(packed_bounds, *code).alias("x"), anchor_bound(*h).alias("y")).collect()
    assert all(r.x == r.y for r in got) and len({r.x for r in got}) > 20 and len(packed_bounds(np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0


@pytest.mark.parametrize("gaps", [(-4.0, -1.0, -2.0, -1.0), (-0.3, -0.1, -0.25, -0.05), (0.0, 0.0, 0.0, 0.0)])
def test_quick_alignments_are_those_of_all_states(gaps):
    own = np.random.default_rng(3)
    for m, n in ((8, 8), (9, 12), (14, 8), (6, 7), (4, 9)):
        left, right = own.integers(0, 20, (60, m)), own.integers(0, 20, (60, n))
        k = min(m, n)
        right[:40, :k] = np.where(own.random((40, k)) < 0.7, left[:40, :k], right[:40, :k])
        for matches in range(4):
            want = scores.align(left, right, gaps, matches)
            assert (scores.quick_align(left, right, gaps, matches) == want).all() and (scores.quick_align(right, left, gaps, matches) == want).all()
            assert want.any() or abs(m - n) > 2


def test_alignments_of_mixed_lengths_keep_their_order():
    own = random.Random(12)
    word = lambda: "".join(own.choice(alphabet.ALPHABET) for _ in range(own.randint(8, 11)))
    left = [word() for _ in range(200)]
    right = [x if k % 3 else word() for k, x in enumerate(left)]
    codes = lambda s: np.array([[alphabet.ALPHABET.index(c) for c in s]])
    got = scores.alignments(pa.array(left), pa.array(right), (-4.0, -1.0, -2.0, -1.0), 2, most=7)
    assert got.tolist() == [int(scores.align(codes(x), codes(y))[0]) for x, y in zip(left, right, strict=True)]
    assert not len(scores.alignments(pa.array([], pa.string()), pa.array([], pa.string()), (-4.0, -1.0, -2.0, -1.0), 2))
