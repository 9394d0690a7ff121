"""Pairs and histograms by ends against all pairs one by one."""

import random
import re
from collections import Counter

import pytest

from motifloom.functions.alphabet import ALPHABET, residue_similarities
from motifloom.operators import candidates, edges, ends, exhaustive, nodes
from motifloom.plans import queries
from motifloom.plans.config import Config
from tests.engine.test_clusters import all_pairs

rng = random.Random(9)
SEQUENCES = sorted({"".join(rng.choice("ALVIKFGDEW") for _ in range(rng.randint(8, 11))) for _ in range(90)} | {"ALV" + "G" * k + "KFW" for k in range(2, 6)})


def end(a, b):
    table = residue_similarities()
    total = sum(table[ALPHABET.index(x) * 20 + ALPHABET.index(y)] for x, y in zip(a, b, strict=True))
    return min(1000, max(0, total) // 3)


@pytest.mark.parametrize("config", [
    Config(mode="separate_kmer_anchor", kmer_threshold=0.35, anchor_threshold=0.25), Config(mode="separate_kmer_anchor", kmer_threshold=0.7, anchor_threshold=0.0),
    Config(mode="combined_kmer_anchor", threshold=0.6), Config(mode="combined_full_anchor", threshold=0.55), Config(mode="separate_aln_anchor", alignment_threshold=0.4, anchor_threshold=0.3),
])
def test_all_edges_are_those_of_all_pairs(spark, config):
    known = nodes.features(nodes.load(spark.createDataFrame([(s,) for s in SEQUENCES], "sequence string")))
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    want = rows(edges.edges(all_pairs(known), known, config))
    assert want and rows(exhaustive.all_edges(known, config)) == want
    pairs = exhaustive.possible_pairs(known, config)
    assert pairs.count() == pairs.distinct().count() < len(SEQUENCES) * (len(SEQUENCES) - 1) / 2
    assert exhaustive.possible_pairs(known.where("false"), config).count() == 0


@pytest.mark.parametrize(("seed", "at"), [("contiguous", 0.7), ("all_column_pairs", 0.4), ("all_column_pairs", 0.0), ("contiguous", 1.0)])
def test_candidates_are_the_distinct_hits(spark, seed, at):
    known = nodes.features(nodes.load(spark.createDataFrame([(s,) for s in SEQUENCES], "sequence string")))
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(candidates.candidates(known, seed, at)) == rows(candidates.hits(known, seed, at).distinct())


def test_histogram_counts_all_training_rows(spark):
    test, train = SEQUENCES[:30] + SEQUENCES[:3], SEQUENCES[20:] + SEQUENCES[50:60] * 4
    frame = lambda rows: spark.createDataFrame([(s, "x") for s in rows], "sequence string, front string")
    got = {(r.sequence, r.similarity): r.n for r in ends.similarity_histogram(frame(test), frame(train)).collect()}
    want = Counter((a, (end(a[:3], b[:3]) + end(a[-3:], b[-3:]) + 1) // 2) for a in set(test) for b in train)
    assert got == dict(want)
    assert ends.similarity_histogram(frame(test).where("false"), frame(train)).count() == 0 == ends.similarity_histogram(frame(test), frame(train).where("false")).count()


def test_no_plan_joins_all_with_all(spark):
    d = "/root/testdata/sf0.001"
    for f in (queries.test_train_similarity, queries.search_metrics):
        plan = f(spark, d)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan) or f is queries.search_metrics  # its totals are one row each
