"""Near copies of the pipeline against all pairs at a shingle similarity of 0.8."""

import random
from itertools import combinations

import numpy as np
import pytest

from motifloom.llm import simhash


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def by_all_pairs(texts):
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(texts)), 2):
        if similarity(texts[i], texts[j]) >= 0.8:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(len(texts))}


def groups(spark, texts, **settings):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.component_id for r in simhash.near_groups(docs, **settings).collect()}


def words_of(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]


def scattered(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(words)), n):
        out[i] = words_of(rng, 1)[0]
    return out


def test_links_are_verified_at_the_threshold(spark):
    rng = random.Random(5)
    texts = []
    for k in range(60):  # similarities on both sides of 0.8
        words = words_of(rng, 300)
        texts += [" ".join(words), " ".join(scattered(rng, words, 4 + k % 12))]
    met = [similarity(*texts[i : i + 2]) for i in range(0, 120, 2)]
    assert sum(0.7 < s < 0.8 for s in met) > 10 and sum(0.8 <= s < 0.9 for s in met) > 10
    assert groups(spark, texts) == by_all_pairs(texts)


def test_appended_truncated_and_replaced_blocks_are_found(spark):
    rng = random.Random(6)
    texts = []
    for k in range(90):
        words = words_of(rng, rng.choice((200, 300, 1000)))
        n, part = len(words), int(len(words) * (0.18, 0.15, 0.07)[k % 3])
        at = rng.randrange(n - part)
        edited = (words + words_of(rng, part), words[: n - part], words[:at] + words_of(rng, part) + words[at + part :])[k % 3]
        texts += [" ".join(words), " ".join(edited)]
        assert 0.8 <= similarity(*texts[-2:]) < 0.9
    got = groups(spark, texts)
    assert all(got[2 * i + 1] == 2 * i for i in range(90))


@pytest.mark.parametrize("heads", [1, 20])
def test_every_pair_of_a_crowded_entry_is_decided(spark, heads):
    rng = random.Random(7)
    base = words_of(rng, 300)
    texts = [" ".join(scattered(rng, base, 12)) for _ in range(60)]  # far from each other by 0.8, the smallest ids too
    for k in range(20):
        texts.append(" ".join(scattered(rng, texts[5 + 2 * k].split(), 3)))
    want = by_all_pairs(texts)
    assert sum(i != r for i, r in want.items()) >= 20 and want[0] == 0 and len(set(want.values())) >= 40
    assert groups(spark, texts, heads=heads) == want


def test_parities_never_differ_in_more_bits_than_sets_in_hashes():
    rng = np.random.default_rng(8)
    for n in (0, 1, 40, 300, 3000):
        x = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        for apart in (0, 1, 7, n // 9, n):
            y = np.unique(np.concatenate((x[apart:], rng.integers(0, 1 << 64, apart, np.uint64))))
            turned = sum(((a ^ b) & (1 << 64) - 1).bit_count() for a, b in zip(simhash._parities(x), simhash._parities(y), strict=True))
            assert turned <= len(np.setxor1d(x, y))


@pytest.mark.parametrize("keys", [0, 64])
def test_a_crowded_entry_of_texts_that_differ_makes_few_pairs(spark, monkeypatch, keys):
    monkeypatch.setattr(simhash, "KEYS", keys)
    rng, seen, old = random.Random(9), [], simhash._similar
    common = words_of(rng, 30)
    texts = [" ".join(common + words_of(rng, 14)) for _ in range(120)]  # all list shingles of the common passage; about half of each is shared
    texts += [" ".join(scattered(rng, texts[3 * k].split(), 1)) for k in range(6)]

    def similar(pairs, *rest):
        seen.append(pairs.count())
        return old(pairs, *rest)

    monkeypatch.setattr(simhash, "_similar", similar)
    assert groups(spark, texts, heads=2) == by_all_pairs(texts)
    assert sum(seen) < 1000


def test_what_an_explode_makes_many_times_larger_is_not_broadcast(spark, monkeypatch):
    plans, store = [], simhash.written
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(simhash, "written", lambda df, name: plans.append(plan(df)) or store(df, name))
    found = simhash.links(spark.createDataFrame([(v << 8,) for v in range(20)], "fp long"), bucket=4)
    plans.append(plan(found))
    hashed = [line for text in plans for line in text.splitlines() if "HashJoin" in line and ("pval" in line or "mid" in line)]
    assert len(plans) == 2 and all("SortMergeJoin" in text for text in plans) and not hashed
