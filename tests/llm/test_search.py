"""Ranked search against plain loops, by several blocks of items, and over odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np

from motifloom.llm import search

rng = random.Random(11)


def plain(docs, items, most=10):
    """Every formula of the contract, term by term; docs are (doc_id, text), items (item_id, text)."""
    cut = lambda t: re.findall(search.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    seen = [(i, Counter(cut(t))) for i, t in docs]
    some, total = sum(1 for _, c in seen if c), sum(sum(c.values()) for _, c in seen)
    df = Counter(t for _, c in seen for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(cut(t))
    out = []
    for item, terms in wanted.items():
        scored = []
        for i, c in seen:
            n = sum(c.values())
            m = 10 + (90 * n * some) // total if total else 10
            s = sum(math.floor(1000 * math.log((2 * some + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, k, x[3], -x[0]) for k, x in enumerate(sorted(scored, key=lambda x: x[:3])[:most], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


WORDS = ["alpha", "Beta", "gamma9", "délta", "x", "ÉTÉ", "été", "日本語", "ſ", "K", "k", "new york", "a\x00b", "tab\tbed", "`tick", "{b}", "non\xa0break", "~"]
TEXTS = [None, "", " ", "...", "alpha", "Alpha alpha ALPHA", "\U0001f600 alpha", "alphabet", "x" * 70_000, "x " * 40_000]
TEXTS += [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 60))) for _ in range(80)]
TEXTS += ["same text of copies, alpha"] * 15
DOCS = [(None if i % 31 == 5 else i * 7 % 101, t) for i, t in enumerate(TEXTS)]
ITEMS = [(1, "alpha beta"), (2, "ALPHA"), (3, None), (4, ""), (5, "?!"), (6, "unseen"), (None, "x gamma9"), (7, "été ÉTÉ K"), (8, "日本語 délta \xa0"), (2, "bed tick"), (9, "same copies same"), (10, "x" * 70_000)]


def frames(spark, docs=DOCS, items=ITEMS):
    d = spark.createDataFrame([(t, i, 1, 2.0) for i, t in docs], "text string, doc_id long, item_id long, score double")
    return d.repartition(3), spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, rank int")


def test_search_matches_plain_loops(spark):
    assert rows(search.search(*frames(spark))) == plain(DOCS, ITEMS)
    assert rows(search.search(*frames(spark), most=2)) == plain(DOCS, ITEMS, 2)


def test_blocks_of_items_do_not_matter(spark):
    docs, items = frames(spark)
    assert rows(search.search(docs, items, most_pairs=4, most_items=3)) == plain(DOCS, ITEMS)
    pairs = spark.createDataFrame([(i, f"t{k}") for i in range(200) for k in range(1 + i % 7)], "item_id long, term string")
    got = list(search.blocks(pairs, 60, 25))
    assert sorted(x for b in got for x in b) == sorted((r.item_id, r.term) for r in pairs.collect())
    assert max(len({i for i, _ in b}) for b in got) <= 25 and len({i for b in got for i in {i for i, _ in b}}) == sum(len({i for i, _ in b}) for b in got)


def test_empty_tables(spark):
    docs, items = frames(spark)
    assert rows(search.search(docs.where("false"), items)) == [] == rows(search.search(docs, items.where("false")))
    assert rows(search.search(docs.where("text is null"), items)) == []


def test_best_keeps_ties_by_id():
    found = search._Best(2, 3)
    for ids in ([5, 4], [3, None], [9, 1], [2, 8]):
        found.add(ids, np.array([[7, 0], [7, 1]], np.int64))
        found.settle()
    got = found.settle()
    assert [(i, -s, d, none) for i, s, none, d in got.tolist()] == [(0, 7, 1, 0), (0, 7, 2, 0), (0, 7, 3, 0), (1, 1, 1, 0), (1, 1, 4, 0), (1, 1, 8, 0)]
