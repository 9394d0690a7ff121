"""The pipeline against a plain run of its stages, and its stages' contracts."""

import zlib
from collections import defaultdict
from itertools import combinations

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from motifloom.llm import quality, queries, simhash, suffixes, toxicity
from motifloom.llm.tokens import WordTokenizer

DATA = "/root/testdata/sf0.001"


def plain_near_copies(texts):
    """The documents that stay: the smallest id of each component of all pairs at a Jaccard similarity of 0.8 of five-word shingles."""
    sets = {d: set(simhash._shingles(t, 5)) for d, t in texts.items()}
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in combinations(sorted(texts), 2):
        if 9 * len(sets[x] & sets[y]) >= 4 * (len(sets[x]) + len(sets[y])):
            a, b = find(x), find(y)
            root[max(a, b)] = min(a, b)
    return {d for d in texts if find(d) == d}


def plain_cut(data):
    """The texts without repeated runs of 51 words, and strings of 400 bytes with under 46 words inside."""
    bounds = {d: suffixes.word_bounds(t) for d, t in data.items()}
    runs, strings = defaultdict(int), defaultdict(int)
    for d, t in data.items():
        words = t.split()
        for i in range(len(words) - 50):
            runs[tuple(words[i : i + 51])] += 1
        for i in range(len(t) - 399):
            strings[t[i : i + 400]] += 1
    out = {}
    for d, t in data.items():
        flags, words, (starts, ends) = np.ones(len(t), bool), t.split(), bounds[d]
        for i in range(len(words) - 50):
            if runs[tuple(words[i : i + 51])] > 1:
                flags[starts[i] : ends[i + 50]] = False
        for i in range(len(t) - 399):
            if strings[t[i : i + 400]] > 1 and np.searchsorted(ends, i + 399, "right") - np.searchsorted(starts, i + 1) < 46:
                flags[i : i + 400] = False
        out[d] = bytes(np.frombuffer(t, np.uint8)[flags]).decode("utf-8", "ignore")
    return out


def test_run_matches_a_plain_run(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    # quality: both models by plain counts, the noise of each id as the query draws it
    model = quality.fit(docs, labels)
    n = len(model.ratio)
    count = lambda ids: sum((np.bincount(quality.buckets(texts[d], n), minlength=n) for d in ids), np.zeros(n, np.int64))
    raw, target = count(texts), count(good)
    share = lambda c: (c + 1.0) / (c.sum() + n)
    assert np.allclose(model.ratio, np.log(share(target) / share(raw)))
    weight = {d: float(model.ratio[quality.buckets(t, n)].sum()) for d, t in texts.items()}
    noise = {r.doc_id: r.g for r in docs.select("doc_id", quality.gumbel_key(F.lit(0.0), F.col("doc_id"), 0.1, 3).alias("g")).collect()}
    order = sorted(texts, key=lambda d: -(weight[d] / 0.1 + noise[d]))
    kept = set(order[: sum(w > model.threshold for w in weight.values())])
    stage = corpus_pipeline.keep_quality(spark, docs, DATA)
    assert {r.doc_id for r in stage.collect()} == kept and stage.columns == docs.columns
    # toxicity
    first = docs.where(F.col("doc_id").isin(list(kept)))
    matcher = toxicity.Matcher(toxicity.fit(first, labels))
    kept = {d for d in kept if matcher.score(texts[d]) < 0.3}
    # near copies
    kept = plain_near_copies({d: texts[d] for d in kept})
    # repeated passages
    cut = plain_cut({d: texts[d].encode() for d in kept})
    # packing: every id once, sequences within bounds
    tokenizer = WordTokenizer(queries.vocabulary(queries.WORDS))._t
    want = {}
    for d, t in cut.items():
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        for s in range(0, len(ids), 4096):
            part = ids[s : s + 4096]
            want[d, s] = (len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids))
    got = corpus_pipeline.run(spark, DATA).collect()
    assert {(r.doc_id, r.start): (r.length, r.ids_crc32, r.doc_tokens) for r in got} == want and len(got) == len(want)
    used = defaultdict(list)
    for r in got:
        used[r.sequence_id].append((r.offset, r.length))
    for own in used.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096


def test_stages_take_odd_rows(spark):
    rows = [(0, None, "en", "a", None, "x"), (1, "", None, "a", 0, "x"), (None, "word " * 30, "en", None, 150, "x"), (2, "word " * 30, "en", "b", 150, "x"), (2, "word " * 30, "en", "b", 150, "x"), (3, "é" * 3000, "fr", "b", 3000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    for one in (docs, docs.limit(0)):
        stage = one
        for _, f in corpus_pipeline.STAGES[:-1]:
            stage = f(spark, stage, DATA)
            assert stage.columns == docs.columns
        stage = corpus_pipeline.STAGES[-1][1](spark, stage, DATA)
        assert (stage.count() > 0) == (one is docs)
