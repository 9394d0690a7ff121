"""Each operator against a brute-force version, an exact round trip or held-out labels, and over odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from motifloom.llm import ann, graph, merkle, packing, pieces, quality, queries, records, simhash, suffixes, toxicity, warc
from motifloom.llm.common import id_blocks, scratch_path
from motifloom.llm.tokens import WordTokenizer

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, score double, fingerprint string, k long, Text2 string"
rng = random.Random(4)


def docs_of(spark, texts, ids=None):
    """A documents table with further columns whose names operators use themselves."""
    rows = [(i, t, 0.5, "x", 1, "y") for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, DOCS)


def some_texts():
    words = ["alpha", "beta", "Gamma", "delta", "épsilon", "zeta", "eta,", "theta.", "iota\n", "kappa"]
    passage = " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(90))
    texts = [None, "", " ", "one", "two words", "two words", "TWO  words", "a b c", "é" * 700, "ab" * 900, passage, passage, passage[:399]]
    texts += [f"start {i} " + passage[:450] + f" middle {i} " + " ".join(rng.choice(words) + str(rng.randint(0, 9999)) for _ in range(60)) for i in range(6)]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(25)]
    texts += ["line of text that repeats\n" * 60, "x" * 60_000, passage + " tail", "id <|endoftext|> mark", "日本 text ☃ \U0001f600"]
    return texts


TEXTS = some_texts()


@pytest.fixture(scope="module")
def docs(spark):
    return docs_of(spark, TEXTS).repartition(3)


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def pairs_of(df):
    return {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}


# components and blocks


def test_components_match_union_find(spark):
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7), (500, 500)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame([*links, (None, 3)], "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_blocks_ascend_with_ids(spark):
    ids = [*range(0, 5000), *range(10**12, 10**12 + 50), -5, None]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    got = sorted((r.doc_id, r.b) for r in df.withColumn("b", id_blocks(df, "doc_id", 100)).collect() if r.doc_id is not None)
    assert [b for _, b in got] == sorted(b for _, b in got) and max(Counter(b for _, b in got).values()) <= 200
    far = spark.createDataFrame([(i,) for i in [*range(5000), 10**15]], "doc_id long")
    blocks = far.groupBy(id_blocks(far, "doc_id", 100).alias("b")).count().collect()
    assert max(r["count"] for r in blocks) <= 200 and sum(r["count"] for r in blocks) == 5001
    many = spark.range(30_000).withColumnRenamed("id", "doc_id")  # more ranges than the first pass has quantiles
    sizes = [r["count"] for r in many.groupBy(id_blocks(many, "doc_id", 20)).count().collect()]
    assert len(sizes) > 1200 and max(sizes) <= 40
    assert {r.b for r in far.limit(0).select(id_blocks(far.limit(0), "doc_id").alias("b")).collect()} == set()


# 1 toxicity


def test_fold_and_exceptions():
    assert toxicity.fold("1D10T ѕсum pa​thetic 2024!") == "idiot scum pathetic 2024!"
    m = toxicity.Matcher(toxicity.Lexicon({"trash": 5.0, "idiot": 5.0, "vequ": 4.0}))
    assert m.raw("the trash can") == 0 and m.raw("you trash") > 0 and m.raw("an 1di0t") > 0 and m.raw("vequais la") > 0
    assert m.raw("trash cans, a TRASH CAN") == 0 and m.raw("you trash cannot read") > 0 and m.raw("trash canister") > 0
    assert m.raw("unidiot") == 0 and m.raw("") == 0 and m.raw(None) == 0
    assert m.raw("idiot " + "word " * 500) < m.raw("idiot word")


def test_matcher_matches_a_plain_search():
    terms = {w: rng.random() for w in ("ab", "abc", "bca", "cab", "éa", "trash", "scum")}
    m = toxicity.Matcher(toxicity.Lexicon(terms, exceptions=("trash can", "ab ca")))
    for _ in range(2000):
        text = " ".join(rng.choice(["ab", "abc", "Cabs", "bcab", "x", "trash", "can", "cans", "cannot", "scum", "4bc", "ca", "а", "-ab", "ab,"]) for _ in range(rng.randint(0, 12)))
        folded, total = toxicity.fold(text), 0.0
        spans = [(i, i + len(p)) for p in ("trash can", "ab ca") for i in range(len(folded)) if re.match(rf"{p}s?(?![^\W\d_])", folded[i:]) and not folded[i - 1 : i].isalpha()]
        for i in range(len(folded)):
            if folded[i - 1 : i].isalpha():
                continue
            met = [(w, len(t)) for t, w in ((toxicity.fold(t), w) for t, w in terms.items()) if folded.startswith(t, i)]
            if met and not any(a <= i and i + max(met)[1] <= b for a, b in spans):
                total += max(met)[0]
        assert abs(m.raw(text) - total / max(1, folded.count(" ") + 1) ** 0.25) < 1e-9


def test_excused_terms_are_found_in_one_sweep():
    import time

    lexicon = toxicity.Lexicon({"trash": 1.0, "bin": 0.5}, ("trash can", "the trash can lid"))
    matcher = toxicity.Matcher(lexicon)
    for text in ("trash can trash", "the trash can lid bin trash", "trash cans trash can", "trash", "can trash"):
        free = [(m.start(), m.end()) for e in lexicon.exceptions for m in re.finditer(rf"\b{e}s?\b", text)]
        want = sum(w for t, w in lexicon.terms.items() for m in re.finditer(rf"\b{t}", text) if not any(a <= m.start() and m.end() <= b for a, b in free))
        assert matcher.raw(text) == pytest.approx(want / len(text.split()) ** 0.25), text
    began = time.perf_counter()
    matcher.raw("trash can " * 60_000 + "trash " * 60_000)
    assert time.perf_counter() - began < 5


def test_toxicity_held_out(spark, given):
    labels = spark.read.parquet(f"{DATA.replace('0.001', '0.1')}/labels.parquet")
    big = spark.read.parquet(f"{DATA.replace('0.001', '0.1')}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    found = toxicity.score(big, toxicity.fit(big, labels)).where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    wrong = sum(r.predicted != r.toxic for r in found)
    assert len(found) > 500 and wrong / len(found) < 0.01


def test_toxicity_odd_rows(spark, docs):
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None), (3, 7)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    empty = docs.limit(0)
    assert toxicity.score(empty, toxicity.fit(empty, labels.limit(0))).count() == 0
    assert {r.doc_id for r in got if r.held_out} == {i for i in range(len(TEXTS)) if zlib.crc32(str(i).encode()) % 4 == 2}


# 2 SimHash


def brute_print(text):
    import re

    from xxhash import xxh64_intdigest

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    counts = [0] * 64
    for s in shingles:
        h = xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(shingles))


def test_simhash_matches_brute_force(spark, docs, given):
    for df in (docs, given):
        texts = pairs_of(df)
        prints = {d: brute_print(t) for d, t in texts.items()}
        root = {d: d for d in prints}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a in prints:
            for b in prints:
                if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
        got = {r.doc_id: (r.fingerprint % (1 << 64), r.component_id) for r in simhash.duplicate_components(df).collect()}
        assert got == {d: (p, find(d)) for d, p in prints.items()}
    assert simhash.duplicate_components(docs.limit(0)).count() == 0


def test_links_join_what_all_pairs_join(spark):
    base = rng.getrandbits(63)
    values = {base ^ (1 << rng.randint(0, 30)) ^ (1 << rng.randint(0, 62)) for _ in range(150)} | {rng.getrandbits(63) for _ in range(100)}
    values |= {base ^ (0b111 << 40), base ^ (0b11 << 50), 0, 1 << 31, (1 << 31) | 1}
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    want = graph.components(spark.createDataFrame([(a, b) for a in values for b in values if a <= b and (a ^ b).bit_count() <= 2], "a long, b long"))
    want = {r.node: r.root for r in want.collect()}
    for bucket in (4, 64, 10_000):
        got = {r.node: r.root for r in graph.components(simhash.links(df, bucket=bucket)).collect()}
        assert {v: got.get(v, v) for v in values} == want


def test_near_groups_find_lightly_edited_copies(spark):
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    texts = []
    for _ in range(40):
        words = [word() for _ in range(200)]
        texts.append(" ".join(words))
        words[rng.randint(50, 150)] = word()
        texts.append(" ".join(words))
    texts += [" ".join(word() for _ in range(100)) for _ in range(60)]
    got = {r.doc_id: r.component_id for r in simhash.near_groups(docs_of(spark, texts)).collect()}
    assert all(got[2 * i + 1] == 2 * i for i in range(40)) and all(got[i] == i for i in range(80, 140))
    kept = simhash.drop_near_copies(docs_of(spark, [*texts, None], [*range(140), None]))
    assert kept.count() == 101 and kept.columns == docs_of(spark, []).columns


# 3 WARC


def test_warc_round_trip(spark):
    html = [None, "", "", "<p>é</p>", "<p>é</p>", "a\r\nWARC/1.1\r\n\r\nb", "x" * 50_000, "<p>é</p>"]
    ids = [9, 4, 5, 3, 2, 1, 7, 8]
    pages = spark.createDataFrame([(i, f"http://x/{i}\r\n", h, "z") for i, h in zip(ids, html, strict=True)], "page_id long, url string, html string, payload string")
    for least in (0, 4):
        archive = warc.write(pages, scratch_path(spark, "warc-test"), least_bytes=least)
        got = {r.page_id: r for r in warc.summary(spark, archive).collect()}
        first = {}
        for i, h in sorted(zip(ids, html, strict=True)):
            body = (h or "").encode()
            head = first.setdefault(body, i)
            revisit = head != i and len(body) >= least
            import base64

            digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
            assert tuple(got[i])[1:] == (len(body), digest, "revisit" if revisit else "response", head if revisit else None)
        bodies = {r.record_id: bytes(r.payload) for r in warc.pages(spark, archive).collect()}
        assert bodies == {i: (h or "").encode() for i, h in zip(ids, html, strict=True)}
        for r in warc.records(spark, archive).collect():
            head, body = bytes(r.record).split(b"\r\n\r\n", 1)
            want = bodies[r.record_id] if b"WARC-Type: response" in head else b""
            assert body == want + b"\r\n\r\n" and f"Content-Length: {len(want)}".encode() in head
        assert spark.read.parquet(archive.payloads).count() == len(first)
    empty = warc.write(pages.limit(0), scratch_path(spark, "warc-test"))
    assert warc.summary(spark, empty).count() == 0


# 4 Merkle


def like(a, b):
    """Likeness of two fingerprints: the share of pieces that both have."""
    if a == b:
        return 1.0
    x, y = ({s[i : i + 8] for i in range(0, len(s), 8)} for s in (a.split(":")[3], b.split(":")[3]))
    return min(len(x & y) / len(x | y), 0.999999) if x | y else 0.0


def test_half_edited_matches_brute_force(spark, docs, given):
    for df in (docs, given):
        texts = pairs_of(df)
        order = sorted(texts, reverse=True)
        got = {r.doc_id: r for r in merkle.half_edited(df).collect()}
        assert len(got) == len(texts)
        by_text = defaultdict(set)
        for i, d in enumerate(order):
            t, following = texts[d], texts[order[(i + 1) % len(order)]]
            half = len(t) // 2
            edited = t[: len(t) - half] + following[:half]
            r = got[d]
            assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
            assert (r.near_edited == 1) == (edited == t) == (r.fingerprint == r.edited_fingerprint)
            assert (r.near_next == 1) == (following == t) and 0 <= r.near_next <= 1
            assert r.near_edited == like(r.fingerprint, r.edited_fingerprint) and r.near_next == like(r.fingerprint, got[order[(i + 1) % len(order)]].fingerprint)
            by_text[t].add(r.fingerprint)
        assert all(len(x) == 1 for x in by_text.values()) and len({*map(frozenset, by_text.values())}) == len(by_text)
    assert merkle.half_edited(docs.limit(0)).count() == 0
    assert merkle.half_edited(docs_of(spark, ["abcdef"])).first().edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()


def test_edits_are_located(spark):
    lines = [f"line {i}. {rng.random()}" for i in range(60)]
    edits = [lines, [*lines[:7], "new.", *lines[8:]], [*lines[:50], *lines[52:]], [*lines[:5], "more", *lines[5:]], [*lines[20:], *lines[:20]], ["x", *lines[1:59], "y"], [], [*lines[:9], *lines[9:10] * 3, *lines[10:]]]
    want = [[], [7], [50, 51], [], None, list(range(60)), list(range(60)), []]
    ids = range(len(edits))
    left, right = docs_of(spark, ["\n".join(lines)] * len(edits), ids), docs_of(spark, ["\n".join(e) for e in edits], ids)
    got = {r.doc_id: r for r in merkle.compare(left, right).collect()}
    for i, w in enumerate(want):
        assert w is None or got[i].edited == w
        assert (got[i].likeness == 1) == (i == 0)
    assert got[4].edited and got[4].likeness > 0.99
    twice = left.unionByName(left.withColumn("text", F.lit("z")))
    assert merkle.compare(twice, left).count() == len(edits)


def test_next_over_many_ranges(spark):
    ids = rng.sample(range(10**6), 700)
    df = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string")
    got = {r.doc_id: r.next.doc_id for r in merkle.beside_next(df, "text", per_range=20).collect()}
    order = sorted(ids, reverse=True)
    assert got == {d: order[(i + 1) % len(order)] for i, d in enumerate(order)}


# 5 records


def test_records_round_trip(spark, docs, given):
    path = queries.vocabulary(queries.WORDS)
    t = WordTokenizer(path)._t
    for df in (docs, given):
        folder = scratch_path(spark, "records-test")
        records.write(df, folder, path, end=(1,), per_shard=17)
        got = records.read(records.index(spark, folder), folder).orderBy("start").collect()
        texts, start = pairs_of(df), 0
        assert [r.doc_id for r in got] == sorted(texts)
        for r in got:
            ids = [*t.encode(texts[r.doc_id], add_special_tokens=False).ids, 1]
            assert (r.start, r.n_tokens, r.ids) == (start, len(ids), ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
            start += len(ids)
    # two ranges, and nulls, are cut into files of 14 rows at most, in the same order
    folder, some = scratch_path(spark, "records-test"), docs_of(spark, [str(i) for i in range(100)], [None, None, *range(98)]).repartition(3)
    records.write(some, folder, path, per_shard=7, ranges=2)
    found = records.index(spark, folder)
    assert max(r["count"] for r in found.groupBy("shard").count().collect()) == 14 and found.select("shard").distinct().count() >= 8
    got = records.read(found, folder).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, *range(98)] and [r.ids for r in got[2:]] == [t.encode(str(i), add_special_tokens=False).ids for i in range(2, 100)]
    folder = scratch_path(spark, "records-test")
    records.write(docs.limit(0), folder, path)
    assert records.read(records.index(spark, folder), folder).count() == 0


def test_damaged_records_are_found():
    raw = records.frame(b"hello")
    assert records.unframe(raw) == b"hello"
    for at in range(len(raw)):
        with pytest.raises(ValueError):
            records.unframe(raw[:at] + bytes([raw[at] ^ 1]) + raw[at + 1 :])


def test_word_tokenizer_is_the_library():
    t = WordTokenizer(queries.vocabulary(queries.WORDS))
    letters = "ab 'sS'LL\n\tÉçéßÀ☃\U0001f600日本İΣς2½_-—«the<|endoftext|>́ \x1c\x85#!"
    for k in range(1500):
        x = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) if k % 10 else "a <|endoftext|> b"
        assert np.frombuffer(t.encode(x), "<u4").tolist() == t._t.encode(x, add_special_tokens=False).ids


# 6 pieces


def test_pieces_are_the_library():
    e = pieces.PieceEncoder(queries.vocabulary(queries.PIECES))
    letters = "ab  \n\tçé☃\U0001f600日本the▁.,'’aaa0123   "
    for _ in range(2500):
        x = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        assert e.encode(x) == e.sp.encode(x)
    for _ in range(300):
        x = "".join(chr(rng.choice([rng.randint(32, 0x2FFF), rng.randint(32, 126)])) for _ in range(rng.randint(0, 60)))
        assert e.encode(x) == e.sp.encode(x) and e.decode(e.encode(x)) == e.sp.decode(e.sp.encode(x))


def test_piece_digests(spark, docs, given):
    model = queries.vocabulary(queries.PIECES)
    sp = pieces.PieceEncoder(model).sp
    for df in (docs, given):
        texts = pairs_of(df)
        got = {r.doc_id: tuple(r)[1:] for r in pieces.digests(df, model).collect()}
        for d, t in texts.items():
            ids = sp.encode(t)
            decoded = sp.decode(ids) if ids else ""
            assert got[d] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    assert pieces.encode(docs, model).count() == len(TEXTS) and pieces.digests(docs.limit(0), model).count() == 0


# 7 quality


def test_quality_rejects_poor_and_keeps_clean(spark):
    base = DATA.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    got = quality.select(docs, quality.fit(docs, labels)).join(labels, "doc_id").select("selected", "quality").collect()
    good = [r.selected for r in got if r.quality == 1]
    poor = [r.selected for r in got if r.quality == 0]
    assert sum(good) / len(good) > 0.97 and sum(poor) / len(poor) < 0.3


def test_quality_models_and_top_k(spark, docs):
    counts = quality.bucket_counts(docs, 50)
    want = Counter(int(b) for t in TEXTS for b in quality.buckets(t, 50))
    assert dict(enumerate(counts.tolist())) == {b: want[b] for b in range(50)}
    keys = spark.createDataFrame([(float(rng.choice([rng.random(), 0.5, 1e9])),) for _ in range(3000)], "key double")
    order = sorted((r.key for r in keys.collect()), reverse=True)
    for k in (1, 17, 1500, 2999, 3000, 9999):
        assert quality.kth_largest(keys, k, parts=10, few=20) == order[min(k, 3000) - 1]
    assert quality.kth_largest(keys, 0) is None
    model = quality.Model(np.linspace(-1, 1, 50), 0.0)
    picked = quality.select(docs, model, keep=5).where("selected").count()
    assert picked >= 5 and quality.drop_poor(docs, model, keep=5).count() == picked
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.drop_poor(docs, quality.fit(docs, labels)).count() == len(TEXTS)
    assert quality.select(docs.limit(0), quality.fit(docs.limit(0), labels)).count() == 0


# 8 packing


def test_patterns_use_every_piece_once():
    for room in (7, 64, 4096):
        h = Counter(rng.choice([rng.randint(1, room), room, 1, max(1, room // 3)]) for _ in range(900))
        found = packing.patterns(dict(h), room)
        used = Counter()
        for pattern, n in found:
            assert sum(size * times for size, times in pattern) <= room
            for size, times in pattern:
                used[size] += times * n
        assert used == h
    assert packing.patterns({}, 9) == []


def test_packing_places_every_token_once(spark, docs, given):
    path = queries.vocabulary(queries.WORDS)
    t = WordTokenizer(path)._t
    for df, room in ((docs, 64), (given, 512)):
        texts = pairs_of(df)
        got = packing.pack(packing.pieces(df, path, room, end=(2,), with_ids=True), room, salts=3).collect()
        by_doc, by_sequence = defaultdict(list), defaultdict(list)
        for r in got:
            by_doc[r.doc_id].append(r)
            by_sequence[r.sequence_id].append(r)
            assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        for d, text in texts.items():
            ids = [*t.encode(text, add_special_tokens=False).ids, 2]
            assert [i for r in sorted(by_doc[d], key=lambda r: r.start) for i in r.ids] == ids and {r.doc_tokens for r in by_doc[d]} == {len(ids)}
        for own in by_sequence.values():
            at = 0
            for r in sorted(own, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at <= room
        tokens = sum(r.length for r in got)
        assert len(by_sequence) <= math.ceil(tokens / room) * 1.05 + 1
    assert packing.pack(packing.pieces(docs.limit(0), path, 64), 64).count() == 0


# 9 neighbours


def test_neighbours_recall_and_ties(spark):
    embeddings = spark.read.parquet(f"{DATA.replace('0.001', '0.1')}/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, np.float64)) for r in embeddings.collect()]
    x, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    got = defaultdict(list)
    for r in ann.search(embeddings, block=700, query_block=30).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        order = sorted((-s[j], ids[j]) for j in range(len(ids)) if j != q)[:20]
        assert len(got[ids[q]]) == 20
        hits += len({i for _, i in order} & {i for i, _ in got[ids[q]]})
        total += 20
        assert all(abs(score - s[np.flatnonzero(ids == i)[0]]) < 1e-12 for i, score in got[ids[q]])
    assert hits / total >= 0.9


def test_neighbours_odd_rows(spark):
    vectors = [[1.0, 0.0]] * 60 + [[0.5, 0.5], None, [], [0.0, 0.0], [None, 1.0], [float("nan"), 1.0], [float("inf"), 1.0], [3.0, -1.0], [1.0, 2.0, 3.0]]
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(vectors)] + [(None, [1.0, 1.0], "x")], "vec_id long, embedding array<double>, score string")
    got = defaultdict(list)
    for r in ann.search(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == {0, 20, 40, 60} and got.pop(60)[0] == (1, 67, 1.0)
    for q, near in got.items():
        want = [67, *[i for i in range(60) if i != q]][:20]
        assert [i for _, i, _ in near] == want and [n for n, _, _ in near] == list(range(1, 21)) and near[0][2] == 3.0
    assert ann.search(df.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(few).orderBy("rank").collect()] == [(0, 1, 1, 2.0), (0, 2, 2, 2.0)]


# 10 suffixes


def brute_removed(texts, span):
    seen = Counter(t[i : i + span] for t in texts for i in range(len(t) - span + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - span + 1):
            if seen[t[i : i + span]] > 1:
                gone[i : i + span] = True
        out.append(gone[:-1])
    return out


def spans_of(flags):
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(int), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def brute_words(texts, words):
    cut = [[(m.start(), m.end()) for m in re.finditer(rb"[^ \t\n\r\x0b\x0c]+", t)] for t in texts]
    runs = [[tuple(t[a:b] for a, b in own[i : i + words]) for i in range(len(own) - words + 1)] for t, own in zip(texts, cut, strict=True)]
    seen = Counter(r for own in runs for r in own)
    out = []
    for t, own, bounds in zip(texts, runs, cut, strict=True):
        flags = np.zeros(len(t), bool)
        for i, r in enumerate(own):
            if seen[r] > 1:
                flags[bounds[i][0] : bounds[i + words - 1][1]] = True
        out.append(flags)
    return out


def odd_texts():
    """Texts whose windows hold many words, few, or none, with repeats that start and end within words."""
    word = lambda n: "".join(rng.choice("abcdeé") for _ in range(n))
    prose = lambda n, most: rng.choice(" \n").join(word(rng.randint(1, most)) for _ in range(n))
    shared = [prose(90, 5), prose(60, 14), word(500), prose(52, 3), prose(40, 9) + " " + word(200)]
    texts = []
    for _ in range(40):
        parts = [rng.choice([prose(30, 6), word(90), *shared]) for _ in range(rng.randint(1, 4))]
        texts.append(rng.choice(["", " ", "x"]).join(parts))
    cut = texts[3][5:]
    return [*texts, cut, texts[4][: len(texts[4]) // 2] * 2, " ".join(shared[0].split("\n")), "a " * 700, "q" * 900, "", " "]


@pytest.mark.parametrize(("span", "words", "bits"), [(400, 51, 64), (400, 51, 1), (400, None, 64), (60, 9, 64), (60, None, 0)])
def test_suffix_removals_match_brute_force(spark, docs, given, span, words, bits):
    for df in (docs, docs_of(spark, odd_texts()), *([given] if bits == 64 and span == 400 else [])):
        rows = df.select("doc_id", "text").collect()
        data = [(r.text or "").encode() for r in rows]
        gone = brute_removed(data, span)
        found = suffixes.with_spans(df, span=span, words=words, bits=bits)
        got = {(r.doc_id, r.text): r for r in found.withColumn("kept", suffixes.kept_bytes(F.col("text"), F.col("spans"))).collect()}
        assert found.count() == len(rows)
        runs = brute_words(data, words) if words else gone
        for r, flags, of_words in zip(rows, gone, runs, strict=True):
            own = got[r.doc_id, r.text]
            assert [(s.start, s.end) for s in own.spans or []] == spans_of(flags)
            assert bytes(own.kept) == bytes(np.frombuffer((r.text or "").encode(), np.uint8)[~flags])
            if words:
                assert [(s.start, s.end) for s in own.spans_words or []] == spans_of(of_words)
    assert suffixes.with_spans(docs.limit(0), words=words).count() == 0


def test_drop_repeats_keeps_columns(spark):
    passage = "".join(rng.choice("abcdefg hij é") for _ in range(500))
    df = docs_of(spark, ["1 " + passage, passage + " 2", None, "short"]).withColumn("n_chars", F.length("text").cast("long"))
    got = {r.doc_id: r for r in suffixes.drop_repeats(df).collect()}
    assert suffixes.drop_repeats(df).columns == df.columns and got[2].text is None and got[3].text == "short"
    assert got[0].text.strip() == "1" and got[1].text.strip() == "2" and got[0].n_chars == len(got[0].text)


def test_long_texts_are_pointed_at_alike_in_parts(monkeypatch):
    data = bytes(rng.choice(b"abcd") for _ in range(5000))
    whole = suffixes.pointers(data, 400, 200)
    monkeypatch.setattr(suffixes, "PIECE", 700)
    parts = suffixes.pointers(data, 400, 200)
    spread = lambda found: {p: a for a, f, l in zip(*map(np.ndarray.tolist, found), strict=True) for p in range(f, l + 1)}
    assert spread(whole) == spread(parts)
