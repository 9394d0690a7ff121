"""Near duplicates by SimHash with multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motifloom.llm.common import columns_of, forget, fresh, written
from motifloom.llm.graph import components
from motifloom.llm.suffixes import Hashes
from motifloom.llm.tokens import batched, rows

#: Fingerprints that may share one segment value before the bucket is handled by midpoints.
BUCKET = 64
#: near_groups: one document of so many is counted for the order of shingles, which has so many common ones at most; the documents of an entry with which its others are compared in the first round, sixteen times as many in each later one.
SAMPLE, COMMON, HEADS = 8, 100_000, 4
#: near_groups: the words of a set's parities, 64 bits each.
PARITIES = ("b0", "b1", "b2", "b3")
#: near_groups: listed shingles of a document up to which a pair is met at one of those it shares only.
KEYS = 64


def _bits(hashes: np.ndarray, words: int) -> np.ndarray:
    """Bits set in over half of the hashes, each of `words` 64-bit words; as signed 64-bit words."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(len(hashes), -1), axis=1, bitorder="little")
    set_ = bits.sum(0, dtype=np.int64) * 2 > len(hashes)
    return np.packbits(set_, bitorder="little").view("<i8")[:words]


def _shingles(text: str | None, size: int) -> list[bytes]:
    """Shingles of the lower-cased (A-Z only) words, repeats included; under `size` words: the whole sequence."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    last = len(words) - size + 1
    return [joined[s:e] for s, e in zip(starts[:last].tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint long): a bit is 1 if set in over half of the XXH64 hashes of the shingles.

    Words are runs of characters other than ASCII blanks. Null, empty or blank texts have fingerprint 0.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.int64())])

    def run(batches: Iterator) -> Iterator:
        from xxhash import xxh64_intdigest

        def one():
            for doc, text in rows(batches, "doc_id", "text"):
                hashes = [xxh64_intdigest(s, seed) for s in _shingles(text, size)]
                yield doc, int(_bits(np.array(hashes, np.uint64), 1)[0]) if hashes else 0

        yield from batched(one(), schema)

    return columns_of(docs, [(id_col, "doc_id"), (text_col, "text")]).mapInArrow(run, "doc_id long, fingerprint long")


def segment(fp: Column, k: int, of: int) -> Column:
    """The k-th of `of` equal segments of a 64-bit fingerprint."""
    width = 64 // of
    return F.shiftrightunsigned(fp, k * width).bitwiseAND(F.lit((1 << width) - 1)).cast("long")


def ball(value: Column, width: int, radius: int = 1) -> Column:
    """The array of all values within `radius` (0 or 1) differing bits of a `width`-bit value."""
    masks = [0] + [1 << i for i in range(width)] * (radius > 0)
    masks = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    return F.transform(F.expr("array(" + ",".join(f"CAST({m} AS BIGINT)" for m in masks) + ")"), lambda m: value.bitwiseXOR(m))


def links(prints: DataFrame, most: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints, prints.fp, at `most` (up to 2) or fewer differing bits.

    Two fingerprints that differ in at most 3 bits differ in at most one bit of one 32-bit half.
    Each half is a table from its value to fingerprints; each fingerprint enumerates the ball of
    radius 1 around its halves, fetches the table's matches, and the complete distance is verified
    within the join. A table entry with over `bucket` fingerprints is not expanded into pairs:
    the fingerprints it holds or matches are tied by midpoints instead: two of them differ in at
    most 2 bits exactly if some value is within one bit of both, so each lists the 65 values
    around it and is tied to the smallest that lists the same. The links join the same fingerprints
    as all pairs would; those by midpoints may tie a fingerprint to one it reaches in one step only.
    """
    if most > 2:
        raise ValueError("links are exact for up to two differing bits")
    prints = prints.select("fp")
    halves = F.explode(F.array(*[F.struct(F.lit(k).alias("seg"), segment(F.col("fp"), k, 2).alias("val")) for k in (0, 1)])).alias("h")
    table = prints.select("fp", halves).select("fp", "h.*")
    large = table.groupBy("seg", "val").count().where(F.col("count") > bucket).select("seg", "val", F.lit(True).alias("hot"))
    entries = table.join(large, ["seg", "val"], "left_anti").select("seg", "val", F.col("fp").alias("b"))
    entries = entries.unionByName(large.select("seg", "val", F.lit(None).cast("long").alias("b")))
    # each probe becomes 33 rows, so they are dealt out first, whatever the size of the table they come from; Spark sizes them as if explode() added none, so they and what
    # midpoints list are told not to be broadcast
    probes = prints.repartition(prints.sparkSession.sparkContext.defaultParallelism * 4, "fp").select("fp", halves).select("fp", F.col("h.seg").alias("pseg"), F.explode(ball(F.col("h.val"), 32)).alias("pval")).hint("merge")
    near = F.col("b").isNull() | ((F.col("fp") < F.col("b")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= most))
    met = probes.join(entries, (F.col("pseg") == F.col("seg")) & (F.col("pval") == F.col("val")) & near)
    met = written(met.select(F.col("fp").alias("a"), "b").distinct(), "simhash-matches")
    crowd = met.where("b is null").select(F.col("a").alias("fp"))
    around = crowd.select("fp", F.explode(ball(F.col("fp"), 64)).alias("mid")).hint("merge")
    least = around.groupBy("mid").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select(F.col("mid").alias("m"), "b")
    tied = around.join(least, F.col("mid") == F.col("m")).where("fp != b").select(F.col("fp").alias("a"), "b").distinct()
    return met.where("b is not null").unionByName(tied)


def duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, most: int = 2) -> DataFrame:
    """One row per document: (doc_id, fingerprint long, component_id).

    component_id is the smallest doc_id reachable over links of at most `most` differing bits, the
    document's own included. Equal fingerprints count once in the search, however many documents
    have them. Documents without an id stand for nothing: their component_id is that of documents
    with the same or a linked fingerprint, or null. Rows that repeat an id are kept.
    """
    own = written(fingerprints(docs, id_col, text_col, size), "simhash")
    prints = written(own.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("least")), "prints")
    joined = components(links(prints, most))
    named = prints.join(joined, prints.fp == joined.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = written(named, "print-roots")
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = named.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    return own.join(of_print, own.fingerprint == of_print.fp, "left").select("doc_id", "fingerprint", "component_id")


def _shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, as _shingles() cuts them, in ascending order."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(1, len(words) - size + 1)
    return np.unique(Hashes(b" ".join(words)).of(starts[:last], ends[min(size, len(words)) - 1 :]))


def _shingle_rows(batches: Iterator, size: int, schema: pa.Schema) -> Iterator:
    for _, text in rows(batches, "doc_id", "text"):
        yield pa.RecordBatch.from_arrays([pa.array(_shingle_hashes(text, size).view(np.int64))], schema=schema)


def _common(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many documents of a sample have, ascending, and how many; COMMON of them at most.

    They only tell near_groups which shingles to look up last: any such list gives the same groups.
    """
    schema = pa.schema([("h", pa.int64())])
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)
    counts = sample.mapInArrow(lambda b: _shingle_rows(b, size, schema), "h long").groupBy("h").count().where("count >= 4")
    found = counts.orderBy(F.desc("count"), "h").limit(COMMON).toArrow()
    keys, n = found["h"].to_numpy().view(np.uint64), found["count"].to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def _parities(hashes: np.ndarray) -> list[int]:
    """Whether an odd number of the hashes ends in each 8-bit value. A hash that one of two sets has alone turns one bit, so sets differ in as many hashes at least as bits."""
    odd = np.bincount((hashes & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist()


def _prefixes(batches: Iterator, size: int, common: tuple[np.ndarray, np.ndarray]) -> Iterator:
    """Of each text a 128-bit name of its set of shingles, their number, the set's fingerprint and parities, and the first fifth (and one more), those that few documents have first."""
    from xxhash import xxh3_128_digest

    keys, counts = common
    for doc, text in rows(batches, "doc_id", "text"):
        hashes = _shingle_hashes(text, size)
        name = np.frombuffer(xxh3_128_digest(hashes.tobytes()), "<i8").tolist()
        n, fp, odd = len(hashes), int(_bits(hashes, 1)[0]) if len(hashes) else 0, _parities(hashes)
        if len(keys) and n:
            at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            hashes = hashes[np.lexsort((hashes, np.where(keys[at] == hashes, counts[at], 0)))]
        yield doc, *name, n, fp, *odd, hashes[: n - -(-4 * n // 5) + 1].view(np.int64) if n else []


def _sets(batches: Iterator, size: int, bits: int) -> Iterator:
    for doc, text in rows(batches, "doc_id", "text"):
        hashes = _shingle_hashes(text, size)
        yield doc, len(hashes), hashes.view(np.int64) if bits == 64 else np.unique((hashes >> np.uint64(32)).astype(np.uint32).view(np.int32))


def _similar(pairs: DataFrame, docs: DataFrame, size: int, bits: int = 32) -> DataFrame:
    """Of pairs(x, y) of docs(doc_id, text) those at a Jaccard similarity of 0.8 or more of their shingles, counted in full: (a, b, again).

    Sets go along as hashes of 32 or 64 bits. With 32, pairs so near to the threshold that equal hashes
    of different shingles could decide are returned too, to be counted again.
    """
    pairs = written(pairs, "near-pairs")
    ids = pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct()
    kind = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("hashes", pa.list_(pa.int32() if bits == 32 else pa.int64()))])
    ddl = f"doc_id long, n int, hashes array<{'int' if bits == 32 else 'long'}>"
    sets = docs.join(ids, F.col("doc_id") == F.col("id"), "left_semi").mapInArrow(lambda b: batched(_sets(b, size, bits), kind, 512), ddl)
    sets = written(sets, "near-sets")
    side = lambda of: sets.select(F.col("doc_id").alias(of + "id"), F.col("n").alias(of + "n"), F.col("hashes").alias(of + "h")).hint("merge")  # noqa: E731  # never broadcast
    both = pairs.join(side("x"), F.col("x") == F.col("xid")).join(side("y"), F.col("y") == F.col("yid"))
    over = 9 * F.size(F.array_intersect("xh", "yh")) - 4 * (F.col("xn") + F.col("yn"))
    unsure = F.lit(0.0) if bits == 64 else 9 * (1 + F.col("xn").cast("double") * F.col("yn") / (1 << 29))
    met = both.select(F.col("x").alias("a"), F.col("y").alias("b"), over.alias("over"), unsure.alias("unsure")).where("over >= -unsure")
    met = written(met.select("a", "b", (F.col("over") < F.col("unsure")).alias("again")), "near-links")
    forget(pairs, sets)
    return met


def _by_fingerprint(kinds: DataFrame) -> DataFrame:
    """Pairs (x, y) of kinds(id, fp): each with the smallest id of its fingerprint, and those of fingerprints that links() ties."""
    heads = written(kinds.groupBy("fp").agg(F.min("id").alias("head"), F.count("*").alias("several")), "near-prints")
    same = kinds.join(heads.where("several > 1").withColumnRenamed("fp", "of"), F.col("fp") == F.col("of")).where("id != head")
    tied = links(heads.select("fp"))
    at = lambda of: heads.select(F.col("fp").alias(of + "fp"), F.col("head").alias(of))
    tied = tied.join(at("x"), F.col("a") == F.col("xfp")).join(at("y"), F.col("b") == F.col("yfp"))
    return same.select(F.col("head").alias("x"), F.col("id").alias("y")).unionByName(tied.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))).distinct()


def _across(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Of links(a, b) those between different components of roots(node, root): (a, b, ra, rb) with both components; nodes that roots lacks stand for themselves."""
    at = lambda of: roots.select(F.col("node").alias(of + "n"), F.col("root").alias(of + "r"))
    met = links.join(at("a"), F.col("a") == F.col("an"), "left").join(at("b"), F.col("b") == F.col("bn"), "left")
    return met.select("a", "b", F.coalesce("ar", "a").alias("ra"), F.coalesce("br", "b").alias("rb")).where("ra != rb")


def _tied(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots(node, root) with the components that links(a, b) join made one: only roots and new nodes go through another search for components."""
    more = written(components(_across(roots, links), "ra", "rb"), "near-joined")
    moved = more.select(F.col("node").alias("of"), F.col("root").alias("to"))
    kept = roots.join(moved, F.col("root") == F.col("of"), "left").select("node", F.coalesce("to", "root").alias("root"))
    return written(kept.unionByName(more.join(roots.select("node"), "node", "left_anti").select("node", "root")), "near-roots")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, heads: int = HEADS) -> DataFrame:
    """(doc_id, component_id) of near duplicates: the components of all pairs at a Jaccard similarity of 0.8 or more on `size`-word shingles.

    First the SimHash fingerprints of the sets are searched by multi-index hashing (links()), and
    what they tie is verified by the complete sets. Fingerprints of sets at 0.8 can differ in many
    more bits, so the rest is found exactly by prefixes: whatever order all shingles have, two sets at
    0.8 or more have one in common among the first fifth (and one more) of each. So only those are
    listed, in an order that puts the shingles of many documents last; documents that list the same
    one, in different components so far, are compared by their complete sets, unless their sizes,
    the places of the shingle in both or the number of listed shingles that both have leave too little to
    have in common: what two sets share is at most what their prefixes share and what one of them has
    behind its prefix. Nor are they compared if the parities of their sets (256 bits) differ in more bits than the sets may differ in
    shingles, so a crowded entry of texts that differ makes few pairs; those of over 575 shingles are seldom told apart so. (Entries settled before count for nothing there: a pair that shares one is
    decided, or in one component.) In rounds,
    the documents of a large entry are compared with `heads` of its own, then with sixteen times as many;
    entries with up to four times as many documents are settled by all their pairs that are not yet in
    one component. So an entry of one group costs what it holds. From the second round on, where entries are crowded, documents go
    along with the keys they have there (KEYS at most, or none), so that a pair makes a row at its smallest shared key alone.
    Equal sets count once. Texts without words are near nothing but each other; null ids are left
    out. Rows that repeat an id are one document, near whatever one of them is near.
    """
    docs = columns_of(docs, [(id_col, "doc_id"), (text_col, "text")]).where("doc_id is not null")
    schema = pa.schema([("doc_id", pa.int64()), ("k0", pa.int64()), ("k1", pa.int64()), ("n", pa.int32()), ("fp", pa.int64()), *[(c, pa.int64()) for c in PARITIES], ("keys", pa.list_(pa.int64()))])
    common = _common(docs, size)
    own = docs.mapInArrow(lambda b: batched(_prefixes(b, size, common), schema, 512), "doc_id long, k0 long, k1 long, n int, fp long, " + "".join(f"{c} long, " for c in PARITIES) + "keys array<long>")
    own = written(own, "prefixes")
    kinds = written(own.groupBy("k0", "k1").agg(F.min("doc_id").alias("id"), F.max("fp").alias("fp"), F.max("n").alias("n")), "shingle-kinds")
    firsts = kinds.where("n > 0").select(F.col("id").alias("doc_id"), "k0", "k1")
    some = own.where("n > 0").join(firsts, ["doc_id", "k0", "k1"], "left_semi").dropDuplicates(["doc_id", "k0", "k1"])
    listed = some.select(F.col("doc_id").alias("id"), "n", F.posexplode("keys").alias("pos", "key"))
    listed = written(listed.select("id", "key", F.struct("n", "pos").alias("of")), "near-listed")
    held = written(listed.groupBy("key").count().where("count > 1").select(F.col("key").alias("held")), "near-held")
    entries = written(listed.join(held, F.col("key") == F.col("held"), "left_semi").select("id", "key", "of.*"), "near-entries")
    forget(listed, held)
    # ids whose rows have different texts have no parities
    odd = own.where("n > 0").groupBy(F.col("doc_id").alias("odd_id")).agg(*[F.min(c).alias(c) for c in PARITIES], *[F.max(c).alias("m" + c) for c in PARITIES])
    odd = written(odd.where(" AND ".join(f"{c} = m{c}" for c in PARITIES)).select("odd_id", *PARITIES), "near-parities")
    with_odd = lambda df: df.join(odd, F.col("id") == F.col("odd_id"), "left").drop("odd_id")
    side = lambda df, of: df.select(*[F.col(c).alias(of + c) for c in df.columns])
    # sizes, and what is left behind the shingle's places, allow a similarity of 0.8; one component is not compared again
    both = 4 * (F.col("xn") + F.col("yn"))
    turned = sum((F.bit_count(F.col("x" + c).bitwiseXOR(F.col("y" + c))) for c in PARITIES[1:]), F.bit_count(F.col("xb0").bitwiseXOR(F.col("yb0"))))
    near = (9 * F.least("xn", "yn") >= both) & (F.col("xroot") != F.col("yroot")) & F.coalesce(9 * turned <= F.col("xn") + F.col("yn"), F.lit(True))
    left = 9 * F.least(F.col("xn") - F.col("xpos"), F.col("yn") - F.col("ypos")) >= both
    # a pair that may share an earlier shingle in a large entry is not decided by the places of this one, as this entry does not come again
    left = left | (~F.col("ylarge") & (F.least("xwide", "ywide") > 0))
    # nine times the listed shingles that a pair must share in entries that this round settles: the rest may lie behind a prefix or in large entries
    behind = F.floor((4 * F.greatest("xn", "yn") + 4) / 5) - 1
    needed = both - 9 * (behind + F.least("xwide", "ywide"))
    shared = F.array_intersect("xkeys", "ykeys")
    once = F.coalesce(F.col("xkey") == F.array_min(shared), F.lit(True))
    found = _similar(_by_fingerprint(kinds.where("n > 0")), docs, size)
    again, roots, several = found.where("again"), written(components(found.where("not again")), "near-roots"), heads
    while True:
        at = entries.join(roots, entries.id == roots.node, "left").select("id", "key", "n", "pos", F.coalesce("root", "id").alias("root"))
        slot = F.pmod(F.xxhash64("id", F.lit(several)), F.lit(several)).alias("slot")
        first = F.min(F.struct(F.xxhash64("id", F.lit(-several)), "id", "n", "pos", "root")).alias("h")
        slots = at.groupBy("key", slot).agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("m"), first)
        slots = written(slots.select("key", "low", "high", "m", "h.id", "h.n", "h.pos", "h.root"), "near-heads")
        apart = slots.groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("m").alias("m")).where("low < high")
        apart = written(apart.select(F.col("key").alias("of"), (F.col("m") > 4 * several).alias("large")), "near-apart")
        if apart.isEmpty():
            break
        wide = F.sum(F.col("large").cast("int")).over(Window.partitionBy("id")).alias("wide")
        several_keys = lambda c: F.when(F.size(c) <= KEYS, c)
        of_kind = [F.collect_list(F.when(F.col("large") == kind, F.col("key"))).over(Window.partitionBy("id")) for kind in (True, False)]
        keys = (several_keys(F.when(F.col("large"), of_kind[0]).otherwise(of_kind[1])) if several > heads else F.lit(None).cast("array<long>")).alias("keys")
        entries = written(with_odd(at.join(apart, F.col("key") == F.col("of")).select(*at.columns, "large", wide, keys)), "near-left")
        chosen = slots.join(apart, F.col("key") == F.col("of")).where("large").select(*at.columns, "large", F.lit(None).cast("long").alias("wide"))
        chosen = chosen.withColumn("keys", several_keys(F.collect_list("key").over(Window.partitionBy("id"))))
        y = side(with_odd(chosen).unionByName(entries.where("not large")), "y")
        met = side(entries, "x").join(y, (F.col("xkey") == F.col("ykey")) & (F.col("xid") != F.col("yid")) & (F.col("ylarge") | (F.col("xid") < F.col("yid"))) & near & (once if several > heads else F.lit(True)))
        # a row that stands for all keys of a pair says nothing about their places
        ends = F.least("xid", "yid").alias("x"), F.greatest("xid", "yid").alias("y")
        met = met.select(*ends, (left | shared.isNotNull()).alias("left"), needed.alias("needed"), F.coalesce(F.size(shared), F.lit(1)).alias("c"))
        met = met.groupBy("x", "y").agg(F.sum("c").alias("c"), F.max("left").alias("left"), F.min("needed").alias("needed"))
        found = _similar(met.where("left AND 9 * c >= needed").select("x", "y"), docs, size)
        again, roots = again.unionByName(found.where("again")), _tied(roots, found.where("not again"))
        entries, several = entries.where("large").drop("root", "large", "wide", "keys", *PARITIES), several * 16
    # pairs that one component holds by now need no second count
    again = written(_across(roots, again).distinct(), "near-again")
    if not again.isEmpty():
        roots = _tied(roots, _similar(again.select(F.col("a").alias("x"), F.col("b").alias("y")), docs, size, 64))
    named = kinds.join(roots, kinds.id == roots.node, "left").select(F.col("k0").alias("kk0"), F.col("k1").alias("kk1"), F.coalesce("root", "id").alias("component_id"))
    return own.join(named, (F.col("k0") == F.col("kk0")) & (F.col("k1") == F.col("kk1"))).select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the near copies: of each group of near_groups the document with the smallest id stays.

    Rows without an id stay. Rows that repeat an id are one document: they stay or go together.
    """
    go = fresh(docs, "near_copy_id")
    gone = near_groups(docs, id_col, text_col).where("doc_id != component_id").select(F.col("doc_id").alias(go)).distinct()
    return docs.join(gone, docs[id_col] == gone[go], "left_anti")
