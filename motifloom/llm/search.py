"""Ranked lexical search: an Aho-Corasick automaton of all items' terms reads term counts off the documents' texts; no index of documents is made."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motifloom.llm.common import columns_of, written

#: What separates terms, as a character class of regular expressions; only A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Terms of items (an item's distinct terms, summed over items) that one automaton and its broadcast hold; further items wait for another pass.
PAIRS = 500_000
#: Items of one pass, which bounds the scores and results that a task holds.
ITEMS = 20_000
#: Documents scored at a time, and the bytes of text after which a group of them ends.
DOCS, BYTES = 256, 4 << 20
#: Shares of an item's partial results before the last ranking.
SALTS = 64

# Bytes of the text in UTF-8: separators become blanks, capitals small letters.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: Column) -> Column:
    """The terms of a text, repeats included, in order; none for a null text."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))


def folded(text: bytes | None) -> bytes:
    """A text in UTF-8 as its terms with at least one blank around each."""
    return b" " + (text or b"").translate(_TABLE) + b" "


class Items:
    """The terms of a block of items, and which items each belongs to. Sent to every worker, so its size is bounded by PAIRS and ITEMS."""

    def __init__(self, pairs: list[tuple]):
        self.key = uuid.uuid4().hex
        self.ids = list(dict.fromkeys(i for i, _ in pairs))
        self.terms = list(dict.fromkeys(t for _, t in pairs))
        item, term = {x: k for k, x in enumerate(self.ids)}, {x: k for k, x in enumerate(self.terms)}
        at = np.array([(term[t], item[i]) for i, t in pairs], np.int64).reshape(-1, 2)
        at = at[np.argsort(at[:, 0], kind="stable")]
        self.items = at[:, 1]
        self.count = np.bincount(at[:, 0], minlength=len(self.terms))
        self.first = np.cumsum(self.count) - self.count
        self.weight = np.zeros(len(self.terms), np.int64)


_built: dict[str, object] = {}


def automaton(of: Items):
    """The worker's automaton for a block of items, built once. Terms have blanks at both ends, so that only whole ones match."""
    if of.key not in _built:
        import ahocorasick

        made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, t in enumerate(of.terms):
            made.add_word(" " + t.encode().decode("latin-1") + " ", k)
        made.make_automaton()
        _built.clear()
        _built[of.key] = made
    return _built[of.key]


def _found(machine, text: bytes) -> np.ndarray:
    """The numbers of the terms met in a folded text, once an occurrence."""
    return np.fromiter((k for _, k in machine.iter(text.decode("latin-1"))), np.int64)


def _groups(batches: Iterator, *columns: str) -> Iterator[list[list]]:
    """Rows of Arrow batches by column, some documents at a time; the last column is the text, in UTF-8."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes, at = pc.fill_null(pc.binary_length(batch.column(columns[-1])), 0).to_numpy(zero_copy_only=False).astype(np.int64), 0
        while at < batch.num_rows:
            n = max(1, int(np.searchsorted(np.cumsum(sizes[at : at + DOCS]), BYTES)))
            part = batch.slice(at, n)
            yield [part.column(c).to_pylist() for c in columns]
            at += n


def _statistics(of) -> Callable:
    """Partial sums of a task: (term, documents with it), (-1, documents with a term), (-2, terms of all documents)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        block = of.value
        machine, df, some, total = automaton(block), np.zeros(len(block.terms), np.int64), 0, 0
        for (texts,) in _groups(batches, "text"):
            for text in map(folded, texts):
                n = len(text.split())
                some, total = some + (n > 0), total + n
                df[np.unique(_found(machine, text))] += 1
        met = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*met.tolist(), -1, -2], pa.int64()), pa.array([*df[met].tolist(), some, total], pa.int64())], ["term", "n"])

    return run


def scores(block: Items, machine, texts: list[bytes | None], some: int, total: int) -> np.ndarray:
    """The score of each text (row) for each item of the block (column)."""
    rows, found, lengths = [], [], []
    for row, text in enumerate(map(folded, texts)):
        n = len(text.split())
        lengths.append(100 - 90 + (90 * n * some) // total if total else 10)
        met = _found(machine, text)
        rows.append(np.full(len(met), row, np.int64))
        found.append(met)
    t = len(block.terms)
    keys, tf = np.unique(np.concatenate(rows) * t + np.concatenate(found), return_counts=True)
    row, term = keys // t, keys % t
    tf, m = tf.astype(np.int64), np.array(lengths, np.int64)[row]
    part = block.weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m))
    # each (text, term) goes to all items of the term
    many = block.count[term]
    at = np.repeat(block.first[term] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    out = np.zeros((len(texts), len(block.ids)), np.int64)
    np.add.at(out.reshape(-1), np.repeat(row, many) * len(block.ids) + block.items[at], np.repeat(part, many))
    return out


class _Best:
    """The highest scores of each item so far, equal ones by ascending id (none last)."""

    def __init__(self, items: int, most: int):
        self.most, self.floor = most, np.ones(items, np.int64)
        self.held = np.zeros((0, 4), np.int64)  # item, -score, whether there is no id, id
        self.new: list[np.ndarray] = []
        self.waiting = 0

    def add(self, ids: list[int | None], found: np.ndarray) -> None:
        row, item = np.nonzero(found >= self.floor)
        number = np.array([x if x is not None else 0 for x in ids], np.int64)
        none = np.array([x is None for x in ids], np.int64)
        self.new.append(np.stack([item, -found[row, item], none[row], number[row]], 1))
        self.waiting += len(row)
        if self.waiting > max(100_000, 4 * self.most * len(self.floor)):
            self.settle()

    def settle(self) -> np.ndarray:
        every = np.concatenate([self.held, *self.new])
        every = every[np.lexsort((every[:, 3], every[:, 2], every[:, 1], every[:, 0]))]
        size = np.bincount(every[:, 0], minlength=len(self.floor))
        place = np.arange(len(every)) - np.repeat(np.cumsum(size) - size, size)
        self.held, self.new, self.waiting = every[place < self.most], [], 0
        last = every[place == self.most - 1]
        self.floor[last[:, 0]] = -last[:, 1]
        return self.held


def _ranked(of, some: int, total: int, most: int, item_type) -> Callable:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        block = of.value
        machine, best = automaton(block), _Best(len(block.ids), most)
        for ids, texts in _groups(batches, "doc_id", "text"):
            best.add(ids, scores(block, machine, texts, some, total))
        top = best.settle()
        ids = pa.array(block.ids, item_type).take(pa.array(top[:, 0]))
        docs = pa.array(top[:, 3], mask=top[:, 2] == 1)
        yield pa.RecordBatch.from_arrays([ids, docs, pa.array(-top[:, 1])], ["item_id", "doc_id", "score"])

    return run


def blocks(pairs: DataFrame, most_pairs: int, most_items: int) -> Iterator[list[tuple]]:
    """The (item, term) pairs by groups of whole items, each of about the given size at most; only one is on the driver at a time.

    Items are dealt by hash to about eight buckets a group, of which as many go into one as fit. One item's terms always stay together.
    """
    of = pairs.agg(F.count("*"), F.count_distinct(F.coalesce(F.col("item_id").cast("string"), F.lit("")))).first()
    shares = max(1, 8 * max(-(-of[0] // most_pairs), -(-of[1] // most_items))) if of[0] > most_pairs or of[1] > most_items else 1
    dealt = pairs.withColumn("bucket", F.pmod(F.xxhash64("item_id"), F.lit(shares)))
    sizes = dealt.groupBy("bucket").agg(F.count("*").alias("n"), F.count_distinct(F.coalesce(F.col("item_id").cast("string"), F.lit(""))).alias("items"))
    group, n, items = [], 0, 0
    groups = [group]
    for r in sizes.orderBy("bucket").collect():
        if group and (n + r.n > most_pairs or items + r["items"] > most_items):
            group, n, items = [], 0, 0
            groups.append(group)
        group.append(r.bucket)
        n, items = n + r.n, items + r["items"]
    for group in groups:
        if group:
            yield [tuple(r) for r in dealt.where(F.col("bucket").isin(group)).select("item_id", "term").collect()]


def search(
    docs: DataFrame, items: DataFrame, most: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    most_pairs: int = PAIRS, most_items: int = ITEMS,
) -> DataFrame:
    """item_id, rank, doc_id, score: the documents with the highest scores above 0 for each item, all documents counted.

    Terms, statistics and scores are whole numbers but for the floor of the weights; see README for the formula.
    Documents are read twice for each block of items: once for how many hold each term, once for the scores, of
    which a task keeps `most` an item. Every document is scored for every item it shares a term with.

    Null and empty texts have no terms, so such documents are never found and such items have no rows; documents
    without an id are found, after others with equal scores. Rows of items with equal ids are one item. Equal
    documents are ranked one by one. Ids of documents are integers.
    """
    spark = docs.sparkSession
    docs = columns_of(docs, [(doc_id, "doc_id"), (text, "text")]).withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("binary")})
    pairs = columns_of(items, [(item_id, "item_id"), (item_text, "text")]).select("item_id", F.explode(terms(F.col("text"))).alias("term")).distinct()
    pairs = written(pairs, "item-terms")
    kind = pairs.schema["item_id"].dataType
    empty = f"item_id {kind.simpleString()}, doc_id long, score long"
    found = spark.createDataFrame([], empty)
    for pairs_of in blocks(pairs, most_pairs, most_items):
        block = Items(pairs_of)
        held = spark.sparkContext.broadcast(block)
        sums = docs.select("text").mapInArrow(_statistics(held), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        n = {r.term: r.n for r in sums.collect()}  # at most one row a term of the block
        some, total = n.get(-1, 0), n.get(-2, 0)
        block.weight = np.array([math.floor(1000 * math.log((2 * some + 2) / (2 * n.get(k, 0) + 1))) for k in range(len(block.terms))], np.int64)
        held = spark.sparkContext.broadcast(block)
        from pyspark.sql.pandas.types import to_arrow_type

        found = found.unionAll(docs.mapInArrow(_ranked(held, some, total, most, to_arrow_type(kind)), empty))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    share = Window.partitionBy("item_id", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).orderBy(*order)
    best = found.withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= most)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= most)
    return best.select("item_id", "rank", "doc_id", "score")
