"""Removal of repeated passages: suffixes at chosen offsets, in buckets that are refined by those of later offsets.

What counts as repeated are windows: strings of `span` bytes and, if asked for, runs of `words` words.
Not every suffix is bucketed, as rows for all of them would be several times the input; equal windows
have the same smallest q-gram (by hash, the leftmost of equals) at the same offset, so suffixes that
begin at the smallest q-gram of some window are enough. Such a pointer stands for all windows whose
smallest q-gram it is. The q-grams are of words, and each window takes that of the first `sample`
words that lie wholly inside it, so the same pointers serve both kinds of windows. Strings of `span`
bytes with fewer words inside (unbroken scripts, encoded data) have pointers of their own, by bytes.

A bucket's identifier is a hash of its text, so the identifier of any later offset is known where the
text is, and a refined one is that of a longer text. Each round keeps only the buckets that still
have two pointers:

1. the bucket of the q-gram itself (64 bits; it only decides what goes on);
2. that of all text that the pointer's windows cover: pointers that share it are repeated whole, and
   one of them goes on for all;
3. for the rest, parts of PART windows: the bucket of the text that all of a part's windows have (64 bits, likewise);
4. each window of the parts that are left, some of the buckets of parts at a time.

Rounds 2 and 4, which remove text, tell buckets apart by 128 bits of BLAKE2b. Rounds count bucket
members, with sums within tasks first, so a bucket of any size costs what its members do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from motifloom.llm.common import columns_of, forget, fresh, sweep, written
from motifloom.llm.tokens import batched, rows

#: Windows in one part of round 3. Where a passage begins and ends a part's text is mostly repeated but few of its windows are, so larger parts list more windows in vain.
PART = 4
#: Rounds 2 and 4 list their rows in so many turns, by the bucket of the q-gram or of the part, so that fewer are on disk at once; equal texts have equal buckets.
TURNS = 2
#: Symbols of a text that are compared at once; longer texts go in parts that overlap.
PIECE = 1 << 19
#: Words inside a string of 400 bytes by which it is found; strings with fewer are found by bytes.
SAMPLE = 46
#: Kinds of windows: runs of words; strings of bytes, found by words or by bytes.
OF_WORDS, BY_WORDS, BY_BYTES = 0, 1, 2
_U = np.uint64
_BASES = (_U(0x9E3779B97F4A7C15 | 1), _U(0xD6E8FEB86659FD93 | 1))
_TABLES = tuple(np.random.default_rng(s).integers(0, 1 << 64, 256, np.uint64) for s in (101, 202))
_BLANK = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Hashes:
    """Hashes of any part of some bytes, or of 64-bit symbols, in constant time each, from prefix sums modulo 2 ** 64."""

    def __init__(self, data: bytes | np.ndarray, which: int = 0):
        n = len(data)
        powers, inverse = self._tables(which, n + 1)
        self._sums = np.zeros(n + 1, np.uint64)
        symbols = data if isinstance(data, np.ndarray) else _TABLES[which][np.frombuffer(data, np.uint8)]
        np.cumsum(symbols * powers[:n], out=self._sums[1:])
        self._inverse = inverse

    @staticmethod
    def _tables(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        held = _powers.get(which)
        if held is None or len(held[0]) < n:
            size = max(n, PIECE + 1024)
            base = int(_BASES[which])
            back = pow(base, -1, 1 << 64)
            steps = [np.full(size, _U(b)) for b in (base, back)]
            for s in steps:
                s[0] = 1
            held = _powers[which] = tuple(np.multiply.accumulate(s) for s in steps)
        return held

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of bytes start to end, for arrays of both."""
        return _mix((self._sums[end] - self._sums[start]) * self._inverse[start] + (end - start).astype(np.uint64))


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text begin and end; words are runs of bytes other than ASCII blanks."""
    blank = np.ones(len(data) + 2, bool)
    np.take(_BLANK, np.frombuffer(data, np.uint8), out=blank[1:-1])
    change = np.flatnonzero(blank[1:] != blank[:-1])
    return change[::2], change[1::2]


def pointers(data: bytes | np.ndarray, span: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The smallest q-grams of all windows of `span` symbols: their offsets, and the first and last window of each."""
    n, width = len(data), span - q + 1
    if n < span:
        none = np.zeros(0, np.int64)
        return none, none, none
    at, first, last = [], [], []
    for begin in range(0, n - span + 1, PIECE):
        part = data[begin : begin + PIECE + span - 1]
        hashes = Hashes(part)
        starts = np.arange(len(part) - q + 1)
        keys = (hashes.of(starts, starts + q) & ~_U((1 << 20) - 1)) | starts.astype(np.uint64)
        # minima of all runs of `width` keys, from minima of blocks from the left and from the right
        pad = -len(keys) % width
        blocks = np.concatenate((keys, np.full(pad, ~_U(0)))).reshape(-1, width)
        left = np.minimum.accumulate(blocks, axis=1).ravel()
        right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = len(part) - span + 1
        least = np.minimum(right[:windows], left[width - 1 : width - 1 + windows])
        found = (least & _U((1 << 20) - 1)).astype(np.int64)
        change = np.flatnonzero(np.diff(found)) + 1
        lo = np.concatenate(([0], change))
        at.append(found[lo] + begin)
        first.append(lo + begin)
        last.append(np.concatenate((change, [windows])) - 1 + begin)
    return np.concatenate(at), np.concatenate(first), np.concatenate(last)


def sparse_windows(starts: np.ndarray, ends: np.ndarray, n: int, span: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each range of windows of `span` bytes with under `sample` words inside, both ends of the window apart from words."""
    if n < span:
        return starts[:0], starts[:0]
    lo = np.concatenate(([0], starts))  # the windows whose first word inside is the i-th
    hi = np.concatenate((starts, [n])) - 1
    until = np.full(len(lo), n, np.int64)
    whole = max(0, len(ends) - sample + 1)
    until[:whole] = ends[sample - 1 :] - span
    hi = np.minimum(np.minimum(hi, until), n - span)
    some = lo <= hi
    return lo[some], hi[some]


class Rule:
    """What repeats: strings of `span` bytes and, with `words`, runs of that many words; dense=False leaves out strings of bytes with many words inside."""

    def __init__(self, span: int, words: int | None, dense: bool = True, bits: int = 64):
        self.span, self.words, self.dense = span, words, dense
        self.sample = max(4, span * SAMPLE // 400)
        if words:
            self.sample = min(self.sample, words)
        self.by_words = bool(words or dense)
        self.gram = max(1, self.sample // 4)
        self.q = span // 2
        self.lost = _U(64 - bits)

    def size(self, kind: int) -> int:
        return self.words if kind == OF_WORDS else self.span


class Source:
    """One text, with what the rounds ask of it."""

    def __init__(self, text: str, rule: Rule):
        self.data, self.rule = text.encode("utf-8", "surrogatepass"), rule
        self.starts, self.ends = word_bounds(self.data)
        self._bytes = self._symbols = self._joined = self._of_words = self._of_symbols = None

    @property
    def bytes(self) -> Hashes:
        if self._bytes is None:
            self._bytes = Hashes(self.data)
        return self._bytes

    @property
    def symbols(self) -> np.ndarray:
        if self._symbols is None:
            self._symbols = self.bytes.of(self.starts, self.ends)
        return self._symbols

    def pointers(self) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By words (True) or bytes: offsets, first and last windows, bucket identifiers of q-grams."""
        rule, out = self.rule, []
        if rule.by_words and len(self.starts) >= rule.sample:
            at, first, last = pointers(self.symbols, rule.sample, rule.gram)
            out.append((True, at, first, last, Hashes(self.symbols).of(at, at + rule.gram) >> rule.lost))
        lo, hi = sparse_windows(self.starts, self.ends, len(self.data), rule.span, rule.sample)
        if not rule.by_words or len(lo):
            at, first, last = pointers(self.data, rule.span, rule.q)
            if rule.by_words:  # the parts of each pointer's windows that are sparse
                low, high = np.searchsorted(hi, first), np.searchsorted(lo, last, "right")
                several = np.maximum(high - low, 0)
                of = np.repeat(np.arange(len(at)), several)
                part = low[of] + np.arange(len(of)) - np.repeat(np.cumsum(several) - several, several)
                at, first, last = at[of], np.maximum(first[of], lo[part]), np.minimum(last[of], hi[part])
            out.append((False, at, first, last, _mix(self.bytes.of(at, at + rule.q) + _U(1)) >> rule.lost))
        return out

    def windows(self, words: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(kind, which, place, first, last) of the windows for which pointers stand, each kind in its own units; bytes, or words for OF_WORDS."""
        rule = self.rule
        own = np.flatnonzero(~words)
        yield BY_BYTES, own, at[own], first[own], last[own]
        own = np.flatnonzero(words)
        at, first, last = at[own], first[own], last[own]
        if rule.words:
            end = np.minimum(last, len(self.starts) - rule.words)
            some = first <= end
            yield OF_WORDS, own[some], at[some], first[some], end[some]
        if rule.dense and len(own):
            begin = np.where(first > 0, self.starts[np.maximum(first - 1, 0)], 0)
            end = np.minimum(self.starts[last] - 1, len(self.data) - rule.span)
            some = begin <= end
            yield BY_WORDS, own[some], self.starts[at[some]], begin[some], end[some]

    def digests(self, kind: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """128-bit identifiers, as two columns, of the texts that tell windows of a kind apart, from start to end in its units; words are parted by single blanks."""
        data = self.data
        if kind == OF_WORDS:
            if self._joined is None:
                self._joined = b" ".join(self.data.split())
                self._of_words = np.concatenate(([0], np.cumsum(self.ends - self.starts + 1)))
            data, start, end = self._joined, self._of_words[start], self._of_words[end] - 1
        salt = b"%d" % kind
        found = b"".join([blake2b(data[i:j], digest_size=16, salt=salt).digest() for i, j in zip(start.tolist(), end.tolist(), strict=True)])
        return np.frombuffer(found, "<i8").reshape(-1, 2)

    def range(self, kind: int, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that windows first to last cover."""
        if kind == OF_WORDS:
            return self.starts[first], self.ends[last + self.rule.words - 1]
        return first, last + self.rule.span

    def cores(self, kind: int, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first and last windows of the parts of PART windows of each pointer, and identifiers of the texts that all windows of a part have."""
        least = (at - last) // PART * PART  # parts are cut by the distance to the pointer, so that those of different texts agree
        several = (at - first - least) // PART + 1
        of = np.repeat(np.arange(len(at)), several)
        low = least[of] + PART * (np.arange(len(of)) - np.repeat(np.cumsum(several) - several, several))
        if kind == OF_WORDS and self._of_symbols is None:
            self._of_symbols = Hashes(self.symbols)
        hashes = self._of_symbols if kind == OF_WORDS else self.bytes
        start = at[of] - low
        core = hashes.of(start, start + max(1, self.rule.size(kind) - PART + 1))
        return np.maximum(first[of], start - PART + 1), np.minimum(last[of], start), _mix(core + (low * 3 + kind).astype(np.uint64)) >> self.rule.lost


class _Columns:
    """Gathers arrays of columns and gives them out as Arrow batches."""

    def __init__(self, ddl: str, size: int = 20_000):
        types = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
        self.schema = pa.schema([(name, types[kind]) for name, kind in (c.split() for c in ddl.split(", "))])
        self._size, self._held, self._n = size, [], 0

    def add(self, n: int, *columns) -> Iterator[pa.RecordBatch]:
        """n rows; columns are arrays or single values."""
        if n:
            self._held.append([c if isinstance(c, np.ndarray) else np.full(n, c) for c in columns])
            self._n += n
        if self._n >= self._size:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self._held:
            columns = [pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*self._held, strict=True), self.schema, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=self.schema)
            self._held, self._n = [], 0


def _sources(batches: Iterator, rule: Rule, *columns: str) -> Iterator[tuple]:
    """(k, t, source, arrays of the refs' columns) of each row."""
    for batch in batches:
        refs = batch.column("refs")
        offsets, values = refs.offsets.to_numpy(), refs.values
        held = [values.field(c).to_numpy(zero_copy_only=False) for c in columns]
        for i, (k, t, text) in enumerate(rows(iter([batch]), "k", "t", "text")):
            own = slice(offsets[i], offsets[i + 1])
            yield k, t, Source(text, rule), [c[own] for c in held]


POINTERS = "k long, t int, words boolean, at int, first int, last int, gram long"
COVERS = "k long, t int, kind int, gram long, at int, first int, last int, lo int, hi int, d0 long, d1 long"
PARTS = "k long, t int, kind int, core long, first int, last int"
WINDOWS = "k long, t int, kind int, lo int, hi int, d0 long, d1 long"


def _pointer_rows(batches: Iterator, rule: Rule) -> Iterator:
    out = _Columns(POINTERS)
    for k, t, text in rows(batches, "k", "t", "text"):
        for words, at, first, last, gram in Source(text, rule).pointers():
            yield from out.add(len(at), k, t, words, at, first, last, gram.view(np.int64))
    yield from out.rest()


def _cover_rows(batches: Iterator, rule: Rule) -> Iterator:
    """For each pointer that goes on, and each kind of windows, what they cover."""
    out = _Columns(COVERS)
    for k, t, source, (words, at, first, last, gram) in _sources(batches, rule, "words", "at", "first", "last", "gram"):
        for kind, which, place, lo, hi in source.windows(words.astype(bool), at, first, last):
            digest = source.digests(kind, lo, hi + rule.size(kind))
            yield from out.add(len(lo), k, t, kind, gram[which], place, lo, hi, *source.range(kind, lo, hi), digest[:, 0], digest[:, 1])
    yield from out.rest()


def _core_rows(batches: Iterator, rule: Rule) -> Iterator:
    out = _Columns(PARTS)
    for k, t, source, (kinds, *refs) in _sources(batches, rule, "kind", "at", "first", "last"):
        for kind in np.unique(kinds).tolist():
            first, last, core = source.cores(kind, *[c[kinds == kind].astype(np.int64) for c in refs])
            yield from out.add(len(core), k, t, kind, core.view(np.int64), first, last)
    yield from out.rest()


def _window_rows(batches: Iterator, rule: Rule) -> Iterator:
    out = _Columns(WINDOWS)
    for k, t, source, (kinds, first, last) in _sources(batches, rule, "kind", "first", "last"):
        for kind in np.unique(kinds).tolist():
            own = kinds == kind
            p = np.concatenate([np.arange(a, b + 1) for a, b in zip(first[own].tolist(), last[own].tolist(), strict=True)])
            digest = source.digests(kind, p, p + rule.size(kind))
            yield from out.add(len(p), k, t, kind, *source.range(kind, p, p), digest[:, 0], digest[:, 1])
    yield from out.rest()


def _runs(ranges: np.ndarray) -> np.ndarray:
    """The maximal runs that ranges (k, t, words, lo, hi) cover, both in columns ordered by all but hi."""
    k, t, words, lo, hi = ranges
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1]) | (words[1:] != words[:-1])
    base = np.cumsum(new) << 32  # a text's ends are under 2 ** 31, so the maxima of each group stay its own
    most = np.maximum.accumulate(base + hi) - base
    new[1:] |= lo[1:] > most[:-1]
    at = np.flatnonzero(new)
    return np.stack([k[at], t[at], words[at], lo[at], most[np.append(at[1:], len(k))[: len(at)] - 1]])


def _lists(runs: np.ndarray) -> Iterator[tuple]:
    """(k, t, runs of bytes, runs of words) of each text."""
    k, t, words, lo, hi = runs.tolist()
    cuts = np.flatnonzero((runs[0, 1:] != runs[0, :-1]) | (runs[1, 1:] != runs[1, :-1])) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(k)], strict=True) if k else ():
        found = [[{"start": lo[i], "end": hi[i]} for i in range(a, b) if words[i] == kind] for kind in (0, 1)]
        yield k[a], t[a], *found


def _merged(batches: Iterator) -> Iterator:
    """Of each text the maximal runs of bytes that repeated windows cover, of bytes and of words; rows come in the order of _runs()."""
    held = np.zeros((5, 0), np.int64)
    for batch in batches:
        rows_ = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("k", "t", "words", "lo", "hi")])
        held = _runs(np.concatenate((held, rows_), axis=1))
        if held.size:  # the last text may go on
            last = (held[0] == held[0, -1]) & (held[1] == held[1, -1])
            yield from _lists(held[:, ~last])
            held = held[:, last]
    yield from _lists(held)


def _with_refs(texts: DataFrame, refs: DataFrame, *columns: str) -> DataFrame:
    """The texts(k, t, text) that refs names, each with the list of its refs; equal rows have one list."""
    dealt = refs.select(F.col("k").alias("rk"), F.col("t").alias("rt"), *columns).repartition("rk", "rt")  # lists are made once, where they stay
    listed = dealt.groupBy("rk", "rt").agg(F.collect_set(F.struct(*columns)).alias("refs"))
    return texts.join(listed, (F.col("k") == F.col("rk")) & (F.col("t") == F.col("rt"))).select("k", "t", "text", "refs")


def _of(df: DataFrame, run: Callable[[Iterator, Rule], Iterator], rule: Rule, ddl: str, name: str) -> DataFrame:
    return written(df.mapInArrow(lambda b: run(b, rule), ddl), name)


def _several(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """The keys that several rows have, under other names; a written table, so that a join with it has exchanges of its own, whose hot keys can be split.

    The shuffle of the count is deleted before df goes through another one.
    """
    out = written(df.groupBy(*keys).count().where("count > 1").select(*[F.col(k).alias(k + "_") for k in keys]), name)
    sweep(df.sparkSession)
    return out


def _semi(df: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of df with one of keys; these are fewer and are hashed, so that df's rows need no sort."""
    on = [F.col(c[:-1]) == F.col(c) for c in keys.columns]
    return df.join(keys.hint("shuffle_hash"), on, "left_semi")


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def repeated_runs(texts: DataFrame, rule: Rule) -> DataFrame:
    """(k, t, of_bytes, of_words): of texts(k, t, text) that have any, the runs of bytes that repeated windows cover."""
    found = _of(texts, _pointer_rows, rule, POINTERS, "pointers")
    grams = _several(found, "grams", "gram")
    held = written(_with_refs(texts, _semi(found, grams), "words", "at", "first", "last", "gram"), "held-texts")
    forget(found, grams)
    texts, wholes, splits = held.select("k", "t", "text"), [], []
    ranges = lambda df: df.select("k", "t", "kind", "lo", "hi")
    for turn in range(TURNS):
        own = F.filter("refs", lambda r: F.pmod(r["gram"], F.lit(TURNS)) == turn)  # noqa: B023  # used in this turn only
        covers = _of(held.withColumn("refs", own).where(F.size("refs") > 0), _cover_rows, rule, COVERS, "covers")
        head = [F.first(c).alias(c) for c in ("k", "t", "at", "first", "last")]  # whichever row is met first, one for all columns
        heads = written(covers.groupBy("kind", "gram", "d0", "d1").agg(F.count("*").alias("n"), *head), "heads")
        sweep(texts.sparkSession)
        repeated = written(heads.where("n > 1").select(F.col("d0").alias("d0_"), F.col("d1").alias("d1_")), "covers-repeated")
        wholes.append(written(ranges(_semi(covers, repeated)), "whole"))
        forget(covers, repeated)
        split = _several(heads, "grams-split", "kind", "gram")
        splits.append(written(_semi(heads, split).select("k", "t", "kind", "at", "first", "last"), "heads-split"))
        forget(heads, split)
    parts = _of(_with_refs(texts, _all(splits), "kind", "at", "first", "last"), _core_rows, rule, PARTS, "parts")
    forget(*splits)
    cores = _several(parts, "cores", "kind", "core")
    left = written(_semi(parts, cores), "parts-left")
    forget(parts, cores)
    for turn in range(TURNS):
        own = left.where(F.pmod("core", F.lit(TURNS)) == turn)
        windows = _of(_with_refs(texts, own, "kind", "first", "last"), _window_rows, rule, WINDOWS, "windows")
        again = _several(windows, "windows-again", "d0", "d1")
        wholes.append(written(ranges(_semi(windows, again)), "windows-repeated"))
        forget(windows, again)
    forget(held, left)
    order = ("k", "t", "words", "lo")
    listed = _all(wholes).select("k", "t", (F.col("kind") == OF_WORDS).cast("int").alias("words"), "lo", "hi").repartition("k", "t").sortWithinPartitions(*order)
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    kinds = pa.schema([("k", pa.int64()), ("t", pa.int32()), ("of_bytes", spans), ("of_words", spans)])
    ddl = "k long, t int, of_bytes array<struct<start: int, end: int>>, of_words array<struct<start: int, end: int>>"
    out = written(listed.mapInArrow(lambda b: batched(_merged(b), kinds, 512), ddl), "spans")
    forget(*wholes)
    return out


def _key(docs: DataFrame, id_col: str, text_col: str) -> tuple:
    """The key of a row: its id (a hash of other than whole numbers and of rows without one), and a hash of its text."""
    own, text = docs[id_col], docs[text_col]
    k = own.cast("long") if isinstance(docs.schema[id_col].dataType, IntegralType) else F.xxhash64(own)
    return F.coalesce(k, F.xxhash64(text)), F.hash(text)


def with_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 400, to: str = "spans", words: int | None = None, dense: bool = True, bits: int = 64,
) -> DataFrame:
    """docs and the column `to`: array<struct<start, end>>, the maximal runs of UTF-8 bytes that strings of `span` bytes cover which also begin anywhere else.

    With `words`, the column `{to}_words` has the same for runs of that many words, whatever is between
    them. dense=False leaves out of `to` all but strings of `span` bytes with few words inside.
    Both are null in texts without any of the two. Matches do not cross texts; overlaps count, and a
    text's own repeats. Texts shorter than that, empty and null ones have none. Equal rows repeat each
    other. `bits`, of the identifiers that only decide what goes on, changes the work but not the result.
    """
    rule = Rule(span, words, dense, bits)
    key, print_ = fresh(docs, "span_key"), fresh(docs, "span_print")
    k, t = _key(docs, id_col, text_col)
    own = docs.select(k.alias("k"), t.alias("t"), docs[text_col].alias("text")).where("text is not null")
    spans = repeated_runs(own, rule)
    columns = [F.col("of_bytes").alias(to), *([F.col("of_words").alias(f"{to}_words")] if words else [])]
    spans = spans.select(F.col("k").alias(key), F.col("t").alias(print_), *columns)
    return docs.join(spans, (k == F.col(key)) & (t == F.col(print_)), "left").drop(key, print_)


def kept_bytes(text, spans):
    """The UTF-8 bytes of a text column outside spans, joined; all of them where spans is null; none for null texts."""
    data = F.coalesce(text, F.lit("")).cast("binary")
    edges = F.concat(F.array(F.lit(0)), F.flatten(F.transform(spans, lambda s: F.array(s["start"], s["end"]))), F.array(F.length(data)))
    gaps = F.transform(F.sequence(F.lit(0), F.size(spans)), lambda i: F.struct(F.get(edges, 2 * i).alias("start"), F.get(edges, 2 * i + 1).alias("end")))
    cut = F.aggregate(gaps, F.lit("").cast("binary"), lambda done, g: F.concat(done, F.substring(data, g["start"] + 1, g["end"] - g["start"])))
    return F.when(spans.isNull(), data).otherwise(cut)


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 400, words: int | None = None) -> DataFrame:
    """(doc_id, text, spans, kept binary) of every row; with `words` also spans_words, which nothing is cut by."""
    own = columns_of(docs, [(id_col, "doc_id"), (text_col, "text")])
    found = with_spans(own, span=span, words=words)
    return found.select("doc_id", "text", "spans", *(["spans_words"] if words else []), kept_bytes(F.col("text"), F.col("spans")).alias("kept"))


def drop_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", span: int = 400, words: int | None = None, dense: bool = True,
) -> DataFrame:
    """docs with the repeated passages cut out of their texts; chars_col, if docs has it, is counted anew.

    Passages are those of with_spans(): repeated strings of `span` bytes and, with `words`, repeated
    runs of that many words. A character of which a passage covers a part only goes too. Every row
    stays, if without text; null texts stay null.
    """
    to = fresh(docs, "spans")
    found = with_spans(docs, id_col, text_col, span, to, words, dense)
    of_words = F.col(f"{to}_words") if words else F.col(to)
    out = found.withColumn(text_col, F.when(F.col(to).isNull(), F.col(text_col)).otherwise(_outside(text_col, to, of_words)))
    if chars_col in docs.columns:
        out = out.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType))
    return out.select(*docs.columns)


@F.pandas_udf(StringType())
def _outside(text: pd.Series, spans: pd.Series, more: pd.Series) -> pd.Series:
    """Of texts with spans what lies outside them and more; other rows' values are not used."""

    def one(value: str | None, *lists: np.ndarray | None) -> str | None:
        if value is None or lists[0] is None:
            return None
        data, at, out = value.encode("utf-8", "surrogatepass"), 0, []
        for start, end in sorted((s["start"], s["end"]) for found in lists for s in found):
            out.append(data[at : max(at, start)])
            at = max(at, end)
        return b"".join([*out, data[at:]]).decode("utf-8", "ignore")

    return pd.Series([one(*x) for x in zip(text, spans, more, strict=True)], dtype=object)
