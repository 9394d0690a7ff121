"""Packing by shortest-pack-first over the histogram of lengths."""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from motifloom.llm.common import columns_of, written
from motifloom.llm.tokens import batched, rows, tokenizer

Pattern = tuple[tuple[int, int], ...]


def patterns(histogram: dict[int, int], room: int) -> list[tuple[Pattern, int]]:
    """Packs lengths 1 to `room`, given how many pieces have each, into patterns: ((length, times), ...) and how many sequences have it.

    Longest lengths first: each piece goes to the shortest pack, if it fits there, else opens one.
    All packs of one pattern get their piece at once, so work is by length and pattern, not by piece.
    """
    packs: dict[int, list[list]] = defaultdict(list)  # open packs by the room that they have left
    rooms: list[int] = []  # those rooms, negative, as a heap
    done: list[tuple[Pattern, int]] = []

    def put(pattern: Pattern, length: int, left: int, n: int) -> None:
        last = pattern[-1] if pattern else (0, 0)
        pattern = (*pattern[:-1], (length, last[1] + 1)) if last[0] == length else (*pattern, (length, 1))
        if not left:
            done.append((pattern, n))
            return
        if not packs[left]:
            heapq.heappush(rooms, -left)
        packs[left].append([pattern, n])

    for length in range(room, 0, -1):
        n = histogram.get(length, 0)
        while n:
            while rooms and not packs[-rooms[0]]:
                heapq.heappop(rooms)
            if not rooms or -rooms[0] < length:
                # none is open that has room: new packs, as many as take the rest when filled evenly
                new = -(-n // (room // length))
                put((), length, room - length, new)
                n -= new
                continue
            left = -rooms[0]
            pattern, have = packs[left].pop()
            take = min(have, n)
            if have > take:
                packs[left].append([pattern, have - take])
            put(pattern, length, left - length, take)
            n -= take
    return done + [(p, n) for held in packs.values() for p, n in held]


def slots(found: list[tuple[Pattern, int]]) -> dict[int, np.ndarray]:
    """By length the rows (first rank, sequence of that rank, times, offset), by which the rank of a piece tells its place."""
    at: dict[int, int] = defaultdict(int)
    out: dict[int, list] = defaultdict(list)
    sequence = 0
    for pattern, n in found:
        offset = 0
        for length, times in pattern:
            out[length].append((at[length], sequence, times, offset))
            at[length] += n * times
            offset += length * times
        sequence += n
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pieces(docs: DataFrame, tokenizer_path: str, room: int, end: tuple[int, ...] = (), id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Every text's ids (null: empty) and end ids, cut into full sequences of `room` ids and a rest.

    One row a piece: doc_id, doc_key (a hash of id and text), start, length, ids_crc32, doc_tokens, and ids if asked for.
    """
    names = ("doc_id", "doc_key", "start", "length", "ids_crc32", "doc_tokens")
    schema = pa.schema([(c, pa.int64()) for c in names] + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches: Iterator) -> Iterator:
        t, tail = tokenizer(tokenizer_path), np.array(end, "<u4").tobytes()

        def one():
            for doc, key, text in rows(batches, "doc_id", "doc_key", "text"):
                ids = t.encode(text) + tail
                n = len(ids) // 4
                for start in range(0, n, room):
                    part = ids[4 * start : 4 * (start + room)]
                    row = doc, key, start, len(part) // 4, zlib.crc32(part), n
                    yield row + (np.frombuffer(part, "<u4").tolist(),) * with_ids

        yield from batched(one(), schema, 256 if with_ids else 4096)

    own = columns_of(docs, [(id_col, "doc_id"), (text_col, "text")]).select("doc_id", F.xxhash64("doc_id", "text").alias("doc_key"), "text")
    return own.mapInArrow(run, ", ".join(f"{c} long" for c in names) + ", ids array<int>" * with_ids)


def pack(cut: DataFrame, room: int, salts: int = 512) -> DataFrame:
    """cut, the rows of pieces(), with sequence_id and offset: each sequence has at most `room` ids, without gaps from 0.

    The histogram has at most `room` lengths, so patterns are made on the driver whatever the
    corpus; they have at most 2 x room entries. Pieces of a length are ranked in `salts` parts, by
    a hash of the document, and the parts' counts are summed, so that a length that a third of
    all pieces have is not ranked in one task. Pieces of no ids do not exist: a document without
    ids and end ids has no row.
    """
    cut = written(cut, "pieces")
    part = F.pmod(F.xxhash64("doc_key", "start"), F.lit(salts))
    counts = written(cut.groupBy("length", part.alias("part")).agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    place = slots(patterns(histogram, room))
    earlier = F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")
    begins = counts.select(F.col("length").alias("l"), F.col("part").alias("p"), earlier.alias("earlier"))
    order = [c for c in ("doc_key", "start", "doc_id") if c in cut.columns]
    ranked = cut.withColumn("_part", part)
    ranked = ranked.withColumn("_own", F.row_number().over(W.partitionBy("length", "_part").orderBy(*order)) - 1)
    ranked = ranked.join(begins, (F.col("length") == F.col("l")) & (F.col("_part") == F.col("p")))
    ranked = ranked.withColumn("_rank", F.col("earlier") + F.col("_own"))
    kept = cut.columns

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length, rank):
        import pandas as pd

        lengths, ranks = length.to_numpy(), rank.to_numpy()
        out = np.zeros((len(ranks), 2), np.int64)
        order = np.argsort(lengths, kind="stable")
        bounds = np.flatnonzero(np.diff(lengths[order])) + 1
        for own in np.split(order, bounds):
            if len(own):
                size = int(lengths[own[0]])
                table = place[size]
                at = table[np.searchsorted(table[:, 0], ranks[own], "right") - 1]
                beyond = ranks[own] - at[:, 0]
                out[own, 0] = at[:, 1] + beyond // at[:, 2]
                out[own, 1] = at[:, 3] + beyond % at[:, 2] * size
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    return ranked.withColumn("_at", placed("length", "_rank")).select(*kept, "_at.sequence_id", "_at.offset")
