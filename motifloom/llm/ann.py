"""Nearest neighbours by largest inner product, with collision-counting hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from motifloom.llm.common import columns_of, written
from motifloom.llm.tokens import batched, rows


def _valid(batches: Iterator) -> Iterator:
    """The ids and vectors (as bytes of doubles) that take part, and their squared norm."""
    schema = pa.schema([("vec_id", pa.int64()), ("vec", pa.binary()), ("dims", pa.int32()), ("norm2", pa.float64())])

    def one():
        for vec_id, values in rows(batches, "vec_id", "embedding"):
            if vec_id is None or not values or any(v is None for v in values):
                continue
            v = np.array(values, np.float64) + 0.0  # no negative zeros: equal vectors have equal bytes
            norm2 = float(v @ v)
            if np.isfinite(v).all() and v.any() and np.isfinite(norm2):
                yield vec_id, v.tobytes(), len(v), norm2

    yield from batched(one(), schema, 1024)


def _smallest_ids(batches: Iterator, most: int) -> Iterator:
    """By vector the `most` smallest ids of a part of the table."""
    schema = pa.schema([("vec", pa.binary()), ("dims", pa.int32()), ("ids", pa.list_(pa.int64()))])
    kept: dict[tuple[bytes, int], list[int]] = {}
    for vec_id, vec, dims in rows(batches, "vec_id", "vec", "dims"):
        ids = kept.setdefault((vec, dims), [])
        ids.append(vec_id)
        if len(ids) >= 4 * most:
            ids[:] = sorted(set(ids))[:most]
    yield from batched(((vec, dims, sorted(set(ids))[:most]) for (vec, dims), ids in kept.items()), schema, 1024)


class Projections:
    """Sorted arrays of a block of vectors, one for each single projection, for queries by collision counting.

    Vectors get a further component that makes all norms equal to `top`, queries a zero, so that the
    largest inner product is the smallest distance. All are projected on `m` directions.
    """

    def __init__(self, vectors: np.ndarray, top: float, m: int, seed: int):
        d = vectors.shape[1] + 1
        rng = np.random.default_rng(seed)
        frames = [np.linalg.qr(rng.normal(size=(d, d)))[0] for _ in range(-(-m // d))]
        self._axes = np.concatenate(frames, 1)[:, :m] * np.sqrt(d)
        rest = np.sqrt(np.maximum(0.0, top * top - np.einsum("ij,ij->i", vectors, vectors)))
        self.vectors = vectors
        at = np.column_stack((vectors, rest)) / top @ self._axes
        order = np.argsort(at, axis=0, kind="stable")
        self._sorted = np.take_along_axis(at, order, 0).T.copy()
        # each vector's place in each sorted array, so that a window is a range of places
        self._places = np.empty(at.T.shape, np.uint16)
        np.put_along_axis(self._places, order.T, np.arange(len(at), dtype=np.uint16)[None], 1)

    def candidates(self, query: np.ndarray, need: int, share: float, grow: float) -> np.ndarray:
        """The vectors that collide with the query in `share` of the projections or more.

        The windows around the query's projections start at 1.22 times the median distance and grow
        by `grow` (virtual rehashing) until `need` vectors do, or all.
        """
        m, n = self._sorted.shape
        at = np.append(query / np.linalg.norm(query), 0.0) @ self._axes
        least = int(np.ceil(share * m))
        half = 1.22 * float(np.median(np.abs(self._sorted[:, :: max(1, n // 64)] - at[:, None])))
        need = min(need, n)
        shifted, inside = np.empty(n, np.uint16), np.empty(n, bool)
        hit = inside.view(np.uint8)
        while half:
            low = [int(s.searchsorted(a - half)) for s, a in zip(self._sorted, at, strict=True)]
            high = [int(s.searchsorted(a + half, "right")) for s, a in zip(self._sorted, at, strict=True)]
            counts = np.zeros(n, np.uint8)
            for places, a, b in zip(self._places, low, high, strict=True):
                if a < b:
                    np.subtract(places, np.uint16(a), out=shifted)  # places before the window wrap around
                    np.less_equal(shifted, np.uint16(b - a - 1), out=inside)
                    np.add(counts, hit, out=counts)
            found = np.flatnonzero(counts >= least)
            if len(found) >= need:
                return found
            if not any(low) and all(b == n for b in high):
                break
            half *= grow
        return np.arange(n)


def search(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20, m: int = 64, share: float = 0.8, grow: float = 1.1,
    verify: float = 0.055, seed: int = 17, block: int = 16_384, query_block: int = 1024,
) -> DataFrame:
    """For each vector whose id is divisible by `every` the k other rows with the largest inner product that are found.

    Returns query_id, rank (from 1), vec_id, score (the inner product in doubles), nearest first, ties
    to the smaller vec_id. Vectors that are null, empty, zero, or hold null or non-finite components take no
    part, nor do null ids or vectors of another length than the query's. Of rows that repeat an id
    and its vector one takes part.

    Equal vectors are one in the search: what it needs of their ids is the k + 1 smallest. They are
    dealt to blocks of about `block`, each with its sorted projections, which every block of queries
    visits (the set of queries is fixed by the ids); each query verifies `verify` of a block at least,
    those with the most collisions.
    """
    own = columns_of(vectors, [(id_col, "vec_id"), (vector_col, "embedding")])
    own = own.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    valid = written(own.mapInArrow(_valid, "vec_id long, vec binary, dims int, norm2 double"), "vectors")
    partial = valid.mapInArrow(lambda b: _smallest_ids(b, k + 1), "vec binary, dims int, ids array<long>")
    kinds = partial.groupBy("vec", "dims").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
    kinds = written(kinds, "vector-kinds")
    n, top = kinds.count(), valid.agg(F.max("norm2")).first()[0]
    top = float(np.sqrt(top)) if top else 1.0
    queries = valid.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "vec", "dims").distinct()
    asked = written(queries.select("vec", "dims").distinct(), "query-vectors")
    if block > 1 << 15 or m > 255:
        raise ValueError("places in a block are 16-bit numbers, collisions 8-bit ones")
    n_blocks, q_blocks = max(1, -(-n // block)), max(1, -(-asked.count() // query_block))
    spread = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    data = kinds.select("vec", "dims", "ids", F.pmod(F.xxhash64("vec"), F.lit(n_blocks)).cast("int").alias("b"), spread(q_blocks).alias("q"))
    ask = asked.select("vec", "dims", F.pmod(F.xxhash64("vec", F.lit(1)), F.lit(q_blocks)).cast("int").alias("q"), spread(n_blocks).alias("b"))

    def visit(key, held: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out_q, out_id, out_s = [], [], []
        if len(held) and len(asking):
            x = np.frombuffer(b"".join(held["vec"]), np.float64).reshape(len(held), -1)
            index = Projections(x, top, m, seed)
            ids = held["ids"].tolist()
            need = int(verify * len(held)) + k + 1
            for vec in asking["vec"]:
                query = np.frombuffer(vec, np.float64)
                found = index.candidates(query, need, share, grow)
                scores = x[found] @ query
                if len(found) > k + 1:  # all that may be among the k + 1 nearest, ties included
                    keep = scores >= np.partition(scores, -(k + 1))[-(k + 1)]
                    found, scores = found[keep], scores[keep]
                near = sorted((-s, i) for f, s in zip(found.tolist(), scores.tolist(), strict=True) for i in ids[f])[: k + 1]
                out_q += [vec] * len(near)
                out_id += [i for _, i in near]
                out_s += [-s for s, _ in near]
        return pd.DataFrame({"vec": out_q, "vec_id": np.array(out_id, np.int64), "score": np.array(out_s, np.float64)})

    met = data.groupBy("dims", "b", "q").cogroup(ask.groupBy("dims", "b", "q")).applyInPandas(visit, "vec binary, vec_id long, score double")
    best = W.partitionBy("vec").orderBy(F.desc("score"), "vec_id")
    near = met.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).select(F.col("vec").alias("of"), "vec_id", "score")
    pairs = queries.select(F.col("vec_id").alias("query_id"), "vec").join(near, F.col("vec") == F.col("of")).where("query_id != vec_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
