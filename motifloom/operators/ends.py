"""Similarities by ends: a sequence's front and back are one of 8,000 codes each, so tables of distinct ends are scored, not of sequences."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from motifloom.functions.alphabet import ALPHABET, SIZE, residue_similarities
from motifloom.operators.nodes import COLUMN_PAIRS, terminal_codes
from motifloom.operators.tables import stored

#: Codes of three residues; any table of distinct ends is this long at most.
ENDS = SIZE**3


def end_code(t: Column, back: bool) -> Column:
    """Three terminal codes of one end as one number."""
    a, b, c = (F.get(t, F.lit(k + 3 * back)) for k in range(3))
    return ((a * SIZE + b) * SIZE + c).cast("int")


def _residues(end: np.ndarray) -> list[np.ndarray]:
    return [end // SIZE**2, end // SIZE % SIZE, end % SIZE]


_TABLE = np.array(residue_similarities(), np.int16)


#: The place of a residue in byte order.
_BYTES = np.argsort(np.argsort([ord(c) for c in ALPHABET]))


def in_bytes(front: np.ndarray) -> np.ndarray:
    """The place of fronts in byte order, in which nodes are numbered."""
    a, b, c = (_BYTES[r] for r in _residues(front))
    return (a * SIZE + b) * SIZE + c


def similar(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The similarity of ends in thousandths: the mean of their residues', not under zero, not over 1000."""
    total = sum(_TABLE[a * SIZE + b].astype(np.int32) for a, b in zip(_residues(x), _residues(y), strict=True))
    return np.minimum(1000, np.maximum(0, total) // 3)


def closest(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The largest similarity of a residue of one end and one of the other."""
    return np.max([_TABLE[a * SIZE + b] for a in _residues(x) for b in _residues(y)], axis=0).astype(np.int32)


def seeded(seed: str) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of ends: the largest seed score of a dimer of one and one of the other, in thousandths."""

    def of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        xs, ys, best = _residues(x), _residues(y), np.full(np.broadcast(x, y).shape, -4000, np.int32)
        pairs = COLUMN_PAIRS[seed]
        alike = {(i, j): _TABLE[xs[i] * SIZE + ys[j]].astype(np.int32) for i in range(3) for j in range(3)}
        for p in pairs:
            for q in pairs:
                np.maximum(best, alike[p[0], q[0]] + alike[p[1], q[1]], out=best)
        return np.where(best >= 0, (best + 1) // 2, -((1 - best) // 2))

    return of


def seed_hits(seed: str, threshold: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of ends: how many pairs of a distinct dimer of one and a distinct dimer of the other are similar."""
    pairs, at = COLUMN_PAIRS[seed], round(threshold * 1000)

    def new(r: list[np.ndarray], k: int) -> np.ndarray:
        out = np.ones(r[0].shape, bool)
        for i, j in pairs[:k]:
            out &= (r[pairs[k][0]] != r[i]) | (r[pairs[k][1]] != r[j])
        return out

    def of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        xs, ys = ([np.asarray(r) for r in _residues(e)] for e in (x, y))
        total = np.zeros(np.broadcast(x, y).shape, np.int32)
        for p, (a, b) in enumerate(pairs):
            for q, (c, d) in enumerate(pairs):
                s = _TABLE[xs[a] * SIZE + ys[c]].astype(np.int32) + _TABLE[xs[b] * SIZE + ys[d]]
                half = np.where(s >= 0, (s + 1) // 2, -((1 - s) // 2))
                total += (half >= at) & new(xs, p) & new(ys, q)
        return total

    return of


def scored(of: Callable[[np.ndarray, np.ndarray], np.ndarray], x: Column, y: Column) -> Column:
    """A function of ends over two columns, in Arrow batches."""

    @F.pandas_udf(IntegerType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(of(a.to_numpy(np.int64), b.to_numpy(np.int64)).astype(np.int32))

    return run(x, y)


def end_scores(xs: DataFrame, ys: DataFrame, least: dict[str, int], **of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(x, y, and a score each name in `of`): pairs of ends of xs(x) and ys(y) whose scores are all at least `least`; 64,000,000 rows at most, whatever the inputs."""
    held = np.array([r.y for r in ys.select("y").distinct().collect()], np.int64)  # 8,000 at most

    def run(batches):
        for df in batches:
            for x in df["x"]:
                found = {name: f(np.int64(x), held) for name, f in of.items()}
                ok = np.ones(len(held), bool)
                for name, at in least.items():
                    ok &= found[name] >= at
                yield pd.DataFrame({"x": np.full(ok.sum(), x, np.int32), "y": held[ok].astype(np.int32)} | {name: v[ok].astype(np.int32) for name, v in found.items()})

    parts = int(xs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return xs.select("x").distinct().repartition(parts, "x").mapInPandas(run, ", ".join(f"{c} int" for c in ("x", "y", *of)))


def similarity_histogram(test: DataFrame, train: DataFrame) -> DataFrame:
    """(sequence, similarity, n): of each distinct test sequence, how many rows of train(sequence) have which terminal similarity to it.

    Training rows are counted by both ends; for each test front these counts are added up by the front's
    similarity and the training back; only these sums meet the test backs. So no step makes a row for a pair
    of sequences: at most fronts x similarities x backs. No rows where either table is empty.
    """
    t = terminal_codes(F.col("sequence"))
    ends = stored(train.groupBy(end_code(t, False).alias("y"), end_code(t, True).alias("train_back")).agg(F.count("*").alias("n")), "train-ends")
    asked = stored(test.select("sequence", end_code(t, False).alias("front"), end_code(t, True).alias("back")).distinct(), "test-ends")
    fronts = end_scores(asked.select(F.col("front").alias("x")), ends, {}, front_score=similar)
    half = ends.join(fronts, "y").groupBy(F.col("x").alias("front"), "front_score", "train_back").agg(F.sum("n").alias("n"))
    met = asked.select("front", "back").distinct().join(half, "front")
    met = met.withColumn("back_score", scored(similar, F.col("back"), F.col("train_back")))
    mean = F.floor((F.col("front_score") + F.col("back_score") + 1) / 2).cast("int")
    found = met.groupBy("front", "back", mean.alias("similarity")).agg(F.sum("n").alias("n"))
    return asked.join(found, ["front", "back"]).select("sequence", "similarity", "n")


def paired(shapes: DataFrame, near: DataFrame, *keep: str) -> DataFrame:
    """(a, b, ...): pairs of shapes(shape, front, back, ...), each once, also of a shape and itself, whose fronts are in near(x, y, ...); a and b are structs of shape, back and what is kept."""
    side = lambda of, to: shapes.select(F.col("front").alias(to), F.struct("shape", "back", *keep).alias(of))
    return near.join(side("a", "x"), "x").join(side("b", "y"), "y").where("a.shape <= b.shape")


def of_shapes(pairs: DataFrame, shaped: DataFrame) -> DataFrame:
    """(u, v), u < v: the pairs of nodes of pairs(sa, sb) of shapes; shaped has node_id and shape."""
    of = lambda s, to: shaped.select(F.col("shape").alias(s), F.col("node_id").alias(to))
    met = pairs.join(of("sa", "i"), "sa").join(of("sb", "j"), "sb").where("sa != sb or i < j")
    return met.select(F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v"))
