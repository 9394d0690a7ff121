"""Benchmark pools: folds, quotas by group, compatible labels, balanced samples; draws are by hash, so that they repeat."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from motifloom.operators import cover


def draw(*key: str, seed: int) -> Column:
    """A pseudo-random order by the MD5 of a seed and a key."""
    return F.md5(F.concat_ws("/", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))


def folds(labels: DataFrame, label: str, stratum: Column, n: int, seed: int) -> DataFrame:
    """labels with `fold`, 0 to n - 1: dealt in turn within each stratum, in drawn order."""
    order = W.partitionBy(stratum).orderBy(draw(label, seed=seed), label)
    return labels.withColumn("fold", (F.row_number().over(order) - 1) % n)


def quota(rows: DataFrame, by: list[str], key: str, most: int | Column, seed: int) -> DataFrame:
    """Of each group the first `most` keys in drawn order, a number or a column of the group."""
    order = W.partitionBy(*by).orderBy(draw(key, seed=seed), key)
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def balanced(pairs: DataFrame, seed: int, jitter: float = 0.05) -> DataFrame:
    """pairs(pool, member, label) with as many members of each label as the pool's smallest has, give or take `jitter` by label."""
    sizes = pairs.groupBy("pool", "label").agg(F.count("*").alias("_size"))
    least = F.min("_size").over(W.partitionBy("pool"))
    share = F.conv(F.substring(draw("pool", "label", seed=seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
    wanted = sizes.withColumn("_want", F.greatest(F.lit(1), F.least(F.col("_size"), F.round(least * (1 + F.lit(jitter) * (2 * share - 1))).cast("long"))))
    return quota(pairs.join(wanted, ["pool", "label"]), ["pool", "label"], "member", F.col("_want"), seed).select("pool", "member", "label")


def independent_labels(labels: DataFrame, clashes: DataFrame) -> DataFrame:
    """A maximal set of labels of which no two clash, (label): those with the fewest clashes first, then by name.

    labels(node_id, label), clashes(u, v) between node ids. The set are the representatives of the
    cover in that order.
    """
    degree = clashes.select(F.explode(F.array("u", "v")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("n"))
    counted = labels.join(degree, "node_id", "left").select("node_id", "label", F.coalesce("n", F.lit(0)).alias("n"))
    chosen = cover.ordered(counted, clashes, F.col("n"), F.col("label")).where("node_id = rep").select("node_id")
    return labels.join(chosen, "node_id", "left_semi").select("label")


def log_spaced(low: int, high: int, n: int) -> list[int]:
    """n distinct sizes from low to high, evenly spaced on a logarithmic scale."""
    return sorted({int(round(x)) for x in np.geomspace(low, high, n)})


def complete_linkage(distance: np.ndarray, most: float) -> np.ndarray:
    """Groups of a small distance matrix, merged while the largest distance within a merged group is at most `most`; numbered by first appearance."""
    group = np.arange(len(distance))
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    while len(d) > 1:
        i, j = sorted(divmod(int(np.argmin(d)), len(d)))
        if not d[i, j] <= most:
            break
        d[i] = d[:, i] = np.maximum(d[i], d[j])
        d[i, i] = np.inf
        d[j] = d[:, j] = np.inf
        group[group == j] = i
    first: dict[int, int] = {}
    return np.array([first.setdefault(g, len(first)) for g in group.tolist()])


def best_match(cells: np.ndarray) -> int:
    """The most members that a one-to-one match of rows to columns of a contingency table can hold (a table of labels and clusters, small)."""
    n = max(cells.shape)
    cost = np.zeros((n + 1, n + 1))
    cost[1 : cells.shape[0] + 1, 1 : cells.shape[1] + 1] = -cells
    u, v, mate, way = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int), np.zeros(n + 1, int)
    for row in range(1, n + 1):  # shortest augmenting paths, one a row
        mate[0], at = row, 0
        least, used = np.full(n + 1, np.inf), np.zeros(n + 1, bool)
        while True:
            used[at] = True
            open_ = ~used
            open_[0] = False
            slack = cost[mate[at]] - u[mate[at]] - v
            closer = open_ & (slack < least)
            least[closer], way[closer] = slack[closer], at
            to = int(np.argmin(np.where(open_, least, np.inf)))
            delta = least[to]
            u[mate[used]] += delta
            v[used] -= delta
            least[open_] -= delta
            at = to
            if not mate[at]:
                break
        while at:
            mate[at], at = mate[way[at]], way[at]
    return int(sum(cells[mate[c] - 1, c - 1] for c in range(1, cells.shape[1] + 1) if 0 < mate[c] <= cells.shape[0]))
