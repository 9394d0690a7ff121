"""Readers and writers of exchange tables: packed pairs, shards of result grids, outputs of other tools."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def packed(u: Column, v: Column) -> Column:
    """Two node ids under 2 ** 32 as one integer, u in the high half."""
    return F.shiftleft(u.cast("long"), 32).bitwiseOR(v.cast("long"))


def unpacked(pair: Column) -> tuple[Column, Column]:
    """The ids of a packed pair."""
    return F.shiftrightunsigned(pair, 32), pair.bitwiseAND(F.lit((1 << 32) - 1))


def traced(*pairs: DataFrame) -> DataFrame:
    """(pair): all pairs (u, v) that any of the searches scored, packed, each once; a node with itself does not count."""
    every = reduce(DataFrame.unionByName, (p.select("u", "v") for p in pairs)).where("u != v")
    return every.select(packed(F.least("u", "v"), F.greatest("u", "v")).alias("pair")).distinct()


def shards(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """The rows of all shards, whose columns may differ, one a key: that of the first shard that has it."""
    numbered = [p.withColumn("_shard", F.lit(i)) for i, p in enumerate(parts)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
    rest = [c for c in every.columns if c not in key]
    best = every.groupBy(*key).agg(F.min_by(F.struct(*rest), "_shard").alias("_row"))
    return best.select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest if c != "_shard"])


def responsibilities(table: DataFrame, member: str, columns: list[str]) -> DataFrame:
    """(member, cluster): the number, from 1, of the component with the largest responsibility; ties to the first."""
    values = F.array(*[F.col(c).cast("double") for c in columns])
    return table.select(F.col(member).alias("member"), F.array_position(values, F.array_max(values)).cast("int").alias("cluster"))


def best_group_count(scores: DataFrame, groups: str, columns: list[str]) -> DataFrame:
    """The one row of the number of groups whose scores over its columns add up to most; ties to the fewer groups."""
    total = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns[1:]), F.coalesce(F.col(columns[0]).cast("double"), F.lit(0.0)))
    return scores.select(groups, total.alias("score")).orderBy(F.desc("score"), groups).limit(1)


def with_unassigned(labels: DataFrame, assigned: DataFrame) -> DataFrame:
    """labels(member, ...) with the cluster of assigned(member, cluster), 'unassigned' where it has none."""
    found = assigned.select("member", F.col("cluster").cast("string").alias("cluster"))
    return labels.join(found, "member", "left").withColumn("cluster", F.coalesce("cluster", F.lit("unassigned")))
