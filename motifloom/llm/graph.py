"""Connected components of a link table, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifloom.llm.common import forget, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The component of every node that a link names: (node, root), root the smallest node reachable.

    Each round does a large-star and a small-star step (Kiveris et al., 2014): every node's larger
    neighbours, then its smaller ones, are tied to its smallest neighbour, until each component is
    one star. A round is joins and minimum aggregates; no neighbour list is gathered, and each
    round's links, after both steps, are written to the shared folder and deleted once the next round's are. Self links name a node without joining it to
    any other. Null ends: the link is left out. No links: no rows.
    """
    pairs = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).dropna()
    edges = written(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    alone = edges.where("u = v").select(F.col("u").alias("node"))
    edges, before = edges.where("u != v"), None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(low, F.col("u") == F.col("k")).select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
        )).alias("e")).select("e.*").where("u != v").distinct()
        edges = written(small, "small-star")
        forget(*([before] if before is not None else []))
        before = edges
        # all are stars once every node has one neighbour below it, which has none: one aggregate over both ends
        ends = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.lit(None).cast("long").alias("v")))
        ends = ends.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.max(F.col("v").isNull()).alias("root"))
        if ends.where("low != high OR (root AND low IS NOT NULL)").isEmpty():
            break
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    named = stars.unionByName(roots)
    return named.unionByName(alone.join(named.select("node"), "node", "left_anti").distinct().select("node", F.col("node").alias("root")))
