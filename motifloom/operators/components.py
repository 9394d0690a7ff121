"""Connected components of small and large link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifloom.operators.tables import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) of links(a, b): the smallest node that each can reach, by labels that are lowered and followed until none falls."""
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("n")).agg(F.min("root").alias("low"))
        low = label.join(near, F.col("node") == F.col("n")).select("node", F.col("root").alias("was"), F.least("root", "low").alias("root"))
        low = stored(low, "labels")
        jump = low.select(F.col("node").alias("n"), F.col("root").alias("far"))
        after = stored(low.join(jump, F.col("root") == F.col("n")).select("node", "was", F.least("root", "far").alias("root")), "labels")
        label = after.select("node", "root")
        if after.where("was != root").isEmpty():
            return label
