"""Partitions beside other tables: joins that must cover every row, restriction to a subset, provisional clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from motifloom.operators.refine import numbered


def covering_join(labels: DataFrame, assignment: DataFrame, key: str) -> DataFrame:
    """labels inner-joined with assignment on `key`; a label without a row in assignment fails the job, null keys too.

    The test is part of the plan, so nothing is counted beforehand. Labels with several rows in assignment have as many.
    """
    found = assignment.withColumn("_there", F.lit(True))
    met = labels.join(found, key, "left")
    wrong = F.raise_error(F.concat(F.lit(f"no row for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return met.withColumn("_there", F.when(F.col("_there"), F.col("_there")).otherwise(wrong.cast("boolean"))).where("_there").drop("_there")


def restricted(partition: DataFrame, subset: DataFrame) -> DataFrame:
    """partition(node_id, rep) of the nodes in subset(node_id): clusters as they are, but for those whose representative is left out.

    These are represented by their smallest node left. Nodes of the subset that the partition lacks, and repeats, do not count.
    """
    kept = partition.select("node_id", "rep").join(subset.select("node_id").distinct(), "node_id", "left_semi")
    cluster = W.partitionBy("rep")
    there = F.max(F.col("node_id") == F.col("rep")).over(cluster)
    return kept.select("node_id", F.when(there, F.col("rep")).otherwise(F.min("node_id").over(cluster)).alias("rep"))


def provisional_rows(nodes: DataFrame, cover: DataFrame) -> DataFrame:
    """One row a node of the prefilter's cover(node_id, rep): ends, mask, its cluster by number, representative and size, and whether the cluster has other members."""
    named = numbered(cover.select("node_id", "rep")).withColumn("provisional_cluster_size", F.count("*").over(W.partitionBy("rep")))
    own = nodes.select("node_id", F.concat(F.substring("sequence", 1, 3), F.right("sequence", F.lit(3))).alias("anchor"), F.col("mask").alias("geometry_mask"))
    return own.join(named, "node_id").select(
        "node_id", "anchor", "geometry_mask", F.col("cluster").alias("provisional_cluster"), F.col("rep").alias("provisional_representative_node"),
        "provisional_cluster_size", (F.col("provisional_cluster_size") > 1).alias("assigned_to_nonsingleton"),
    )
