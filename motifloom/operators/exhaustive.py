"""The exhaustive search by which others are measured: all pairs that can be edges, whichever seeds they have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifloom.operators.edges import edges, gate
from motifloom.operators.ends import ENDS, closest, end_code, end_scores, of_shapes, paired, scored, similar
from motifloom.operators.tables import stored
from motifloom.plans.config import Config


def possible_pairs(nodes: DataFrame, config: Config) -> DataFrame:
    """(u, v), u < v: every pair of nodes that can be an edge; no seed takes part, so nothing eligible is lost.

    Scores but the alignment depend on the ends and the mask alone, so distinct shapes of these meet, not nodes: through
    the table of front pairs that leave the thresholds within reach of the best back, then by the back's own score,
    then by the bound. Where thresholds are low all fronts are within reach, and all pairs of shapes are looked at.
    """
    anchor = config.anchor_q if config.separate else 2 * config.primary_q - 1001
    terminal = 0 if config.aligned else (config.primary_q if config.separate else 2 * config.primary_q - 1001)
    total, top = 2 * terminal - 1, 2 * anchor  # what both ends' similarities, and closest residues, must add up to
    front, back = end_code(F.col("t"), False), end_code(F.col("t"), True)
    shape = F.col("front").cast("long") * ENDS * 64 + F.col("back") * 64 + F.col("mask")
    shaped = stored(nodes.select("node_id", "mask", "h", front.alias("front"), back.alias("back")).withColumn("shape", shape), "shapes")
    shapes = stored(shaped.groupBy("shape").agg(*[F.first(c).alias(c) for c in ("front", "back", "h")]), "distinct-shapes")
    least = {"score": total - 1000} | ({"close": top - 1000} if anchor > 0 else {})
    near = end_scores(shapes.select(F.col("front").alias("x")), shapes.select(F.col("front").alias("y")), least, score=similar, close=closest)
    met, backs = paired(shapes, stored(near, "near-fronts"), "h"), (F.col("a.back"), F.col("b.back"))
    met = met.where(F.col("score") + scored(similar, *backs) >= total)
    if anchor > 0:
        met = met.where(F.col("close") + scored(closest, *backs) >= top)
    kept = stored(met.where(gate(config)).select(F.col("a.shape").alias("sa"), F.col("b.shape").alias("sb")), "shape-pairs")
    return of_shapes(kept, shaped)


def all_edges(nodes: DataFrame, config: Config) -> DataFrame:
    """Every eligible pair with its scores: the exhaustive reference by which searches are measured."""
    return edges(possible_pairs(nodes, config), nodes, config)
