"""Edges: candidate pairs that pass the bound and the exact thresholds of a scoring mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifloom.functions.scores import SHORT, alignment_similarity, anchor_bound, anchor_similarity, packed, packed_bounds, terminal_similarity
from motifloom.operators import ends
from motifloom.operators.candidates import anchor_pairs, hit_count
from motifloom.operators.tables import stored
from motifloom.plans.config import Config

NODE = ("node_id", "sequence", "t", "h")


def with_sides(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """pairs(u, v) with both nodes' features, as structs a and b."""
    side = lambda name, of: nodes.select(F.col("node_id").alias(name), F.struct("sequence", "t", "h", "frequency").alias(of))
    return pairs.join(side("_u", "a"), F.col("u") == F.col("_u")).join(side("_v", "b"), F.col("v") == F.col("_v")).drop("_u", "_v")


def gate(config: Config) -> Column:
    """The sound rejection test: pairs that fail it can't be edges."""
    return passes(anchor_bound(F.col("a.h"), F.col("b.h")), config)


def passes(bound: Column, config: Config) -> Column:
    """Whether a bound leaves a pair the chance to be an edge."""
    if config.separate:
        return bound >= config.anchor_q
    return F.floor((bound + 1001) / 2) >= config.primary_q


def _combined(component: Column, anchor: Column) -> Column:
    return F.floor((component + anchor + 1) / 2).cast("int")


def scored(pairs: DataFrame, nodes: DataFrame, config: Config, all_scores: bool = False) -> DataFrame:
    """pairs(u, v) with kmer, anchor, alignment (0 where the mode reads none), combined and weight; no pair is left out."""
    sides = with_sides(pairs, nodes)
    out = sides.withColumn("kmer", terminal_similarity(F.col("a.t"), F.col("b.t"))).withColumn("anchor", anchor_similarity(F.col("a.h"), F.col("b.h")))
    reads = config.aligned or all_scores
    out = out.withColumn("alignment", alignment_similarity(F.col("a.sequence"), F.col("b.sequence"), config.gaps, config.terminal_matches) if reads else F.lit(0))
    return weighed(out, config).drop("a", "b")


def weighed(df: DataFrame, config: Config) -> DataFrame:
    """df(kmer, anchor, alignment) with combined and the ranking weight."""
    primary = F.col("alignment") if config.aligned else F.col("kmer")
    df = df.withColumn("combined", _combined(primary, F.col("anchor")))
    apart = F.greatest(F.lit(0), F.least(primary - config.primary_q, F.col("anchor") - config.anchor_q))
    return df.withColumn("weight", (apart if config.separate else F.col("combined")).cast("int"))


def meets(config: Config, high: bool = False) -> Column:
    """Whether a row passes the mode's thresholds; high: 0.75 or the threshold, if that is more."""
    at = lambda q: max(750, q) if high else q
    primary = F.col("alignment") if config.aligned else F.col("kmer")
    if config.separate:
        return (primary >= at(config.primary_q)) & (F.col("anchor") >= at(config.anchor_q))
    return F.col("combined") >= at(config.primary_q)


def eligible(df: DataFrame, config: Config, high: bool = False) -> DataFrame:
    """The rows that meets() holds for."""
    return df.where(meets(config, high))


def edges(pairs: DataFrame, nodes: DataFrame, config: Config, high: bool = False) -> DataFrame:
    """(u, v, weight, kmer, anchor, alignment, combined) of the eligible pairs.

    Cheap tests come first, each a step of its own: the bound, then the terminal similarity or the
    anchor similarity, then, on what is left, the other score.
    """
    sides = with_sides(pairs, nodes).where(gate(config))
    sides = sides.withColumn("kmer", terminal_similarity(F.col("a.t"), F.col("b.t")))
    if config.aligned:
        left = sides.withColumn("anchor", anchor_similarity(F.col("a.h"), F.col("b.h")))
        left = left.where(F.col("anchor") >= (config.anchor_q if config.separate else 2 * config.primary_q - 1001))
        left = left.withColumn("alignment", alignment_similarity(F.col("a.sequence"), F.col("b.sequence"), config.gaps, config.terminal_matches))
    else:
        left = sides.where(F.col("kmer") >= (config.primary_q if config.separate else 2 * config.primary_q - 1001))
        left = left.withColumn("anchor", anchor_similarity(F.col("a.h"), F.col("b.h"))).withColumn("alignment", F.lit(0))
    return eligible(weighed(left, config), config, high).select("u", "v", "weight", "kmer", "anchor", "alignment", "combined")


def prefilter_edges(nodes: DataFrame, config: Config, seeds: DataFrame) -> DataFrame:
    """The high-confidence edges among pairs with two common anchor values that are seeds, weighed by the normal thresholds."""
    shared = anchor_pairs(nodes).select("u", "v")
    return edges(shared.join(seeds, ["u", "v"], "left_semi"), nodes, config, high=True)


def united(first: DataFrame, second: DataFrame) -> DataFrame:
    """The union of two edge tables; an edge of both keeps its larger weight."""
    both = first.select("u", "v", "weight").unionByName(second.select("u", "v", "weight"))
    return both.groupBy("u", "v").agg(F.max("weight").alias("weight"))


def cost_counters(found: DataFrame, pairs: DataFrame, nodes: DataFrame, config: Config) -> DataFrame:
    """One row: index_hits, distinct_pairs, bound_rejected, pairs_scored; `found` are hits(), pairs the distinct ones."""
    passed = stored(with_sides(pairs, nodes).select(gate(config).alias("ok")), "gate").agg(F.count("*").alias("distinct_pairs"), F.count_if(~F.col("ok")).alias("bound_rejected"), F.count_if("ok").alias("pairs_scored"))
    return found.agg(F.count("*").alias("index_hits")).crossJoin(passed)  # one row each


def counted_costs(pairs: DataFrame, nodes: DataFrame, config: Config) -> DataFrame:
    """The row of cost_counters() for the distinct pairs of the settings' seeds, without a list of hits: they are counted by buckets."""
    known = nodes.select("node_id", packed(F.col("t"), F.size("h") == len(SHORT)).alias("_packed"))
    side = lambda name: known.select(F.col("node_id").alias(name), F.col("_packed").alias(f"_{name}"))
    bound = ends.scored(packed_bounds, F.col("_u"), F.col("_v"))
    ok = pairs.join(side("u"), "u").join(side("v"), "v").select(passes(bound, config).alias("ok"))
    ok = stored(ok, "gate")
    passed = ok.agg(F.count("*").alias("distinct_pairs"), F.count_if(~F.col("ok")).alias("bound_rejected"), F.count_if("ok").alias("pairs_scored"))
    return hit_count(nodes, config.seed, config.seed_threshold).crossJoin(passed)  # one row each
