"""Refinement of a partition: reassignment, representatives, merging, to a fixed point.

A partition is (node_id, rep). edges(u, v, weight, kmer, anchor, alignment, combined) are the
eligible pairs; a node's edge to itself has weight 1000. The graph method knows retrieved edges
only. The greedy method's tests score pairs anew, among them pairs of members that no seed retrieved;
it is the same steps with `edges` of those pairs, and moves on the margin only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifloom.operators.candidates import candidates as find
from motifloom.operators.greedy import PairScores
from motifloom.operators.tables import ranked, stored, symmetric
from motifloom.plans.config import Config


def both_ways(edges: DataFrame, config: Config) -> DataFrame:
    """(src, dst, weight, first, second) in both directions: the component scores in the order in which they break ties."""
    first = "combined" if not config.separate else ("alignment" if config.aligned else "kmer")
    second = F.lit(0) if not config.separate else F.col("anchor")
    return symmetric(edges.select("u", "v", "weight", "alignment", "anchor", F.col(first).alias("first"), second.alias("second")))


def reassigned(partition: DataFrame, graph: DataFrame, margin: int, greedy: bool = False) -> DataFrame:
    """Every member's best representative by weight, component scores, smaller id; it moves if that beats its own by more than the margin.

    At margin 0 ties of weight are decided by the scores and the id, but in the greedy method,
    where an equal weight never moves. All move at once; representatives stay. Adds `moved`.
    """
    reps = partition.select(F.col("rep").alias("dst")).distinct()
    members = partition.where("node_id != rep")
    offers = graph.join(reps, "dst", "left_semi").join(members.select(F.col("node_id").alias("src"), F.col("rep").alias("own")), "src")
    rank = F.struct("weight", "first", "second", (-F.col("dst")).alias("id"))
    found = offers.groupBy("src").agg(F.max(rank).alias("best"), F.max(F.when(F.col("dst") == F.col("own"), rank)).alias("now"))
    weight, now = F.col("best.weight"), F.coalesce("now.weight", F.lit(0))
    better = weight > now + margin
    if margin == 0 and not greedy:
        better = better | ((weight == now) & (F.col("best") > F.col("now")))
    to = found.select(F.col("src").alias("n"), F.when(better & (-F.col("best.id") != F.coalesce(-F.col("now.id"), F.lit(-1))), -F.col("best.id")).alias("to"))
    out = partition.join(to, F.col("node_id") == F.col("n"), "left")
    return out.select("node_id", F.coalesce("to", "rep").alias("rep"), F.col("to").isNotNull().alias("moved"))


def represented(partition: DataFrame, graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """(rep, best): of each cluster the member beside all other members with the largest sums, by frequency, of weight, alignment and anchor.

    Then by its own frequency and the smaller id; the present one stays where no other beats it
    with sums of zero.
    """
    freq = nodes.select(F.col("node_id").alias("f_id"), F.col("frequency").cast("long").alias("f"))
    member = partition.select(F.col("node_id").alias("m"), F.col("rep").alias("r"))
    sizes = partition.groupBy("rep").agg(F.count("*").alias("size"))
    inner = graph.join(member.select(F.col("m").alias("src"), F.col("r").alias("sr")), "src").join(member.select(F.col("m").alias("dst"), F.col("r").alias("dr")), "dst").where("sr = dr")
    sums = [F.sum(F.col(c) * F.col("f")).alias(c) for c in ("weight", "alignment", "anchor")]
    seen = inner.join(freq, F.col("dst") == F.col("f_id")).groupBy("src", F.col("sr").alias("rep")).agg(F.count("*").alias("n"), *sums)
    full = seen.join(sizes, "rep").where("n + 1 = size").join(freq, F.col("src") == F.col("f_id"))
    key = F.struct("weight", "alignment", "anchor", "f", (-F.col("src")).alias("id"))
    best = full.groupBy("rep").agg(F.max(key).alias("best")).select(F.col("rep").alias("b_rep"), "best")
    out = sizes.join(best, F.col("rep") == F.col("b_rep"), "left").join(freq, F.col("rep") == F.col("f_id"))
    zero = F.lit(0).cast("long")
    present = F.struct(zero.alias("weight"), zero.alias("alignment"), zero.alias("anchor"), F.col("f"), (-F.col("rep")).alias("id"))
    return out.select("rep", F.when(F.col("best") > present, -F.col("best.id")).otherwise(F.col("rep")).alias("best"))


def re_represented(partition: DataFrame, graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """The partition with represented()'s representatives; `changed` tells of which clusters they differ."""
    new = represented(partition, graph, nodes).select(F.col("rep").alias("old"), "best")
    return partition.join(new, F.col("rep") == F.col("old")).select("node_id", F.col("best").alias("rep"), (F.col("best") != F.col("rep")).alias("changed"))


def merge_candidates(partition: DataFrame, graph: DataFrame) -> DataFrame:
    """(target, source, target_size, source_size): clusters whose representative, target, is beside all members of source."""
    sizes = stored(partition.groupBy("rep").agg(F.count("*").alias("size")), "sizes")
    near = graph.join(sizes.select(F.col("rep").alias("src")), "src", "left_semi").join(partition.select(F.col("node_id").alias("dst"), F.col("rep").alias("source")), "dst")
    counts = near.where("src != source").groupBy(F.col("src").alias("target"), "source").agg(F.count("*").alias("n"))
    size = lambda of: sizes.select(F.col("rep").alias(of), F.col("size").alias(f"{of}_size"))
    return counts.join(size("source"), "source").where("n = source_size").join(size("target"), "target").select("target", "source", "target_size", "source_size")


def probed_merges(partition: DataFrame, nodes: DataFrame, config: Config, scores: PairScores) -> DataFrame:
    """merge_candidates() of the greedy method: clusters whose representatives are similar by seeds, and whose target is no smaller.

    The target's representative is scored anew against the source's, then against all its other
    members, retrieved or not; each test is one join on what the one before it left.
    """
    sizes = stored(partition.groupBy("rep").agg(F.count("*").alias("size")), "sizes")
    size = lambda of: sizes.select(F.col("rep").alias(of), F.col("size").alias(f"{of}_size"))
    reps = nodes.join(sizes.select(F.col("rep").alias("node_id")), "node_id", "left_semi")
    close = scores.eligible(find(reps, config.seed, config.seed_threshold))
    tests = symmetric(close.select("u", "v")).select(F.col("src").alias("target"), F.col("dst").alias("source"))
    tests = stored(tests.join(size("target"), "target").join(size("source"), "source").where("target_size >= source_size"), "merge-tests")
    others = partition.where("node_id != rep").select(F.col("node_id").alias("member"), F.col("rep").alias("source"))
    asked = stored(tests.join(others, "source").select("target", "source", "member"), "merge-members")
    ends = (F.least("target", "member").alias("u"), F.greatest("target", "member").alias("v"))
    passed = scores.eligible(asked.select(*ends)).select("u", "v")
    held = asked.select("target", "source", *ends).join(passed, ["u", "v"], "left_semi").groupBy("target", "source").agg(F.count("*").alias("n"))
    whole = tests.join(held, ["target", "source"], "left").where(F.coalesce("n", F.lit(0)) + 1 == F.col("source_size"))
    return whole.select("target", "source", "target_size", "source_size")


def settled_merges(found: DataFrame) -> DataFrame:
    """(source, target): which of found(target, source, target_size, source_size) apply if targets have their turns by size, largest first, then by the smaller id.

    A target takes, in its turn, all its sources that are left, unless it was taken before; it is as large then as at
    the start, as it grows in its own turn only. So a source that had its turn before must be as large and have taken none.
    Each round decides those pairs of which all earlier turns that matter are decided: whether an earlier target took this
    target, or this source, or this source took one. Nothing is grouped, however many pairs hang together.
    """
    place = lambda size, of: F.struct((-F.col(size)).alias("size"), F.col(of).alias("id"))
    state = found.where("target_size >= source_size").select("target", "source", place("target_size", "target").alias("at"), place("source_size", "source").alias("own"), F.lit(None).cast("boolean").alias("ok"))
    state = stored(state, "merge-pairs")
    while not state.where("ok is null").isEmpty():
        first = lambda on: F.min(F.when(on, F.col("at")))
        taken = stored(state.groupBy("source").agg(first(F.col("ok")).alias("taken"), first(F.col("ok").isNull()).alias("open")).where("taken is not null or open is not null"), "merge-sources")
        took = state.groupBy("target").agg(F.bool_or("ok").alias("took"), F.bool_or(F.col("ok").isNull()).alias("turn_open")).where("took or turn_open")
        of = lambda name: taken.select(F.col("source").alias(name), F.col("taken").alias(f"{name}_taken"), F.col("open").alias(f"{name}_open"))
        seen = state.join(of("target"), "target", "left").join(of("source"), "source", "left").join(took.select(F.col("target").alias("source"), "took", "turn_open"), "source", "left")
        before = lambda c: F.coalesce(F.col(c) < F.col("at"), F.lit(False))
        had_turn = F.col("own") < F.col("at")
        no = before("target_taken") | before("source_taken") | (had_turn & F.coalesce("took", F.lit(False)))
        wait = before("target_open") | before("source_open") | (had_turn & F.coalesce("turn_open", F.lit(False)))
        ok = F.when(F.col("ok").isNotNull(), F.col("ok")).when(no, False).when(~wait, True)
        state = stored(seen.select("target", "source", "at", "own", ok.alias("ok")), "merge-pairs")
    return state.where("ok").select("source", "target")


def merged(partition: DataFrame, found: DataFrame) -> DataFrame:
    """The partition after one pass of strict merges of found, merge_candidates() or probed_merges(); `merged` marks the members that changed cluster."""
    to = settled_merges(found)
    return partition.join(to, F.col("rep") == F.col("source"), "left").select("node_id", F.coalesce("target", "rep").alias("rep"), F.col("target").isNotNull().alias("merged"))


def violations(partition: DataFrame, edges: DataFrame) -> DataFrame:
    """The members without an edge to their representative."""
    both = symmetric(edges.select("u", "v"))
    members = partition.where("node_id != rep").select("node_id", "rep")
    return members.join(both, (F.col("node_id") == F.col("src")) & (F.col("rep") == F.col("dst")), "left_anti")


def member_pairs(partition: DataFrame) -> DataFrame:
    """(u, v): all pairs of members of one cluster, for the greedy method's exact scores, each of which is kept."""
    a = partition.select(F.col("node_id").alias("u"), "rep")
    return a.join(partition.select(F.col("node_id").alias("v"), F.col("rep").alias("r")), (F.col("rep") == F.col("r")) & (F.col("u") < F.col("v"))).select("u", "v")


@dataclass
class Progress:
    iterations: int = 0
    moves: int = 0
    representative_changes: int = 0
    merges: int = 0
    failures: int = 0
    converged: bool = False


def beside_representatives(pairs: DataFrame, partition: DataFrame) -> DataFrame:
    """The candidates of a member and a representative, and each member with its own."""
    marked = partition.select("node_id", (F.col("node_id") == F.col("rep")).alias("is_rep"))
    side = lambda name: marked.select(F.col("node_id").alias(name), F.col("is_rep").alias(f"{name}_rep"))
    met = pairs.select("u", "v").join(side("u"), "u").join(side("v"), "v").where("u_rep != v_rep").select("u", "v")
    return met.unionByName(partition.where("node_id != rep").select(F.col("node_id").alias("u"), F.col("rep").alias("v")))


def converge(partition: DataFrame, edges: DataFrame, nodes: DataFrame, config: Config, scores: PairScores | None = None) -> tuple[DataFrame, Progress]:
    """Reassigns, re-represents, merges and checks until nothing changes, a state comes again, the cap is met, or a check fails.

    With scores (the greedy method) `edges` are candidate pairs without scores: those of members and representatives
    are scored, then all pairs within clusters, whichever seeds retrieve; each pair once in all iterations.
    """
    greedy = scores is not None
    graph = None if greedy else stored(both_ways(edges, config), "graph")
    within = lambda of: stored(both_ways(scores.eligible(member_pairs(of)), config), "graph")
    state, seen, progress = stored(partition.select("node_id", "rep"), "partition"), set(), Progress()
    while config.iterations is None or progress.iterations < config.iterations:
        mark = state.agg(F.sum(F.xxhash64("node_id", "rep").cast("decimal(38,0)"))).first()[0]
        if mark in seen:
            break
        seen.add(mark)
        progress.iterations += 1
        if greedy:
            graph = stored(both_ways(scores.eligible(beside_representatives(edges, state)), config), "graph")
        step = stored(reassigned(state, graph, config.margin_q, greedy), "reassigned")
        moves = step.where("moved").count()
        if greedy:
            graph = within(step)
        step = stored(re_represented(step, graph, nodes), "represented")
        changes = step.where("changed").select("rep").distinct().count()
        merges = 0
        if config.merge:
            now = step.select("node_id", "rep")
            step = stored(merged(now, probed_merges(now, nodes, config, scores) if greedy else merge_candidates(now, graph)), "after-merge")
            merges = step.where("merged").count()
            if merges:
                graph = within(step) if greedy else graph
                step = stored(re_represented(step, graph, nodes), "represented")
                progress.representative_changes += step.where("changed").select("rep").distinct().count()
        state = step.select("node_id", "rep")
        failures = violations(state, graph.select(F.col("src").alias("u"), F.col("dst").alias("v"))).count()
        progress.moves += moves
        progress.representative_changes += changes
        progress.merges += merges
        progress.failures += failures
        progress.converged = not (moves or changes or merges or failures)
        if progress.converged or failures:
            break
    return state, progress


def numbered(partition: DataFrame) -> DataFrame:
    """(node_id, rep, cluster): clusters numbered from 0 in the order of their representatives."""
    reps = partition.select("rep").distinct()
    at = ranked(reps, F.col("rep"), to="cluster").select(F.col("rep").alias("r"), "cluster")
    return partition.join(at, F.col("rep") == F.col("r")).select("node_id", "rep", "cluster")


def size_distribution(partition: DataFrame) -> DataFrame:
    """One row: clusters, singletons, mean, median and largest size."""
    sizes = partition.groupBy("rep").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("clusters"), F.count_if(F.col("n") == 1).alias("singletons"), F.avg("n").alias("mean_size"), F.median("n").alias("median_size"), F.max("n").alias("max_size"))


def largest_first(partition: DataFrame) -> DataFrame:
    """(rep, size, place): clusters ranked from 1 by size, largest first, then by representative."""
    sizes = partition.groupBy("rep").agg(F.count("*").alias("size"))
    return ranked(sizes, F.col("size").desc(), F.col("rep"), to="place").withColumn("place", F.col("place") + 1)
