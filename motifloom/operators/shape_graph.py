"""Covers and refinement by shapes: what operators.cover and operators.refine give, without a list of edges between nodes.

Scores but the alignment depend on shapes alone, so nodes of one shape are beside each other and have the same neighbours.
A cover takes all of a shape at once; a refinement moves all members of one shape and one cluster together, but for
representatives, which stay. So steps join groups, the nodes of one shape in one cluster, through links of shapes; only the
partition itself has a row a node. The modes that read the alignment have no such graph.
"""

from __future__ import annotations

from copy import copy

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifloom.functions.scores import SHORT, packed_bounds
from motifloom.operators import cover, refine
from motifloom.operators.edges import meets
from motifloom.operators.ends import ENDS, in_bytes, scored, seeded
from motifloom.operators.shapes import degree_sums, distinct, expanded, shape_edges, shaped
from motifloom.operators.tables import stored
from motifloom.plans.config import Config

SCORES = ("weight", "kmer", "anchor", "alignment", "combined")
#: Shapes of one block, whole fronts; blocks meet each other, a group each.
BLOCK = 4000
#: Pairs of shapes that a task bounds at once.
CELLS = 1 << 20


class ShapeGraph:
    """Nodes by shapes, and the links of shapes by some settings.

    links: (a, b, scores, first, second, near), both ways, a shape and itself too; near tells that the settings' seeds retrieve
    them. every: links that no seed retrieves are there too. met(sa, sb, ...) has each once, `high` if its pairs are edges.prefilter_edges().
    """

    def __init__(self, nodes: DataFrame, config: Config, every: bool = False):
        if config.aligned:
            raise ValueError("the modes with alignments do not score by shapes")
        self.config, self.nodes = config, nodes
        self._of = shaped(nodes)
        self.shapes = distinct(self._of)
        met = shape_edges(self.shapes, config, None if every else (config.seed, config.seed_threshold))
        near = _near(config) if every else F.lit(True)
        high = (F.size(F.array_intersect("ah", "bh")) >= 2) & meets(config, high=True)
        self.met = stored(met.select("sa", "sb", *SCORES, near.alias("near"), (near & high).alias("high")), "shape-edges")
        self.links = self._turned()
        self.of = stored(self._of.select("node_id", "shape").join(nodes.select("node_id", "sequence", F.col("frequency").cast("long").alias("frequency")), "node_id"), "shape-nodes")

    def _turned(self) -> DataFrame:
        first, second = ("kmer", F.col("anchor")) if self.config.separate else ("combined", F.lit(0))
        turned = lambda a, b: self.met.select(F.col(a).alias("a"), F.col(b).alias("b"), "near", "weight", "alignment", "anchor", F.col(first).alias("first"), second.alias("second"))
        return turned("sa", "sb").unionByName(turned("sb", "sa").where("a != b"))

    def edges(self) -> DataFrame:
        """The edges between nodes that the seeds retrieve, as shapes.edges() gives them; listed when they are read."""
        return expanded(self.met.where("near"), self._of, *SCORES)

    def partition(self, reps: DataFrame) -> DataFrame:
        """(node_id, rep) of reps(shape, rep)."""
        return self.of.select("node_id", "shape").join(reps, "shape").select("node_id", "rep")

    def _between(self, first: DataFrame, *keep: str) -> DataFrame:
        """(u, v, keep): the retrieved links between the nodes of first(shape, node_id) of different shapes, each once."""
        side = lambda s, to: first.select(F.col("shape").alias(s), F.col("node_id").alias(to))
        return self.met.where("near and sa != sb").join(side("sa", "u"), "sa").join(side("sb", "v"), "sb").select("u", "v", *keep)

    def coverage(self) -> DataFrame:
        """cover.coverage(): (node_id, rep). Of a shape the node with the largest frequency and the smallest id stands for all."""
        best = F.struct((-F.col("frequency")).alias("f"), "node_id")
        first = self.of.groupBy("shape").agg(F.min(best).alias("best"), F.count("*").alias("many"))
        own = self.links.where("a = b").select(F.col("a").alias("shape"), F.col("weight").cast("long").alias("own"))
        first = stored(first.join(own, "shape").select("shape", F.col("best.node_id").alias("node_id"), (-F.col("best.f")).alias("frequency"), "many", "own"), "first-nodes")
        found = cover.coverage(first, self._between(first, "weight"))
        return self.partition(first.select("shape", "node_id").join(found.select("node_id", "rep"), "node_id").select("shape", "rep"))

    def provisional(self) -> DataFrame:
        """cover.coverage() of edges.prefilter_edges(): (node_id, rep). Nodes of a shape with one anchor value share no two with any node, so they stand alone."""
        first = copy(self)
        first.met = self.met.where("high")
        first.links = first._turned()
        found = stored(first.coverage(), "provisional")
        return found.unionByName(self.of.join(found.select("node_id"), "node_id", "left_anti").select("node_id", F.col("node_id").alias("rep")))

    def united(self) -> DataFrame:
        """(u, v, weight): edges.united() of edges.prefilter_edges() and of the edges within the scope that their cover leaves; each pair is made once."""
        scope = cover.scopes(self.provisional()).where("is_rep or not assigned").select("node_id", F.lit(True).alias("in"))
        of = stored(self._of.select("node_id", "shape").join(scope, "node_id", "left").select("node_id", "shape", F.col("in").isNotNull().alias("in")), "scoped")
        side = lambda s, to: of.select(F.col("shape").alias(s), F.col("node_id").alias(to), F.col("in").alias(f"{to}_in"))
        met = self.met.where("near").join(side("sa", "i"), "sa").join(side("sb", "j"), "sb").where("(sa != sb or i < j) and (high or i_in or j_in)")
        return met.select(F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v"), "weight")

    def ordered(self, order: DataFrame, *by: Column) -> DataFrame:
        """cover.ordered() by columns of order(node_id, shape, ...): (node_id, rep); the first node of each shape decides for all."""
        place = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(by)])
        first = order.groupBy("shape").agg(F.min_by("node_id", place).alias("node_id"), F.min(place).alias("by"))
        first = stored(first, "first-nodes")
        found = cover.ordered(first, stored(self._between(first), "shape-links"), *[F.col(f"by.c{i}") for i in range(len(by))])
        return self.partition(first.select("shape", "node_id").join(found, "node_id").select("shape", "rep"))

    def intrinsic(self) -> DataFrame:
        """cover.intrinsic(): (node_id, rep)."""
        return self.ordered(self.of, -F.length("sequence"), F.col("sequence"))

    def kmer_degree(self) -> DataFrame:
        """cover.kmer_degree() of all candidates of the seeds: (node_id, rep); nodes of a shape have as many survivors."""
        counts = bound_counts(self.shapes, self.config).select("shape", "passed")
        return self.ordered(self.of.join(counts, "shape"), -F.col("passed"), F.col("sequence"))

    # refinement: state is (node_id, shape, frequency, rep)

    def state(self, partition: DataFrame) -> DataFrame:
        return self.of.select("node_id", "shape", "frequency").join(partition.select("node_id", "rep"), "node_id")

    @staticmethod
    def _reps(state: DataFrame) -> DataFrame:
        return state.where("node_id = rep").select("rep", F.col("shape").alias("b"))

    def reassigned(self, state: DataFrame, greedy: bool = False) -> DataFrame:
        """The state after refine.reassigned(), with `moved` and `was`, the representative before: offers are made to shapes, and once to each cluster of a shape's members."""
        reps, margin = stored(self._reps(state), "reps"), self.config.margin_q
        rank = lambda i: F.struct("weight", "first", "second", (-F.col(i)).alias("id"))
        offers = self.links.where("near").join(reps.groupBy("b").agg(F.min("rep").alias("i")), "b").groupBy(F.col("a").alias("shape")).agg(F.max(rank("i")).alias("best"))
        held = state.where("node_id != rep").select("shape", "rep").distinct().join(reps, "rep")
        now = held.join(self.links.withColumnRenamed("a", "shape"), ["shape", "b"], "left").select("shape", "rep", F.when(F.col("weight").isNotNull(), rank("rep")).alias("now"))
        found = now.join(offers, "shape", "left").withColumn("best", F.greatest("best", "now")).where("best is not null")
        weight, own = F.col("best.weight"), F.coalesce("now.weight", F.lit(0))
        better = weight > own + margin
        if margin == 0 and not greedy:
            better = better | ((weight == own) & (F.col("best") > F.col("now")))
        to = found.where(better & (-F.col("best.id") != F.coalesce(-F.col("now.id"), F.lit(-1)))).select("shape", "rep", (-F.col("best.id")).alias("to"))
        moved = F.col("to").isNotNull() & (F.col("node_id") != F.col("rep"))
        return state.join(to, ["shape", "rep"], "left").select("node_id", "shape", "frequency", F.when(moved, F.col("to")).otherwise(F.col("rep")).alias("rep"), moved.alias("moved"), F.col("rep").alias("was"))

    @staticmethod
    def _groups(state: DataFrame) -> DataFrame:
        """(rep, shape, n, f, least): of the nodes of a shape in a cluster how many, their frequencies' sum, and the least (frequency, node_id)."""
        return stored(state.groupBy("rep", "shape").agg(F.count("*").alias("n"), F.sum("frequency").alias("f"), F.min(F.struct("frequency", "node_id")).alias("least")), "groups")

    def represented(self, state: DataFrame) -> DataFrame:
        """(rep, best): refine.represented(). Of a shape's members that with the least frequency, then id, has the largest sums, as its own counts for nothing."""
        groups = self._groups(state)
        other = groups.select("rep", F.col("shape").alias("b"), F.col("n").alias("n_b"), F.col("f").alias("f_b"))
        met = groups.select("rep", F.col("shape").alias("a"), "least").join(self.links, "a").join(other, ["rep", "b"])
        own = F.col("a") == F.col("b")
        n, f = F.col("n_b") - own.cast("long"), F.col("f_b") - F.when(own, F.col("least.frequency")).otherwise(0)
        seen = met.groupBy("rep", "a").agg(F.first("least").alias("least"), F.sum(n).alias("n"), *[F.sum(F.col(c) * f).alias(c) for c in ("weight", "alignment", "anchor")])
        sizes = groups.groupBy("rep").agg(F.sum("n").alias("size"))
        key = F.struct("weight", "alignment", "anchor", F.col("least.frequency").alias("f"), (-F.col("least.node_id")).alias("id"))
        best = seen.join(sizes, "rep").where("n + 1 = size").groupBy("rep").agg(F.max(key).alias("best"))
        zero = F.lit(0).cast("long")
        present = F.struct(zero.alias("weight"), zero.alias("alignment"), zero.alias("anchor"), F.col("frequency").alias("f"), (-F.col("rep")).alias("id"))
        reps = state.where("node_id = rep").select("rep", "frequency")
        return reps.join(best, "rep", "left").select("rep", F.when(F.col("best") > present, -F.col("best.id")).otherwise(F.col("rep")).alias("best"))

    def re_represented(self, state: DataFrame, touched: DataFrame | None = None) -> DataFrame:
        """The state with represented()'s representatives, and `changed`.

        touched(rep): the clusters that gained or lost members since their representatives were chosen; the same members choose the same again, so others stay as they are.
        """
        new = self.represented(state if touched is None else state.join(touched, "rep", "left_semi"))
        best = F.coalesce("best", "rep")
        return state.join(new, "rep", "inner" if touched is None else "left").select("node_id", "shape", "frequency", best.alias("rep"), (best != F.col("rep")).alias("changed"))

    def merge_candidates(self, state: DataFrame, greedy: bool = False) -> DataFrame:
        """refine.merge_candidates(); greedy: refine.probed_merges(), whose representatives the seeds must retrieve."""
        groups, reps = self._groups(state), stored(self._reps(state), "reps")
        sizes = stored(groups.groupBy("rep").agg(F.sum("n").alias("size")), "sizes")
        size = lambda of: sizes.select(F.col("rep").alias(of), F.col("size").alias(f"{of}_size"))
        at = reps.select(F.col("b").alias("a")).distinct()
        near = self.links.join(at, "a", "left_semi").join(groups.select(F.col("shape").alias("b"), F.col("rep").alias("source"), "n"), "b")
        whole = near.groupBy("a", "source").agg(F.sum("n").alias("n")).join(size("source"), "source").where("n = source_size")
        if greedy:
            whole = whole.join(reps.withColumnRenamed("rep", "source"), "source").join(self.links.where("near").select("a", "b"), ["a", "b"], "left_semi")
        found = whole.join(reps.select(F.col("rep").alias("target"), F.col("b").alias("a")), "a").where("target != source").join(size("target"), "target")
        found = found.select("target", "source", "target_size", "source_size")
        return found.where("target_size >= source_size") if greedy else found

    def violations(self, state: DataFrame) -> DataFrame:
        """(rep, n): of each cluster with such, how many members refine.violations() names."""
        held = state.where("node_id != rep").groupBy("rep", "shape").agg(F.count("*").alias("n")).join(self._reps(state), "rep")
        return held.join(self.links.select(F.col("a").alias("shape"), "b"), ["shape", "b"], "left_anti").groupBy("rep").agg(F.sum("n").alias("n"))

    def converge(self, partition: DataFrame) -> tuple[DataFrame, refine.Progress]:
        """refine.converge(), of the graph's settings: by the greedy method links of every pair must be there."""
        config, greedy = self.config, self.config.method == "greedy"
        state, seen, progress = stored(self.state(partition), "partition"), set(), refine.Progress()
        plain = lambda df: df.select("node_id", "shape", "frequency", "rep")
        changed = lambda df: df.where("changed").select("rep").distinct().count()
        while config.iterations is None or progress.iterations < config.iterations:
            mark = state.agg(F.sum(F.xxhash64("node_id", "rep").cast("decimal(38,0)"))).first()[0]
            if mark in seen:
                break
            seen.add(mark)
            progress.iterations += 1
            step = stored(self.reassigned(state, greedy), "reassigned")
            moves = step.where("moved").count()
            changes, merges = 0, 0
            if moves or progress.iterations == 1:
                touched = None if progress.iterations == 1 else step.where("moved").select(F.explode(F.array("rep", "was")).alias("rep")).distinct()
                step = stored(self.re_represented(plain(step), touched), "represented")
                changes = changed(step)
            if config.merge:
                to = stored(refine.settled_merges(self.merge_candidates(plain(step), greedy)), "merges")
                step = step.join(to, F.col("rep") == F.col("source"), "left")
                step = stored(step.select("node_id", "shape", "frequency", F.coalesce("target", "rep").alias("rep"), F.col("target").isNotNull().alias("merged")), "after-merge")
                merges = step.where("merged").count()
                if merges:
                    step = stored(self.re_represented(plain(step), to.select(F.col("target").alias("rep")).distinct()), "represented")
                    progress.representative_changes += changed(step)
            state = plain(step)
            failures = self.violations(state).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
            progress.moves += moves
            progress.representative_changes += changes
            progress.merges += merges
            progress.failures += failures
            progress.converged = not (moves or changes or merges or failures)
            if progress.converged or failures:
                break
        return state.select("node_id", "rep"), progress


def _near(config: Config) -> Column:
    """Whether the seeds retrieve a pair of shapes (sa, sb)."""
    front, back = lambda s: F.floor(F.col(s) / (ENDS * 64)).cast("int"), lambda s: (F.floor(F.col(s) / 64) % ENDS).cast("int")
    close = [scored(seeded(config.seed), end("sa"), end("sb")) >= round(config.seed_threshold * 1000) for end in (front, back)]
    return close[0] & close[1]


def bound_counts(shapes: DataFrame, config: Config, costs: bool = False) -> DataFrame:
    """(shape, passed): of a node of each shape how many candidates of the seeds pass the bound with it on the left, itself aside.

    costs: (shape, other, ahead, level), only pairs with the smaller node on the left, if nodes are numbered in byte order: ahead
    counts the nodes of later fronts that pass, level those of its own front, itself included, that pass both ways round; a row
    with `other` names a shape of its own front that passes on the right only. Blocks of shapes meet, so no row is made for a pair.
    """
    blocks = max(1, -(-shapes.count() // BLOCK))
    block = F.pmod(F.xxhash64("front"), F.lit(blocks)).cast("int")
    all_ = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    rows = shapes.select("shape", "n", (F.size("h") == len(SHORT)).cast("long").alias("short"), block.alias("block"))
    at, seeds, gate = round(config.seed_threshold * 1000), seeded(config.seed), config.anchor_q if config.separate else 2 * config.primary_q - 1001

    def run(own: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        codes = lambda df: [c.to_numpy(np.int64) for c in (df["shape"] // (ENDS * 64), df["shape"] // 64 % ENDS, df["short"], df["n"], df["shape"])]
        xf, xb, xs, _, x = codes(own.sort_values("shape"))
        yf, yb, ys, n, y = codes(near.sort_values("shape"))
        xp, yp = (xf * ENDS + xb) * 2 + xs, (yf * ENDS + yb) * 2 + ys
        fronts, starts = np.unique(xf, return_index=True)
        others, of = np.unique(yf, return_inverse=True)
        sums, odd = np.zeros((len(x), 2), np.int64), [np.zeros((0, 2), np.int64)]
        for front, lo, hi in zip(fronts.tolist(), starts.tolist(), [*starts[1:].tolist(), len(x)], strict=True):
            close = seeds(np.int64(front), others) >= at
            if costs:  # only nodes that can be behind
                close &= in_bytes(others) >= in_bytes(np.int64(front))
            cols = np.flatnonzero(close[of])
            step = max(1, CELLS // max(1, len(cols)))
            for i in range(lo, hi, step):
                r, c = np.nonzero(seeds(xb[i : min(hi, i + step), None], yb[None, cols]) >= at)
                r, c = r + i, cols[c]
                ok = packed_bounds(xp[r], yp[c]) >= gate
                r, c = r[ok], c[ok]
                if costs:
                    same = yf[c] == front
                    back = np.zeros(len(r), bool)
                    back[same] = packed_bounds(yp[c[same]], xp[r[same]]) >= gate
                    np.add.at(sums[:, 1], r[back], n[c[back]])
                    only = same & ~back
                    odd.append(np.stack([x[r[only]], y[c[only]]], axis=1))
                    r, c = r[~same], c[~same]
                np.add.at(sums[:, 0], r, n[c])
        if not costs:
            return pd.DataFrame({"shape": x, "passed": sums[:, 0]})
        odd = np.concatenate(odd)
        whole = pd.DataFrame({"shape": x, "other": pd.array([pd.NA] * len(x), "Int64"), "ahead": sums[:, 0], "level": sums[:, 1]})
        return pd.concat([whole, pd.DataFrame({"shape": odd[:, 0], "other": pd.array(odd[:, 1], "Int64"), "ahead": 0, "level": 0})]) if len(odd) else whole

    mine, other = rows.withColumn("with", all_).groupBy("block", "with"), rows.withColumn("with", all_).groupBy("with", "block")
    if costs:
        return stored(mine.cogroup(other).applyInPandas(run, "shape long, other long, ahead long, level long"), "bound-counts")
    found = mine.cogroup(other).applyInPandas(run, "shape long, passed long")
    return stored(found.groupBy("shape").agg((F.sum("passed") - 1).alias("passed")), "bound-counts")


def costs(nodes: DataFrame, config: Config) -> DataFrame:
    """The row of edges.counted_costs(), for nodes numbered in byte order; no row is made for a pair.

    Who is on the left in a bound is the smaller node: of two fronts all nodes of one are smaller. Pairs of shapes of one
    front whose bounds differ by side are counted by both shapes' nodes in order.
    """
    of = shaped(nodes)
    shapes = distinct(of)
    found = bound_counts(shapes, config, costs=True)
    sums = found.where("other is null").groupBy("shape").agg(F.sum("ahead").alias("ahead"), F.sum("level").alias("level")).join(shapes.select("shape", "n"), "shape")
    n = F.col("n").cast("decimal(18,0)")
    total = lambda c: F.coalesce(F.sum(c).cast("decimal(38,0)"), F.lit(0))
    plain = sums.agg(total(n * F.col("ahead") + n * (F.col("level") - 1) / 2).alias("plain"))
    odd = stored(found.where("other is not null").select("shape", "other"), "odd-pairs")
    named = odd.select("shape").unionByName(odd.select(F.col("other").alias("shape"))).distinct()
    ids = stored(of.join(named, "shape", "left_semi").groupBy("shape").agg(F.sort_array(F.collect_list("node_id")).alias("ids")), "odd-nodes")
    met = odd.join(ids, "shape").join(ids.select(F.col("shape").alias("other"), F.col("ids").alias("right")), "other")

    @F.pandas_udf("long")
    def before(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([int((len(y) - np.searchsorted(y, x)).sum()) for x, y in zip(a, b, strict=True)], dtype="int64")

    rest = met.select(before("ids", "right").alias("n")).agg(total(F.col("n")).alias("rest"))
    met = degree_sums(nodes, config.seed, config.seed_threshold).join(_ends(shapes), ["front", "back"])
    pairs = lambda c: (total(F.col("n").cast("decimal(18,0)") * F.col(c)) / 2).cast("long")
    whole = met.agg(pairs("hits").alias("index_hits"), pairs("candidates").alias("distinct_pairs"))
    passed = (F.col("plain") + F.col("rest")).cast("long")
    return whole.crossJoin(plain).crossJoin(rest).select("index_hits", "distinct_pairs", (F.col("distinct_pairs") - passed).alias("bound_rejected"), passed.alias("pairs_scored"))  # one row each


def _ends(shapes: DataFrame) -> DataFrame:
    return shapes.groupBy("front", "back").agg(F.sum("n").alias("n"))
