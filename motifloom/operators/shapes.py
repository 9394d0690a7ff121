"""Pairs by shapes: what depends on both ends and the mask alone is worked out for pairs of distinct shapes, not of nodes.

A shape is a front, a back (codes of operators.ends) and a mask. Sums over all pairs make no row for a pair at all.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifloom.functions.scores import LONG, SHORT, alignments, anchor_bound, anchor_similarity, packed_bounds
from motifloom.operators.candidates import DIMERS
from motifloom.operators.cover import ordered
from motifloom.operators.edges import eligible, weighed
from motifloom.operators.ends import ENDS, end_code, end_scores, in_bytes, scored, seed_hits, seeded, similar
from motifloom.operators.tables import stored
from motifloom.plans.config import Config

#: Pairs of ends that a task compares at once.
CELLS = 1 << 20
#: Shapes of one block, whole fronts; blocks meet each other, a group each.
BLOCK = 2000
#: Pairs of sequences that a task holds to align.
ALIGNED = 100_000


def shaped(nodes: DataFrame) -> DataFrame:
    """(node_id, front, back, mask, h, shape) of nodes, stored."""
    front, back = end_code(F.col("t"), False), end_code(F.col("t"), True)
    out = nodes.select("node_id", front.alias("front"), back.alias("back"), "mask", "h")
    return stored(out.withColumn("shape", F.col("front").cast("long") * ENDS * 64 + F.col("back") * 64 + F.col("mask")), "shapes")


def distinct(of: DataFrame) -> DataFrame:
    """(shape, front, back, mask, h, n): the distinct shapes of shaped nodes and how many nodes have them, stored."""
    return stored(of.groupBy("shape").agg(*[F.first(c).alias(c) for c in ("front", "back", "mask", "h")], F.count("*").alias("n")), "distinct-shapes")


def _end_sums(asked: DataFrame, half: DataFrame, measure: Callable[[np.ndarray, np.ndarray, pd.DataFrame], np.ndarray], names: tuple[str, ...]) -> DataFrame:
    """(front, back, names): for each of the distinct rows asked(front, back) the sums of measure(backs, other backs, rows) over the rows of half(of, other, ...) with its front; at most 8,000 groups of 8,000 backs each."""

    def run(key, own: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        backs, other = own["back"].to_numpy(np.int64), near["other"].to_numpy(np.int64)[None, :]
        step = max(1, CELLS // max(1, len(near)))
        found = [measure(backs[i : i + step, None], other, near) for i in range(0, len(backs), step)]
        sums = np.concatenate(found) if found else np.zeros((0, len(names)))
        return pd.DataFrame({"front": np.full(len(backs), key[0], np.int32), "back": backs.astype(np.int32)} | {c: sums[:, k].astype(np.int64) for k, c in enumerate(names)})

    by = asked.select("front", "back").groupBy("front").cogroup(half.groupBy("of"))
    return by.applyInPandas(run, "front int, back int, " + ", ".join(f"{c} long" for c in names))


def _counted(nodes: DataFrame) -> DataFrame:
    front, back = end_code(F.col("t"), False), end_code(F.col("t"), True)
    return stored(nodes.groupBy(front.alias("front"), back.alias("back")).agg(F.count("*").alias("n")), "end-counts")


def _others(counts: DataFrame) -> DataFrame:
    return counts.select(F.col("front").alias("y"), F.col("back").alias("other"), "n")


def degree_sums(nodes: DataFrame, seed: str, threshold: float) -> DataFrame:
    """(front, back, candidates, hits, kmer): of a node with these ends how many candidates it has, through how many similar keys, and the sum of their terminal similarities.

    Nodes are counted by ends; for each front these counts are added up by the other back, weighed by what the fronts
    add; only these sums meet the backs. A node's meeting with itself is taken off.
    """
    at, seeds, meets = round(threshold * 1000), seeded(seed), seed_hits(seed, threshold)
    counts = _counted(nodes)
    fronts = end_scores(counts.select(F.col("front").alias("x")), counts.select(F.col("front").alias("y")), {"close": at}, close=seeds, score=similar, met=meets)
    n, sums = F.col("n"), (("n", F.lit(1)), ("s", F.col("score")), ("odd", F.col("score") % 2), ("hit", F.col("met")))
    half = _others(counts).join(stored(fronts, "near-fronts"), "y").groupBy(F.col("x").alias("of"), "other").agg(*[F.sum(n * c).alias(to) for to, c in sums])

    def measure(x: np.ndarray, y: np.ndarray, rows: pd.DataFrame) -> np.ndarray:
        n, s, odd, hit = (rows[c].to_numpy(np.float64) for c in ("n", "s", "odd", "hit"))  # whole numbers under 2 ** 53, so sums are exact
        ok, back = (seeds(x, y) >= at).astype(np.float64), similar(x, y)
        # the mean of both ends is rounded up where their sum is odd
        kmer = ok @ (s + odd) + (ok * back) @ n + (ok * (back % 2)) @ (n - 2 * odd)
        return np.stack([ok @ n, (ok * meets(x, y)) @ hit, kmer / 2], axis=1)

    found = _end_sums(counts, half, measure, ("candidates", "hits", "kmer"))
    own = scored(meets, F.col("front"), F.col("front")) * scored(meets, F.col("back"), F.col("back"))
    return found.select("front", "back", (F.col("candidates") - 1).alias("candidates"), (F.col("hits") - own).cast("long").alias("hits"), (F.col("kmer") - 1000).alias("kmer"))


def degrees(nodes: DataFrame, seed: str, threshold: float) -> DataFrame:
    """(node_id, candidates, hits, kmer) of the nodes that have candidates; see degree_sums()."""
    own = nodes.select("node_id", end_code(F.col("t"), False).alias("front"), end_code(F.col("t"), True).alias("back"))
    return own.join(degree_sums(nodes, seed, threshold), ["front", "back"]).where("candidates > 0").select("node_id", "candidates", "hits", "kmer")


def retained(nodes: DataFrame, seed: str, threshold: float, terminal: int) -> DataFrame:
    """One row, (retrieved, kept): how many pairs the seeds retrieve and how many of them have a terminal similarity of `terminal` or more."""
    at, seeds = round(threshold * 1000), seeded(seed)
    counts = _counted(nodes)
    ends_ = counts.select(F.col("front").alias("x")), counts.select(F.col("front").alias("y"))
    fronts = stored(end_scores(*ends_, {"close": at}, close=seeds, score=similar), "near-fronts")
    half = _others(counts).join(fronts, "y").groupBy(F.col("x").alias("of"), "other", "score").agg(F.sum("n").alias("n"))

    def measure(x: np.ndarray, y: np.ndarray, rows: pd.DataFrame) -> np.ndarray:
        n, ok = rows["n"].to_numpy(np.float64), seeds(x, y) >= at
        high = ok & ((similar(x, y) + rows["score"].to_numpy(np.int64)[None, :] + 1) // 2 >= terminal)
        return np.stack([ok.astype(np.float64) @ n, high.astype(np.float64) @ n], axis=1)

    met = counts.join(_end_sums(counts, half, measure, ("retrieved", "kept")), ["front", "back"])
    # each pair is met from both sides; a node's meeting with itself scores 1000
    pairs = lambda c, own: F.coalesce(F.floor(F.sum(F.col("n") * (F.col(c) - own)) / 2), F.lit(0)).cast("long").alias(c)
    return met.agg(pairs("retrieved", 1), pairs("kept", 1 if terminal <= 1000 else 0))


def alike(nodes: DataFrame, terminal: int) -> DataFrame:
    """One row, (alike): how many pairs have a terminal similarity of `terminal` or more, whichever seeds they have."""
    counts = _counted(nodes)
    ends_ = counts.select(F.col("front").alias("x")), counts.select(F.col("front").alias("y"))
    fronts = stored(end_scores(*ends_, {"score": 2 * terminal - 1001}, score=similar), "near-fronts")
    half = _others(counts).join(fronts, "y").groupBy(F.col("x").alias("of"), "other", "score").agg(F.sum("n").alias("n"))

    def measure(x: np.ndarray, y: np.ndarray, rows: pd.DataFrame) -> np.ndarray:
        high = (similar(x, y) + rows["score"].to_numpy(np.int64)[None, :] + 1) // 2 >= terminal
        return (high.astype(np.float64) @ rows["n"].to_numpy(np.float64))[:, None]

    met = counts.join(_end_sums(counts, half, measure, ("alike",)), ["front", "back"])
    own = 1 if terminal <= 1000 else 0  # each pair is met from both sides; a node's meeting with itself scores 1000
    return met.agg(F.coalesce(F.floor(F.sum(F.col("n") * (F.col("alike") - own)) / 2), F.lit(0)).cast("long").alias("alike"))


def searched(nodes: DataFrame, seed: str, threshold: float, terminal: int) -> DataFrame:
    """One row, (true_pairs, scored_pairs, shared_pairs): pairs with a terminal similarity of `terminal` or more, pairs that the seeds retrieve, and pairs that are both; no pair is listed."""
    found = retained(nodes, seed, threshold, terminal).select(F.col("retrieved").alias("scored_pairs"), F.col("kept").alias("shared_pairs"))
    return alike(nodes, terminal).select(F.col("alike").alias("true_pairs")).crossJoin(found)  # one row each


def sampled(nodes: DataFrame, config: Config, samples: int = 2048) -> DataFrame:
    """The row of candidates.retention() for the seeds' candidates and those that edges.gate() keeps, for nodes numbered in byte order; no row is made for a pair.

    The sampled nodes, 4,096 at most (for 2,048 asked), meet the distinct shapes. Who is on the left in a bound is the smaller node: of two fronts all
    nodes of one are smaller. Nodes of a shape of the sampled node's front whose bounds differ by side are counted in order.
    """
    of = shaped(nodes)
    short = (F.size("h") == len(SHORT)).cast("int").alias("short")
    step = max(1, nodes.count() // samples)
    asked = of.where(F.col("node_id") % step == 0).select("node_id", "shape", short).toPandas().sort_values("shape")
    at, seeds, gate = round(config.seed_threshold * 1000), seeded(config.seed), config.anchor_q if config.separate else 2 * config.primary_q - 1001
    codes = lambda df: [df["shape"].to_numpy(np.int64) // (ENDS * 64), df["shape"].to_numpy(np.int64) // 64 % ENDS, df["short"].to_numpy(np.int64)]
    ids, x, (xf, xb, xs) = asked["node_id"].to_numpy(np.int64), asked["shape"].to_numpy(np.int64), codes(asked)
    fronts, starts = np.unique(xf, return_index=True)

    def run(batches):
        for df in batches:
            y, n, (yf, yb, ys) = df["shape"].to_numpy(np.int64), df["n"].to_numpy(np.int64), codes(df)
            xp, yp = (xf * ENDS + xb) * 2 + xs, (yf * ENDS + yb) * 2 + ys
            others, place = np.unique(yf, return_inverse=True)
            sums, odd = np.zeros(2, np.int64), []
            for front, lo, hi in zip(fronts.tolist(), starts.tolist(), [*starts[1:].tolist(), len(x)], strict=True):
                cols = np.flatnonzero((seeds(np.int64(front), others) >= at)[place])
                size = max(1, CELLS // max(1, len(cols)))
                for i in range(lo, hi, size) if len(cols) else ():
                    r, c = np.nonzero(seeds(xb[i : min(hi, i + size), None], yb[None, cols]) >= at)
                    r, c = r + i, cols[c]
                    many = n[c] - (x[r] == y[c])
                    ahead, back = packed_bounds(xp[r], yp[c]) >= gate, packed_bounds(yp[c], xp[r]) >= gate
                    level = yf[c] == front
                    kept = np.where(level, ahead & back, np.where(in_bytes(yf[c]) > in_bytes(np.int64(front)), ahead, back))
                    sums += many.sum(), many[kept].sum()
                    only = level & (ahead != back)
                    odd.append(pd.DataFrame({"node_id": ids[r[only]], "shape": y[c[only]], "ahead": ahead[only], "retrieved": 0, "kept": 0}))
            yield pd.concat([pd.DataFrame({"node_id": [-1], "shape": [-1], "ahead": [False], "retrieved": sums[:1], "kept": sums[1:]}), *odd])

    parts = 4 * int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = distinct(of).select("shape", short, "n", "front").repartition(parts, "front")
    found = stored(rows.mapInPandas(run, "node_id long, shape long, ahead boolean, retrieved long, kept long"), "sampled")
    odd = found.where("node_id >= 0").select("shape", F.col("node_id").alias("x"), "ahead").join(of.select("shape", "node_id"), "shape")
    odd = odd.agg(F.count_if(F.when(F.col("ahead"), F.col("node_id") > F.col("x")).otherwise(F.col("node_id") < F.col("x"))).alias("odd"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = found.agg(total("retrieved").alias("retrieved"), total("kept").alias("plain"))
    return sums.crossJoin(odd).select("retrieved", (F.col("plain") + F.col("odd")).alias("kept"))  # one row each


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many different values each row of one table of anchor values has in common with each row of another."""
    return (a @ b.T).astype(np.int8)


def _values(h: pd.Series) -> np.ndarray:
    """A row for each list of anchor values, with 1 at its values."""
    out = np.zeros((len(h), DIMERS), np.float32)
    for i, v in enumerate(h):
        out[i, np.asarray(v, np.int64)] = 1
    return out


def anchor_sums(nodes: DataFrame, least: int = 2) -> DataFrame:
    """(shared, pairs, sum_u, sum_v): candidates.anchor_pairs() by the number of shared values, counted and their ids added up, for nodes numbered in byte order.

    Of two fronts all nodes of one are smaller, so shapes of different fronts add up by their numbers and sums of ids, in blocks of
    whole fronts in byte order that meet each other. Within a front nodes are added up in order. No row is made for a pair.
    """
    of = shaped(nodes)
    found = stored(of.groupBy("shape").agg(F.first("front").alias("front"), F.first("h").alias("h"), F.count("*").alias("n"), F.sum("node_id").alias("ids")), "anchor-shapes")
    blocks, total = np.zeros(ENDS, np.int64), 0
    for r in sorted(found.groupBy("front").count().collect(), key=lambda r: int(in_bytes(np.int64(r.front)))):  # 8,000 at most
        blocks[r.front] = total // BLOCK
        total += r["count"]
    last = max(0, total - 1) // BLOCK
    most = 1 + max(len(SHORT), len(LONG))

    @F.pandas_udf("int")
    def block(front: pd.Series) -> pd.Series:
        return pd.Series(blocks[front.to_numpy(np.int64)].astype(np.int32))

    def summed(sums: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"shared": np.arange(least, most, dtype=np.int32), "pairs": sums[least:, 0], "sum_u": sums[least:, 1], "sum_v": sums[least:, 2]})

    def between(own: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        if own.empty or near.empty:  # a large front leaves numbers of blocks without shapes
            return summed(np.zeros((most, 3), np.int64))
        a, b = _values(own["h"]), _values(near["h"])
        (xf, xn, xi), (yf, yn, yi) = ([df[c].to_numpy(np.int64) for c in ("front", "n", "ids")] for df in (own, near))
        xf, yf, sums = in_bytes(xf), in_bytes(yf), np.zeros((most, 3), np.int64)
        weights = np.stack([yn, yi], axis=1).astype(np.float64)  # whole numbers whose sums are under 2 ** 53
        step = max(1, CELLS // max(1, len(near)))
        for i in range(0, len(own), step):
            rows = slice(i, i + step)
            shared = _shared(a[rows], b)
            shared[xf[rows, None] >= yf[None, :]] = 0
            for k in range(least, most):
                n, ids = ((shared == k).astype(np.float64) @ weights).astype(np.int64).T
                sums[k] += (xn[rows] * n).sum(), (xi[rows] * n).sum(), (xn[rows] * ids).sum()
        return summed(sums)

    def within(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("node_id", ascending=False)
        shapes, first, at = np.unique(df["shape"].to_numpy(np.int64), return_index=True, return_inverse=True)
        values = _values(df["h"].iloc[first])
        shared = np.concatenate([_shared(values[i : i + BLOCK], values) for i in range(0, len(values), BLOCK)])
        n, ids, sums = np.zeros(len(shapes)), np.zeros(len(shapes)), np.zeros((most, 3), np.int64)
        for x, k in zip(df["node_id"].tolist(), at.tolist(), strict=True):  # n and ids are of the larger nodes
            many, total = (np.bincount(shared[k], weights=w, minlength=most).astype(np.int64) for w in (n, ids))
            sums += np.stack([many, x * many, total], axis=1)
            n[k] += 1
            ids[k] += x
        return summed(sums)

    rows, ddl, parts = found.withColumn("block", block("front")), "shared int, pairs long, sum_u long, sum_v long", 4 * int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mine = rows.withColumn("with", F.explode(F.sequence("block", F.lit(last)))).select("*", F.col("block").alias("i"), F.col("with").alias("j"))
    other = rows.withColumn("with", F.explode(F.sequence(F.lit(0), "block"))).select("*", F.col("with").alias("i"), F.col("block").alias("j"))
    blocked = mine.repartition(parts, "i", "j").groupBy("i", "j").cogroup(other.repartition(parts, "i", "j").groupBy("i", "j")).applyInPandas(between, ddl)
    level = of.select("front", "shape", "node_id", "h").groupBy("front").applyInPandas(within, ddl)
    # stored, as a count() would have Spark leave out columns that the groups read
    sums = stored(blocked.unionByName(level), "anchor-sums").groupBy("shared").agg(*[F.sum(c).alias(c) for c in ("pairs", "sum_u", "sum_v")])
    return sums.where("pairs > 0")


def shape_pairs(shapes: DataFrame, terminal: int, seed: tuple[str, float] | None = None, bound: int | None = None) -> DataFrame:
    """(sa, sb, ah, bh, na, nb, kmer), sa <= sb: pairs of distinct() shapes with at least this terminal similarity and, with seed, a similar front dimer and a similar back dimer.

    bound: only those with at least this anchor bound. Blocks of shapes, whole fronts, meet each other, so that only pairs that pass become rows.
    """
    total, at, seeds = 2 * terminal - 1, round(seed[1] * 1000) if seed else 0, seeded(seed[0]) if seed else None
    blocks, parts = max(1, -(-shapes.count() // BLOCK)), 4 * int(shapes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = shapes.select("shape", "front", "back", (F.size("h") == len(SHORT)).cast("int").alias("short"), "h", "n", F.pmod(F.xxhash64("front"), F.lit(blocks)).cast("int").alias("block"))

    def run(own: pa.Table, near: pa.Table) -> pa.Table:
        own, near = own.sort_by("shape"), near.sort_by("shape")
        (x, xf, xb, xs), (y, yf, yb, ys) = ([t[c].to_numpy().astype(np.int64) for c in ("shape", "front", "back", "short")] for t in (own, near))
        xp, yp = (xf * ENDS + xb) * 2 + xs, (yf * ENDS + yb) * 2 + ys
        fronts, starts = np.unique(xf, return_index=True)
        others, of = np.unique(yf, return_inverse=True)
        found = [np.zeros((3, 0), np.int64)]
        for front, lo, hi in zip(fronts.tolist(), starts.tolist(), [*starts[1:].tolist(), len(x)], strict=True):
            score = similar(np.int64(front), others).astype(np.int64)
            close = (score >= total - 1000) & (others >= front)  # shapes are ordered by front first
            if seed:
                close &= seeds(np.int64(front), others) >= at
            cols = np.flatnonzero(close[of])
            step = max(1, CELLS // max(1, len(cols)))
            for i in range(lo, hi, step) if len(cols) else ():
                back = similar(xb[i : min(hi, i + step), None], yb[None, cols])
                r, c = np.nonzero(back >= total - score[of[cols]])
                mean = (score[of[cols[c]]] + back[r, c] + 1) // 2
                r, c = r + i, cols[c]
                keep = np.flatnonzero(x[r] <= y[c])
                if seed:
                    keep = keep[seeds(xb[r[keep]], yb[c[keep]]) >= at]
                if bound is not None:
                    keep = keep[packed_bounds(xp[r[keep]], yp[c[keep]]) >= bound]
                found.append(np.stack([r[keep], c[keep], mean[keep]]))
        r, c, mean = np.concatenate(found, axis=1)
        a, b = own.take(pa.array(r)), near.take(pa.array(c))
        return pa.table({"sa": a["shape"], "sb": b["shape"], "ah": a["h"], "bh": b["h"], "na": a["n"], "nb": b["n"], "kmer": pa.array(mean.astype(np.int32))})

    met = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    mine, other = (met.select("*", F.col(i).alias("i"), F.col(j).alias("j")).repartition(parts, "i", "j").groupBy("i", "j") for i, j in (("block", "with"), ("with", "block")))
    h = shapes.schema["h"].dataType.simpleString()
    return stored(mine.cogroup(other).applyInArrow(run, f"sa long, sb long, ah {h}, bh {h}, na long, nb long, kmer int"), "terminal-pairs")


def _bounded(pairs: DataFrame, least: int) -> DataFrame:
    near = pairs.where(anchor_bound(F.col("ah"), F.col("bh")) >= least)
    return near.withColumn("anchor", anchor_similarity(F.col("ah"), F.col("bh"))).where(F.col("anchor") >= least)


def shape_edges(shapes: DataFrame, config: Config, seed: tuple[str, float] | None) -> DataFrame:
    """Pairs of shapes whose nodes are edges, with their scores; in aligned modes those that the alignment may make edges."""
    other = 2 * config.primary_q - 1001
    least = 0 if config.aligned else (config.primary_q if config.separate else other)
    bound = config.anchor_q if config.separate else other
    met = _bounded(shape_pairs(shapes, least, seed, bound), bound)
    return met if config.aligned else eligible(weighed(met.withColumn("alignment", F.lit(0)), config), config)


def expanded(pairs: DataFrame, of: DataFrame, *keep: str | Column) -> DataFrame:
    """(u, v, keep), u < v: the pairs of shaped nodes of pairs(sa, sb, ...) of shapes; i is the node of sa, j that of sb."""
    side = lambda s, to: of.select(F.col("shape").alias(s), F.col("node_id").alias(to))
    met = pairs.join(side("sa", "i"), "sa").join(side("sb", "j"), "sb").where("sa != sb or i < j")
    return met.select(F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v"), *keep)


def edges(nodes: DataFrame, config: Config, seed: tuple[str, float] | None = None) -> DataFrame:
    """The edges among the candidates of a seed and its threshold (the settings' own by default), as operators.edges gives them: scored by shapes, expanded to nodes last; only alignments are of nodes."""
    of = shaped(nodes)
    met = stored(shape_edges(distinct(of), config, seed or (config.seed, config.seed_threshold)), "shape-edges")
    scores = ("weight", "kmer", "anchor", "alignment", "combined")
    if not config.aligned:
        return expanded(met, of, *scores)
    return eligible(weighed(_aligned(met, of, nodes, config), config), config).select("u", "v", *scores)


def _aligned(met: DataFrame, of: DataFrame, nodes: DataFrame, config: Config) -> DataFrame:
    """(u, v, kmer, anchor, alignment) of the pairs of nodes of met(sa, sb, ...) whose alignment lets them be edges; ALIGNED at a time, as equal lengths are aligned at once."""
    text = stored(of.select("node_id", "shape").join(nodes.select("node_id", "sequence"), "node_id"), "shape-sequences")
    side = lambda s, to: text.select(F.col("shape").alias(s), F.col("node_id").alias(to), F.col("sequence").alias(f"{to}_s"))
    parts = 4 * int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = met.select("sa", "sb", "kmer", "anchor").repartition(parts, "sa", "sb")  # so that those of many nodes are dealt out
    pairs = pairs.join(side("sa", "i"), "sa").join(side("sb", "j"), "sb").where("sa != sb or i < j").select("i", "j", "kmer", "anchor", "i_s", "j_s")

    def scored(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        one = lambda c: t[c].combine_chunks()
        i, j, kmer, anchor = (one(c).to_numpy() for c in ("i", "j", "kmer", "anchor"))
        alignment = alignments(one("i_s"), one("j_s"), config.gaps, config.terminal_matches)
        ok = alignment >= config.primary_q if config.separate else alignment + anchor + 1 >= 2 * config.primary_q
        return pa.RecordBatch.from_arrays([pa.array(c[ok]) for c in (np.minimum(i, j), np.maximum(i, j), kmer, anchor, alignment)], names=["u", "v", "kmer", "anchor", "alignment"])

    def run(batches):
        held, many = [], 0
        for batch in batches:
            held.append(batch)
            many += batch.num_rows
            if many >= ALIGNED:
                yield scored(held)
                held, many = [], 0
        if many:
            yield scored(held)

    return pairs.mapInArrow(run, "u long, v long, kmer int, anchor int, alignment int")


def found_by(nodes: DataFrame, terminal: int, *seeds: tuple[str, float]) -> DataFrame:
    """(u, v), u < v, each once: the pairs with at least this terminal similarity that any of the seeds, with its threshold, retrieves."""
    of = shaped(nodes)
    shapes, met = distinct(of), None
    for seed in seeds:
        more = shape_pairs(shapes, terminal, seed).select("sa", "sb")
        met = more if met is None else met.unionByName(more)
    return expanded(stored(met.distinct(), "shape-pairs"), of)


def terminal_edges(nodes: DataFrame, seed: str, threshold: float, terminal: int, bounds: bool = False) -> DataFrame:
    """(u, v, kmer) of the candidates with at least this terminal similarity; bounds: (u, v, bound) instead, the anchor bound with u on the left."""
    of = shaped(nodes)
    met = shape_pairs(distinct(of), terminal, (seed, threshold))
    if not bounds:
        return expanded(met, of, "kmer")
    both = met.select("sa", "sb", anchor_bound(F.col("ah"), F.col("bh")).alias("ab"), anchor_bound(F.col("bh"), F.col("ah")).alias("ba"))
    return expanded(stored(both, "shape-pairs"), of, F.when(F.col("i") < F.col("j"), F.col("ab")).otherwise(F.col("ba")).alias("bound"))


def intrinsic(nodes: DataFrame, config: Config) -> DataFrame:
    """(node_id, rep): cover.intrinsic() of edges(), without a list of edges between nodes.

    Nodes of one shape are beside each other and have the same neighbours, so a representative that takes one takes all:
    the first of each shape, in the cover's order, decides for all of them. Alignments are of nodes, so their modes have no such cover.
    """
    if config.aligned:
        raise ValueError("the modes with alignments do not score by shapes")
    of = shaped(nodes)
    met = shape_edges(distinct(of), config, (config.seed, config.seed_threshold)).where("sa != sb").select("sa", "sb")
    place = F.struct((-F.length("sequence")).alias("length"), "sequence")
    first = of.join(nodes.select("node_id", "sequence"), "node_id").groupBy("shape").agg(F.min_by("node_id", place).alias("node_id"), F.min_by("sequence", place).alias("sequence"))
    first = stored(first, "first-nodes")
    side = lambda s, to: first.select(F.col("shape").alias(s), F.col("node_id").alias(to))
    links = stored(met.join(side("sa", "u"), "sa").join(side("sb", "v"), "sb").select("u", "v"), "shape-links")
    cover = ordered(first.select("node_id", "sequence"), links, -F.length("sequence"), F.col("sequence"))
    reps = first.select("shape", "node_id").join(cover, "node_id").select("shape", "rep")
    return of.select("node_id", "shape").join(reps, "shape").select("node_id", "rep")


def pair_count() -> Column:
    """How many pairs of nodes a pair of shapes (sa, sb, na, nb) stands for."""
    return F.when(F.col("sa") == F.col("sb"), F.floor(F.col("na") * (F.col("na") - 1) / 2)).otherwise(F.col("na") * F.col("nb")).cast("long")


def recall(nodes: DataFrame, config: Config, *seeds: tuple[str, float]) -> DataFrame:
    """(seed, threshold, found, eligible): of all pairs that are edges by the settings, whichever seeds they have, how many each seed retrieves; counted by shapes."""
    shapes = distinct(shaped(nodes))
    met = stored(shape_edges(shapes, config, None).select("sa", "sb", pair_count().alias("n")), "shape-edges")
    front, back = lambda s: F.floor(F.col(s) / (ENDS * 64)).cast("int"), lambda s: (F.floor(F.col(s) / 64) % ENDS).cast("int")
    whole = F.coalesce(F.sum("n"), F.lit(0)).alias("eligible")
    rows = []
    for seed, at in seeds:
        close = [scored(seeded(seed), end("sa"), end("sb")) >= round(at * 1000) for end in (front, back)]
        rows.append(met.withColumn("in", close[0] & close[1]).agg(F.coalesce(F.sum(F.when(F.col("in"), F.col("n"))), F.lit(0)).alias("found"), whole).select(F.lit(seed).alias("seed"), F.lit(at).alias("threshold"), "found", "eligible"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
