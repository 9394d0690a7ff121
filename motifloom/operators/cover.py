"""Set covers of a similarity graph by rounds of joins that give what the sequential greedy covers give.

edges(u, v, weight) are undirected; nodes without edges are clusters of their own. Results are
(node_id, rep): the representative of each node, its own for representatives.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from motifloom.operators.tables import ranked, stored, symmetric

#: What is left of a graph is finished in one task, in turn, once it has no more nodes and no more edges than this: rounds are for larger rests.
SMALL = 200_000


def _in_one_task(nodes: DataFrame, links: DataFrame, step, schema: str, small: int) -> DataFrame | None:
    """step over all of nodes and links in one task; None where these are more than `small` rows."""
    if nodes.limit(small + 1).count() > small or links.limit(small + 1).count() > small:
        return None
    one = lambda df: df.withColumn("_all", F.lit(0)).groupBy("_all")
    return one(nodes).cogroup(one(links)).applyInPandas(lambda n, e: step(n, e), schema)


def _neighbours(ids: pd.Series, links: pd.DataFrame) -> dict[int, dict[int, int]]:
    near: dict[int, dict[int, int]] = {x: {} for x in ids}
    for u, v, w in links[["u", "v", "weight"]].itertuples(index=False):
        near[u][v] = near[v][u] = w
    return near


def _coverage_in_turn(nodes: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
    near = _neighbours(nodes["node_id"], links)
    frequency, many, own = (dict(zip(nodes["node_id"], nodes[c], strict=True)) for c in ("frequency", "many", "own"))
    n = {x: many[x] - 1 + sum(many[y] for y in near[x]) for x in near}
    w = {x: own[x] * (many[x] - 1) + sum(many[y] * k for y, k in near[x].items()) for x in near}
    key = lambda x: (-n[x], -w[x], -frequency[x], x)
    heap, out = [key(x) for x in near], []
    heapq.heapify(heap)
    while heap:
        top = heapq.heappop(heap)
        rep = top[3]
        if rep not in near:
            continue
        if top != (now := key(rep)):  # it has lost neighbours meanwhile
            heapq.heappush(heap, now)
            continue
        at = (-top[0], -top[1], -top[2], -rep)
        for x in (rep, *near[rep]):
            out.append((x, rep, *at))
            for y, k in near.pop(x).items():
                if y in near:
                    near[y].pop(x, None)
                    n[y] -= many[x]
                    w[y] -= k * many[x]
    return pd.DataFrame(out, columns=["node_id", "rep", "n", "w", "frequency", "id"])


def _ordered_in_turn(nodes: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
    near, rep = _neighbours(nodes["node_id"], links.assign(weight=0)), {}
    for x in nodes.sort_values("place")["node_id"]:
        if x not in rep:
            rep[x] = x
            for y in near[x]:
                rep.setdefault(y, x)
    return pd.DataFrame(list(rep.items()), columns=["node_id", "rep"])


def coverage(nodes: DataFrame, edges: DataFrame, small: int = SMALL) -> DataFrame:
    """The greedy cover by coverage: again and again the node with the most unassigned neighbours becomes a representative and takes them.

    Ties go to the larger sum of edge weights, the larger frequency, the smaller id. A choice
    changes the keys of nodes at most two steps away, and keys only fall; so in each round every
    unassigned node whose key is the largest within two steps is chosen, which gives the same
    clusters as one choice at a time. A rest of at most `small` nodes and edges is worked off in turn in one task.
    `at` is the key of the representative when it was chosen, by which descending initial clusters are numbered.
    A row of nodes that has `many` stands for so many nodes that are beside each other, with edges of the weight `own`, and have the same neighbours.
    """
    links = stored(edges.select("u", "v", "weight"), "graph")
    both = symmetric(links)
    held = [F.col(c).cast("long").alias(c) if c in nodes.columns else F.lit(default).cast("long").alias(c) for c, default in (("many", 1), ("own", 0))]
    free = stored(nodes.select("node_id", F.col("frequency").cast("long").alias("frequency"), *held), "free")
    done = None
    while True:
        if (rest := _in_one_task(free, links, _coverage_in_turn, "node_id long, rep long, n long, w long, frequency long, id long", small)) is not None:
            rest = stored(rest.select("node_id", "rep", F.struct("n", "w", "frequency", "id").alias("key")), "taken")
            done = rest if done is None else done.unionByName(rest)
            return done.select("node_id", "rep", F.col("key").alias("at"))
        beside = both.join(free.select(F.col("node_id").alias("dst"), F.col("many").alias("times")), "dst")
        degree = beside.groupBy("src").agg(F.sum("times").alias("n"), F.sum(F.col("weight") * F.col("times")).alias("w"))
        more = F.col("many") - 1
        key = F.struct((F.coalesce("n", F.lit(0)) + more).alias("n"), (F.coalesce("w", F.lit(0)) + F.col("own") * more).alias("w"), "frequency", (-F.col("node_id")).alias("id"))
        keyed = stored(free.join(degree, free.node_id == degree.src, "left").select("node_id", "frequency", key.alias("key")), "keys")
        one = most_around(keyed.select("node_id", "key"), both)
        two = most_around(one, both)
        chosen = keyed.join(two.select(F.col("node_id").alias("i"), F.col("key").alias("top")), F.col("node_id") == F.col("i")).where("key = top").select("node_id", "key")
        chosen = stored(chosen, "chosen")
        taken = both.join(chosen.select(F.col("node_id").alias("src"), "key"), "src").select(F.col("dst").alias("node_id"), F.col("src").alias("rep"), "key")
        taken = stored(taken.unionByName(chosen.select("node_id", F.col("node_id").alias("rep"), "key")), "taken")
        done = taken if done is None else done.unionByName(taken)
        free = stored(free.join(taken.select("node_id"), "node_id", "left_anti"), "free")
        if free.isEmpty():
            return done.select("node_id", "rep", F.col("key").alias("at"))
        still = lambda side: free.select(F.col("node_id").alias(side))
        links = stored(links.join(still("u"), "u", "left_semi").join(still("v"), "v", "left_semi"), "graph")
        both = symmetric(links)


def most_around(values: DataFrame, live: DataFrame) -> DataFrame:
    """The largest key of each node and its neighbours."""
    sent = live.join(values.select(F.col("node_id").alias("src"), "key"), "src").select(F.col("dst").alias("node_id"), "key")
    return values.unionByName(sent).groupBy("node_id").agg(F.max("key").alias("key"))


def ordered(nodes: DataFrame, edges: DataFrame, *order: Column, small: int = SMALL) -> DataFrame:
    """The cover in a fixed order of nodes: each node that no earlier representative took becomes one and takes its unassigned neighbours.

    A node is a representative once all its earlier neighbours are known not to be, and is none once
    one of them is; it joins the earliest representative beside it. At most `small` nodes and edges are worked off
    in turn in one task.
    """
    places = stored(ranked(nodes, *order, to="place").select("node_id", "place"), "places")
    if (whole := _in_one_task(places, edges.select("u", "v"), _ordered_in_turn, "node_id long, rep long", small)) is not None:
        return whole
    both = symmetric(edges.select("u", "v"))
    at = lambda name: places.select(F.col("node_id").alias(name), F.col("place").alias(f"{name}_at"))
    earlier = stored(both.join(at("src"), "src").join(at("dst"), "dst").where("dst_at < src_at").select("src", "dst", "dst_at"), "earlier")
    state = stored(places.select("node_id", "place", F.lit(None).cast("boolean").alias("is_rep")), "state")
    while True:
        known = state.where("is_rep is not null").select(F.col("node_id").alias("dst"), "is_rep")
        seen = earlier.join(known, "dst", "left").groupBy("src").agg(F.bool_or("is_rep").alias("beside"), F.count_if(F.col("is_rep").isNull()).alias("open"))
        verdict = F.when(F.col("is_rep").isNotNull(), F.col("is_rep")).when(F.coalesce("beside", F.lit(False)), False).when(F.coalesce("open", F.lit(0)) == 0, True)
        state = stored(state.join(seen, state.node_id == seen.src, "left").select("node_id", "place", verdict.alias("is_rep")), "state")
        if state.where("is_rep is null").isEmpty():
            break
    reps = state.where("is_rep").select(F.col("node_id").alias("dst"))
    joined = earlier.join(reps, "dst").groupBy("src").agg(F.min_by("dst", "dst_at").alias("rep"))
    return state.join(joined, state.node_id == joined.src, "left").select("node_id", F.when(F.col("is_rep"), F.col("node_id")).otherwise(F.col("rep")).alias("rep"))


def intrinsic(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The cover in the order of length, longest first, then of the sequence."""
    return ordered(nodes, edges, F.length("sequence").desc(), F.col("sequence"))


def kmer_degree(nodes: DataFrame, edges: DataFrame, survivors: DataFrame) -> DataFrame:
    """The cover in the order of how many candidates survive the bound with the node on the left, most first, then of the sequence.

    survivors(query, candidate) holds both directions, as the bound is not symmetric.
    """
    counts = survivors.groupBy(F.col("query").alias("node_id")).agg(F.count("*").alias("n"))
    counted = nodes.join(counts, "node_id", "left").select("node_id", "sequence", F.coalesce("n", F.lit(0)).alias("n"))
    return ordered(counted, edges, F.col("n").desc(), F.col("sequence"))


def scopes(cover: DataFrame) -> DataFrame:
    """(node_id, is_rep, assigned) of a provisional cover: clusters of one node leave it unassigned."""
    size = F.count("*").over(W.partitionBy("rep"))
    return cover.select("node_id", ((size > 1) & (F.col("node_id") == F.col("rep"))).alias("is_rep"), (size > 1).alias("assigned"))
