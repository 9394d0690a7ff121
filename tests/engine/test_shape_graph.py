"""Covers, costs and refinement by shapes against those of listed edges."""

import random

import pytest

from motifloom.operators import candidates, cover, edges, nodes, refine, shape_graph, shapes
from motifloom.plans import cluster as runs
from motifloom.plans.config import Config

rng = random.Random(9)
#: Several sequences of one shape, with different frequencies, and of one shape but for the mask.
SEQUENCES = ["".join(rng.choice("ALVIKFGDEW") for _ in range(rng.randint(8, 10))) for _ in range(60)] + ["ALV" + "G" * k + "KFW" for k in range(2, 6)] * 2 + ["ALI" + "GD"[k] * 3 + "KFW" for k in range(2)] + ["AAAGGGAAA", "AAADDDAAA", "AAADDDAAA"]
CONFIGS = [Config(mode="separate_kmer_anchor", kmer_threshold=0.5, anchor_threshold=0.35, margin=0.0), Config(mode="combined_kmer_anchor", threshold=0.55, seed="contiguous", seed_threshold=0.7)]


@pytest.fixture(scope="module")
def known(spark):
    return nodes.features(nodes.load(spark.createDataFrame([(s,) for s in SEQUENCES], "sequence string"))).cache()


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("config", CONFIGS)
def test_covers_by_shapes_are_those_of_edges(known, config):
    graph, found = shape_graph.ShapeGraph(known, config), shapes.edges(known, config).cache()
    assert rows(graph.edges()) == rows(found)
    assert rows(graph.coverage()) == rows(cover.coverage(known, found, 10).select("node_id", "rep"))
    pairs = candidates.candidates(known, config.seed, config.seed_threshold)
    assert rows(graph.kmer_degree()) == rows(cover.kmer_degree(known, found, runs.survivors(pairs, known, config)))


@pytest.mark.parametrize("config", CONFIGS)
def test_costs_by_shapes_are_those_of_pairs(known, config):
    want = edges.counted_costs(candidates.candidates(known, config.seed, config.seed_threshold), known, config).first()
    assert tuple(shape_graph.costs(known, config).first()) == tuple(want) and 0 < want.pairs_scored


@pytest.mark.parametrize(("config", "method"), [(CONFIGS[0], "graph"), (CONFIGS[1], "graph"), (CONFIGS[1], "greedy")])
def test_refinement_by_shapes_is_that_of_edges(known, config, method):
    config = Config(**{**config.__dict__, "method": method})
    graph, found = shape_graph.ShapeGraph(known, config, every=method == "greedy"), shapes.edges(known, config).cache()
    start = cover.intrinsic(known, found).cache()
    pairs = candidates.candidates(known, config.seed, config.seed_threshold).cache()
    scores = runs.greedy.PairScores.of(known, config) if method == "greedy" else None
    want, progress = refine.converge(start, pairs if scores else found, known, config, scores)
    got, own = graph.converge(start)
    assert rows(got) == rows(want.select("node_id", "rep")) != rows(start) and own == progress


def test_only_clusters_with_other_members_choose_again(known, monkeypatch):
    """After the first round representatives are chosen anew for clusters that gained or lost members alone, and the end is the same."""
    config, asked, of = CONFIGS[0], [], shape_graph.ShapeGraph.represented
    graph, found = shape_graph.ShapeGraph(known, config), shapes.edges(known, config).cache()
    start = cover.intrinsic(known, found).cache()
    monkeypatch.setattr(shape_graph.ShapeGraph, "represented", lambda self, state: (asked.append(state.select("rep").distinct().count()), of(self, state))[1])
    got, own = graph.converge(start)
    want, progress = refine.converge(start, found, known, config)
    assert rows(got) == rows(want.select("node_id", "rep")) and own == progress and own.iterations > 1
    assert max(asked[1:], default=0) < asked[0] and len(asked) < 2 * own.iterations


def test_shape_pairs_in_blocks_are_all_pairs(known, monkeypatch):
    """Pairs of shapes in blocks of any size are those of all shapes, and pairs under the anchor bound are no rows."""
    made, of = [], shapes.distinct(shapes.shaped(known)).cache()
    real = shapes.stored
    monkeypatch.setattr(shapes, "stored", lambda df, name: (out := real(df, name), made.append(out) if name == "terminal-pairs" else None)[0])
    config = CONFIGS[1]
    for block in (2000, 7):
        monkeypatch.setattr(shapes, "BLOCK", block)
        plain = shapes.shape_pairs(of, 600, ("contiguous", 0.7))
        shapes.shape_edges(of, config, (config.seed, config.seed_threshold)).count()
    side = lambda s: of.select(*[shapes.F.col(c).alias(s + c) for c in ("shape", "front", "back")])
    met = side("a").crossJoin(side("b")).where("ashape <= bshape").collect()
    near = shapes.seeded("contiguous")
    score = lambda r: (int(shapes.similar(r.afront, r.bfront)) + int(shapes.similar(r.aback, r.bback)) + 1) // 2
    want = sorted((r.ashape, r.bshape, score(r)) for r in met if score(r) >= 600 and min(int(near(r.afront, r.bfront)), int(near(r.aback, r.bback))) >= 700)
    assert rows(plain.select("sa", "sb", "kmer")) == want and len(want) > len(of.collect())
    gate = 2 * config.primary_q - 1001
    low = [df.where(shapes.anchor_bound(shapes.F.col("ah"), shapes.F.col("bh")) < gate).count() for df in made[1::2]]
    assert low == [0, 0] and rows(made[1].select("sa", "sb", "kmer")) == rows(made[3].select("sa", "sb", "kmer"))


@pytest.mark.parametrize("config", [Config(mode="separate_kmer_anchor", kmer_threshold=0.5, anchor_threshold=0.35), Config(mode="combined_kmer_anchor", threshold=0.6, seed="contiguous", seed_threshold=0.7)])
def test_the_prefilter_is_that_of_nodes(spark, config):
    own = random.Random(9)
    some = lambda n: "".join(own.choice("ALVI") for _ in range(n))
    sequences = {own.choice(("ALV", "AVL", some(3))) + some(own.randint(2, 4)) + own.choice(("ALI", some(3))) for _ in range(90)} | {"AAA" + "GD"[k] * 3 + "AAA" for k in range(2)}
    known = nodes.features(nodes.load(spark.createDataFrame([(s,) for s in sequences], "sequence string"))).cache()
    pairs = candidates.candidates(known, config.seed, config.seed_threshold)
    first = edges.prefilter_edges(known, config, pairs)
    found = cover.coverage(known, first)
    graph = shape_graph.ShapeGraph(known, config)
    rows = lambda df, *names: sorted(tuple(r) for r in df.select(*names).collect())
    want = rows(found, "node_id", "rep")
    assert rows(graph.provisional(), "node_id", "rep") == want and 2 < len({r for _, r in want}) < len(want)
    scope = cover.scopes(found).where("is_rep or not assigned")
    want = rows(edges.united(first, edges.edges(candidates.within(pairs, scope), known, config)), "u", "v", "weight")
    assert rows(graph.united(), "u", "v", "weight") == want and first.count() < len(want) < edges.edges(pairs, known, config).count()
