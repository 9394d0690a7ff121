"""Sums and edges by shapes against those of pairs of nodes."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from motifloom.functions.scores import terminal_similarity
from motifloom.operators import candidates, cover, edges, exhaustive, nodes, shapes
from motifloom.plans import cluster as runs
from motifloom.plans import queries
from motifloom.plans.config import Config

rng = random.Random(4)
#: Several sequences of one shape, and of one shape but for the mask.
SEQUENCES = sorted({"".join(rng.choice("ALVIKFGDEW") for _ in range(rng.randint(8, 11))) for _ in range(70)} | {"ALV" + "G" * k + "KFW" for k in range(2, 6)} | {"AAA" + "GD"[k] * 3 + "AAA" for k in range(2)})
SEEDS = [("contiguous", 0.7), ("all_column_pairs", 0.4)]


@pytest.fixture(scope="module")
def known(spark):
    return nodes.features(nodes.load(spark.createDataFrame([(s,) for s in SEQUENCES], "sequence string"))).cache()


def kmers(known, seed, at):
    sides = edges.with_sides(candidates.candidates(known, seed, at), known)
    return {(r.u, r.v): r.k for r in sides.select("u", "v", terminal_similarity(F.col("a.t"), F.col("b.t")).alias("k")).collect()}


@pytest.mark.parametrize(("seed", "at"), SEEDS)
def test_degrees_are_those_of_all_hits(known, seed, at):
    hits, kmer, pairs = Counter(), Counter(), Counter()
    for r in candidates.hits(known, seed, at).collect():
        hits.update((r.u, r.v))
    for (u, v), k in kmers(known, seed, at).items():
        for x in (u, v):
            kmer[x] += k
            pairs[x] += 1
    got = shapes.degrees(known, seed, at).collect()
    assert {r.node_id: (r.candidates, r.hits, r.kmer) for r in got} == {x: (pairs[x], hits[x], kmer[x]) for x in pairs} and len(got) == len(pairs) > 20


@pytest.mark.parametrize(("seed", "at"), SEEDS)
def test_retained_counts_all_pairs(known, seed, at):
    kmer = kmers(known, seed, at)
    for least in (600, 800, 1000):
        assert tuple(shapes.retained(known, seed, at, least).first()) == (len(kmer), sum(k >= least for k in kmer.values()))
    assert tuple(shapes.retained(known.where("false"), seed, at, 800).first()) == (0, 0)


@pytest.mark.parametrize("config", [
    Config(mode="separate_kmer_anchor", kmer_threshold=0.5, anchor_threshold=0.35), Config(mode="combined_kmer_anchor", threshold=0.6, seed="contiguous", seed_threshold=0.7),
    Config(mode="separate_aln_anchor", alignment_threshold=0.4, anchor_threshold=0.3), Config(mode="combined_full_anchor", threshold=0.55),
])
def test_edges_by_shapes_are_those_of_pairs(known, config):
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    want = rows(edges.edges(candidates.candidates(known, config.seed, config.seed_threshold), known, config))
    assert want and rows(shapes.edges(known, config)) == want


def test_recall_is_that_of_listed_pairs(known):
    config = Config(mode="separate_kmer_anchor", kmer_threshold=0.5, anchor_threshold=0.35)
    true = {(r.u, r.v) for r in exhaustive.all_edges(known, config).collect()}
    want = [(seed, at, len(true & {(r.u, r.v) for r in candidates.hits(known, seed, at).collect()}), len(true)) for seed, at in SEEDS]
    assert sorted(map(tuple, shapes.recall(known, config, *SEEDS).collect())) == sorted(want) and 0 < want[0][2] < len(true)


def test_terminal_edges_and_bounds_are_those_of_pairs(known):
    want = sorted((*p, k) for p, k in kmers(known, "contiguous", 0.7).items() if k >= 700)
    assert want and sorted(map(tuple, shapes.terminal_edges(known, "contiguous", 0.7, 700).collect())) == want
    pairs = runs.bounds(known.sparkSession.createDataFrame([p[:2] for p in want], "u long, v long"), known)
    assert sorted(map(tuple, shapes.terminal_edges(known, "contiguous", 0.7, 700, bounds=True).collect())) == sorted((r.u, r.v, r.bound) for r in pairs.collect())


@pytest.mark.parametrize("at", [0.5, 0.9])
def test_cover_by_shapes_is_that_of_nodes(known, at):
    config = Config(mode="separate_kmer_anchor", kmer_threshold=at, anchor_threshold=0.35)
    want = sorted(map(tuple, cover.intrinsic(known, shapes.edges(known, config)).collect()))
    assert sorted(map(tuple, shapes.intrinsic(known, config).collect())) == want and len({r for _, r in want}) < len(want)


@pytest.fixture(scope="module")
def crowded(spark):
    """Many nodes of a few fronts, so that bounds that differ by side meet within a front."""
    own = random.Random(6)
    some = lambda n: "".join(own.choice("ALVGDE") for _ in range(n))
    sequences = {own.choice(("ALV", "AVL", "GDE", "AAA")) + some(own.randint(2, 5)) + own.choice(("AAA", some(3))) for _ in range(160)}
    return nodes.features(nodes.load(spark.createDataFrame([(s,) for s in sequences], "sequence string"))).cache()


def test_anchor_sums_are_those_of_listed_pairs(crowded, known, monkeypatch):
    for of, block in ((crowded, 7), (crowded, 2000), (known, 20)):
        monkeypatch.setattr(shapes, "BLOCK", block)
        listed = candidates.anchor_pairs(of).groupBy("shared").agg(F.count("*").alias("pairs"), F.sum("u").alias("sum_u"), F.sum("v").alias("sum_v"))
        got = shapes.anchor_sums(of)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, listed.collect())) and got.columns == listed.columns and got.count() > 2
    assert shapes.anchor_sums(known.where("false")).count() == 0


@pytest.mark.parametrize("config", [Config(mode="separate_kmer_anchor", anchor_threshold=0.5), Config(mode="combined_kmer_anchor", threshold=0.7, seed="contiguous", seed_threshold=0.7)])
def test_sampled_candidates_are_those_of_listed_pairs(crowded, known, config):
    odd = 0
    for of in (crowded, known):
        pairs = candidates.candidates(of, config.seed, config.seed_threshold)
        sides = edges.with_sides(pairs, of)
        kept = sides.where(edges.gate(config)).select("u", "v")
        odd += sides.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("b").alias("a"), F.col("a").alias("b")).where(edges.gate(config)).count() != kept.count()
        for samples in (2, 9, 2048):
            want = candidates.retention(of, pairs, kept, samples).first()
            assert tuple(shapes.sampled(of, config, samples).first()) == tuple(want) and want.kept > 0
    assert odd or not config.separate
    assert tuple(shapes.sampled(known.where("false"), config).first()) == (0, 0)


def test_searched_counts_all_pairs(crowded, known):
    for of, least in ((crowded, 800), (known, 600), (known, 0)):
        config = Config(mode="separate_kmer_anchor", kmer_threshold=least / 1000, anchor_threshold=0.0)
        true, found = ({(r.u, r.v) for r in pairs.collect()} for pairs in (exhaustive.possible_pairs(of, config), candidates.candidates(of, "contiguous", 0.7)))
        assert tuple(shapes.searched(of, "contiguous", 0.7, least).first()) == (len(true), len(found), len(true & found)) and true
    assert tuple(shapes.searched(known.where("false"), "contiguous", 0.7, 800).first()) == (0, 0, 0)


def test_pairs_found_by_several_seeds_are_made_once(known):
    seeds = [("all_column_pairs", 0.95), ("contiguous", 0.2)]
    want = {p for seed, at in seeds for p, k in kmers(known, seed, at).items() if k >= 500}
    got = [(r.u, r.v) for r in shapes.found_by(known, 500, *seeds).collect()]
    assert set(got) == want and len(got) == len(want) > len({p for p, k in kmers(known, *seeds[0]).items() if k >= 500})


def test_queries_that_count_or_join_pairs_list_no_candidates(spark, tmp_path, monkeypatch):
    own = random.Random(8)
    word = lambda: "".join(own.choice("ALVIKFGD") for _ in range(own.randint(8, 10)))
    spark.createDataFrame([(i, " ".join(["ALVGGKFW", "ALVDDKFW", *(word() for _ in range(20))]), "en", "x") for i in range(4)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")

    def refused(*_):
        raise AssertionError("a list of candidates")

    for name in ("hits", "candidates", "anchor_pairs"):
        monkeypatch.setattr(candidates, name, refused)
    monkeypatch.setattr(edges, "anchor_pairs", refused)
    every = queries.queries()
    for name in ("edge_costs", "search_metrics", "packed_pairs", "prefilter_pairs", "prefilter_union", "provisional_clusters", "sampled_retention"):
        assert every[name](spark, str(tmp_path)).count() > 0, name
