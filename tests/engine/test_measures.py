"""Measures, selection and motifs against plain computations."""

import math
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from motifloom.functions.alphabet import ALPHABET
from motifloom.operators import metrics, motifs, nodes, pools, selection
from motifloom.plans import queries
from motifloom.plans.config import Config
from motifloom.sources import exports
from motifloom.streaming import ingest

rng = random.Random(6)
DATA = "/root/testdata/sf0.001"


def test_partition_measures(spark):
    rows = [(rng.randint(0, 4), rng.randint(0, 5)) for _ in range(80)]
    cells = metrics.contingency(spark.createDataFrame(rows, "x int, y int"), "x", "y")
    got = metrics.agreement(cells).first()
    same = lambda k: {(i, j) for i in range(80) for j in range(i) if rows[i][k] == rows[j][k]}
    a, b = same(0), same(1)
    all_ = 80 * 79 / 2
    expected = len(a) * len(b) / all_
    assert got.ari == pytest.approx((len(a & b) - expected) / ((len(a) + len(b)) / 2 - expected))
    assert got.pairwise_jaccard == pytest.approx(len(a & b) / len(a | b)) and got.rand == pytest.approx(1 - len(a ^ b) / all_)
    assert not got.exact
    own = metrics.agreement(metrics.contingency(spark.createDataFrame(rows, "x int, y int"), "x", "x")).first()
    assert own.ari == own.nmi == own.rand == own.pairwise_jaccard == 1 and own.exact and abs(own.vi) < 1e-12
    # adjusted mutual information, with the expectation as a sum over all permutations' hypergeometric terms
    n, ca, cb, cab = 80, Counter(x for x, _ in rows), Counter(y for _, y in rows), Counter(rows)
    mi = sum(k / n * math.log(n * k / ca[x] / cb[y]) for (x, y), k in cab.items())
    h = lambda c: -sum(k / n * math.log(k / n) for k in c.values())
    emi = sum(k / n * math.log(n * k / i / j) * math.comb(i, k) * math.comb(n - i, j - k) / math.comb(n, j) for i in ca.values() for j in cb.values() for k in range(max(1, i + j - n), min(i, j) + 1))
    assert metrics.adjusted_mutual_information(cells).first().ami == pytest.approx((mi - emi) / ((h(ca) + h(cb)) / 2 - emi))
    one = metrics.contingency(spark.createDataFrame([(1, 1)], "x int, y int"), "x", "y")
    assert metrics.agreement(one).first().ari == 1 and metrics.neighbour_jaccard(one).first().neighbour_jaccard == 1


def test_search_and_edges(spark):
    pair = lambda xs: spark.createDataFrame(xs, "u long, v long")
    got = metrics.search_quality(pair([(0, 1), (1, 2), (2, 3)]), pair([(0, 1), (5, 6)])).first()
    assert (got.recall, got.precision) == (pytest.approx(1 / 3), 0.5)
    true = spark.createDataFrame([(0, 1, True, True, True), (1, 2, False, True, True), (2, 3, True, True, False)], "u long, v long, front_seed boolean, end_seed boolean, bound_ok boolean")
    assert tuple(metrics.missed_pairs(true, pair([(0, 1)])).first()) == (2, 1, 0, 0, 1, 0, 1)
    assert sorted(map(tuple, metrics.edge_difference(pair([(0, 1), (1, 2)]), pair([(0, 1), (3, 4)])).collect())) == [(1, 2, "first"), (3, 4, "second")]
    part = spark.createDataFrame([(0, 0), (1, 0), (2, 2), (3, 2)], "node_id long, rep long")
    other = spark.createDataFrame([(0, 0), (1, 1), (2, 2), (3, 2)], "node_id long, rep long")
    assert {tuple(r) for r in metrics.missing_edge_categories(pair([(0, 1), (2, 3), (1, 2)]), part, other).collect()} == {("split from its representative", 1), ("kept, to its representative", 1), ("apart in both", 1)}
    q = metrics.similarity_quantiles(spark.createDataFrame([("a", i) for i in range(101)], "k string, v int"), "k", "v").first()
    assert (q["max"], q.quantile99, q.median) == (100, 99.0, 50.0)


def test_selection(spark):
    pairs = spark.createDataFrame([("p", "A"), ("p", "B"), ("q", "A"), ("r", "C")], "member string, label string")
    pools = spark.createDataFrame([(1, "A"), (1, "B"), (2, "A"), (2, "C")], "pool int, label string")
    assert {tuple(r) for r in selection.exclusive_members(pairs, pools).collect()} == {(1, "q", "A"), (2, "p", "A"), (2, "q", "A"), (2, "r", "C")}
    tests = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.5])], "i int, p double")
    q = {r.i: r.q for r in selection.benjamini_hochberg(tests, "p").collect()}
    assert q == pytest.approx({0: 0.04, 1: 0.16 / 3, 2: 0.16 / 3, 3: 0.5})
    near = selection.nearest(spark.createDataFrame([("a", 1.0), ("b", 5.0), ("c", 9.0)], "k string, v double"), "k", "v", [2.0, 8.0, 8.5])
    assert sorted(r.k for r in near.collect()) == ["a", "c"]
    small, large = (selection.hashed_sample(spark.range(100), "id", n, 1) for n in (10, 30))
    assert {r.id for r in small.collect()} < {r.id for r in large.collect()}
    sims = spark.createDataFrame([("A", "B", 90.0), ("A", "C", 10.0), ("A", "A", 100.0)], "a string, b string, pct double")
    assert [tuple(r) for r in selection.incompatible(sims, pairs, 50).collect()] == [("A", "B")]


def test_frames_and_gamma(spark):
    df = spark.createDataFrame([("APRTAAFLL",), ("APRTAAFL",), ("APRTAAFLLQK",), ("SHORT",)], "s string")
    assert [r[0] for r in df.select(nodes.frame(F.col("s"))).collect()] == ["APRTAAFLL", "APRT-AAFL", "APRTFLLQK", "-" * 9]
    for x in (0.3, 1.0, 5.0, 171.5):
        assert spark.range(1).select(motifs.log_gamma(F.lit(x))).first()[0] == pytest.approx(math.lgamma(x), abs=1e-9)
    assert motifs._lgamma(np.array([5.0]))[0] == pytest.approx(math.log(24))


def test_bayes_factor_signs_and_merging():
    alpha = motifs.alphas(np.full(20, 0.05), 1.0)
    counts = np.zeros((4, 9, 20))
    for i, r in enumerate((0, 0, 7, 7)):
        counts[i, :, r] = 40
    assert motifs.marginal(counts[0] + counts[1], alpha) > 2 * motifs.marginal(counts[0], alpha)
    assert motifs.agglomerate(counts, alpha, 0.0).tolist() == [0, 0, 1, 1] and motifs.agglomerate(counts, alpha, 0.0, target=1).tolist() == [0, 0, 0, 0]


def test_motifs_do_not_depend_on_partitions(spark):
    seqs = ["".join(rng.choice(p) for p in ("AV", "LI", *["ARNDC"] * 5, "KR", "F")) for _ in range(60)] + ["".join(rng.choice(p) for p in ("G", "P", *["QEGH"] * 5, "W", "Y")) for _ in range(60)]
    known = spark.createDataFrame([(i, s, 1 + i % 3) for i, s in enumerate(sorted(set(seqs)))], "node_id long, sequence string, frequency long")
    part = known.select("node_id", F.when(F.col("sequence").startswith("G"), F.lit(1000)).otherwise(F.lit(2000)).cast("long").alias("rep"))
    config = Config(merge_motifs=True, motif_count=2, em_iterations=15)
    labels, mixture = motifs.build(known, part, config)
    again, other = motifs.build(known.repartition(7), part.repartition(3), config)
    same = {r.node_id: r.motif for r in labels.collect()}
    assert same == {r.node_id: r.motif for r in again.collect()} and np.array_equal(mixture.profiles, other.profiles)
    assert len(set(same.values())) == 2 and np.allclose(mixture.profiles.sum(-1), 1) and mixture.mixing.sum() == pytest.approx(1)
    plain, _ = motifs.build(known, part, Config(merge_motifs=True, em=False))
    assert plain.count() == known.count()
    five, _ = motifs.build(known, known.select("node_id", (F.col("node_id") % 5).alias("rep")), Config(merge_motifs=True, motif_count=5, em_iterations=5))
    assert five.select("motif").distinct().count() == 5


def plain_merges(counts: np.ndarray, alpha: np.ndarray, threshold: float, target: int | None) -> list[int]:
    """All pairs anew before each merge."""
    held = {i: c.copy() for i, c in enumerate(counts)}
    group = list(range(len(counts)))
    while len(held) > (target or 1):
        own = {i: float(motifs.marginal(c, alpha)) for i, c in held.items()}
        best = max(((float(motifs.marginal(held[i] + held[j], alpha)) - own[i] - own[j], -i, -j) for i in held for j in held if i < j))
        if target is None and best[0] <= threshold:
            break
        i, j = -best[1], -best[2]
        held[i] = held[i] + held.pop(j)
        group = [i if g == j else g for g in group]
    first: dict[int, int] = {}
    return [first.setdefault(g, len(first)) for g in group]


def test_agglomeration_is_that_of_all_pairs(spark):
    own = np.random.default_rng(8)
    alpha = motifs.alphas(np.full(20, 0.05), 2.0)
    kinds = own.dirichlet(np.full(20, 0.3), (4, 9))
    sizes = own.integers(1, 30, 26)
    counts = np.array([[own.multinomial(n, kinds[i % 4, c]) for c in range(9)] for i, n in enumerate(sizes)], float)
    counts[20:23] = counts[3]  # equal profiles
    for threshold, target in ((0.0, None), (5.0, None), (0.0, 3), (0.0, 1)):
        want = plain_merges(counts, alpha, threshold, target)
        assert motifs.agglomerate(counts, alpha, threshold, target).tolist() == want
        partners = motifs.dealt_partners(spark, counts, motifs.marginal(counts, alpha), alpha)
        assert motifs.agglomerate(counts, alpha, threshold, target, partners).tolist() == want
    big = counts * 1000  # counts that are not looked up
    assert motifs.agglomerate(big, alpha, 0.0).tolist() == plain_merges(big, alpha, 0.0, None)
    assert motifs.agglomerate(counts[:1], alpha, 0.0).tolist() == [0] and motifs.agglomerate(counts[:0], alpha, 0.0).tolist() == []


def test_mixture_over_many_chunks_is_the_plain_one(spark):
    own = np.random.default_rng(3)
    letters = list(ALPHABET)
    frames = sorted({"".join(own.choice(letters[:5] if i % 2 else letters[10:16], 9)) for i in range(700)})
    rows = [(int(own.integers(0, 300)), f, int(own.integers(1, 4))) for f in frames]
    start, mixing, alpha = own.integers(1, 9, (3, 9, 20)).astype(float), np.array([2.0, 1.0, 1.0]), np.full(20, 0.5)
    table = lambda parts: spark.createDataFrame(rows, "chunk long, frame string, weight long").repartition(parts)
    got, again = motifs.em(table(5), start, mixing, alpha, 6, 0.0), motifs.em(table(2), start, mixing, alpha, 6, 0.0)
    assert np.array_equal(got.profiles, again.profiles) and np.array_equal(got.mixing, again.mixing)
    codes, w = np.array([[letters.index(c) for c in f] for _, f, _ in rows]), np.array([x for *_, x in rows], float)
    counts, share = start, mixing / mixing.sum()
    for _ in range(6):
        profiles = (counts + alpha) / (counts + alpha).sum(-1, keepdims=True)
        p = share * np.prod(profiles[:, np.arange(9), codes], axis=2).T
        p = p / p.sum(1, keepdims=True) * w[:, None]
        counts = np.zeros((3, 9, 20))
        for i, code in enumerate(codes):
            counts[:, np.arange(9), code] += p[i][:, None]
        share = p.sum(0) / p.sum()
    assert np.allclose(got.mixing, share) and np.allclose(got.profiles, (counts + alpha) / (counts + alpha).sum(-1, keepdims=True))
    assert motifs.em(table(2).where("false"), start, mixing, alpha, 1).labels.count() == 0


def test_empty_motifs_reclaim_nodes(spark):
    labels = spark.createDataFrame([(1, "A" * 9, 0), (2, "A" * 8 + "R", 0), (3, "R" * 9, 0), (4, "N" * 9, 2)], "node_id long, frame string, motif int")
    profiles = np.full((4, 9, 20), 0.01)
    profiles[0, :, 0] = profiles[1, :, 1] = profiles[2, :, 2] = profiles[3, :, 0] = 0.81
    mixture = motifs.Mixture(profiles, np.full(4, 0.25), 1, True, labels)
    # motif 1 takes the node that it fits best, then motif 3 the best of what motif 0 can spare; motif 2's only node stays
    assert {r.node_id: r.motif for r in motifs.reclaim(labels, mixture).collect()} == {1: 3, 2: 0, 3: 1, 4: 2}
    two = labels.where("node_id in (1, 4)")
    assert {r.node_id: r.motif for r in motifs.reclaim(two, mixture).collect()} == {1: 0, 4: 2}  # nothing to spare


def test_streamed_frequencies_are_those_of_the_table(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    running = ingest.frequencies(ingest.documents(spark, str(tmp_path / "in")))
    q = running.writeStream.format("memory").queryName("freq").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    whole = {r.sequence: r.frequency for r in nodes.load(queries.peptides(spark, DATA)).collect()}
    assert {r.sequence: r.frequency for r in spark.sql("SELECT * FROM freq").collect()} == whole


def test_queries_match_sql(spark):
    import duckdb

    con = duckdb.connect()
    for p in Path(DATA).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    plain = lambda v: round(float(v), 6) if isinstance(v, float) or hasattr(v, "as_tuple") else v
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, DATA)
        cursor = con.execute(sql)
        names = [c[0] for c in cursor.description]
        assert sorted(names) == sorted(df.columns), name
        want = Counter(tuple(plain(r[names.index(c)]) for c in df.columns) for r in cursor.fetchall())
        assert Counter(tuple(plain(v) for v in r) for r in df.collect()) == want, name


def test_correlation_probabilities(spark):
    # tabulated two-sided values of the t distribution: (t, degrees of freedom, p)
    known = [(12.706, 1, 0.05), (4.303, 2, 0.05), (2.571, 5, 0.05), (4.032, 5, 0.01), (2.228, 10, 0.05), (2.750, 30, 0.01), (1.980, 120, 0.05), (2.617, 120, 0.01), (1.962, 1000, 0.05), (0.677, 100, 0.5)]
    rows = [(math.copysign(t / math.sqrt(t * t + v), 1 - 2 * (i % 2)), v + 2, p) for i, (t, v, p) in enumerate(known)] + [(0.0, 10, 1.0), (1.0, 10, 0.0), (-1.0, 9, 0.0), (0.3, 2, None), (0.001, 200_000, 0.65473)]
    for r in spark.createDataFrame(rows, "rho double, n long, want double").withColumn("p", selection.correlation_p(F.col("rho"), F.col("n"))).collect():
        assert r.p == r.want if r.want is None else r.p == pytest.approx(r.want, rel=2e-3, abs=1e-12), r
    far = spark.range(1).select(selection.correlation_p(F.lit(0.9), F.lit(102)).alias("p")).first().p
    assert 0 < far < 1e-30
    long = spark.createDataFrame([(g, float(x), float(y)) for g in "abc" for x, y in [(rng.randint(0, 20), rng.randint(0, 9)) for _ in range(30)]] + [("d", 1.0, 1.0)] * 9, "g string, x double, y double")
    got = {r.g: r for r in selection.rank_correlations(long, ["g"], "x", "y").collect()}
    assert set(got) == {"a", "b", "c"}
    order = sorted(got.values(), key=lambda r: r.p)
    assert all(r.q == pytest.approx(min(1, min(s.p * 3 / (k + 1) for k, s in enumerate(order) if k >= i))) for i, r in enumerate(order))


def test_stage_contribution_against_loops(spark):
    grid = [(rng.choice(["inner", "inner", "test"]), a, b, rng.random(), rng.random(), rng.random() < 0.5) for a in (None, 1, 2) for b in ("x", "y") for _ in range(12)]
    df = spark.createDataFrame(grid, "split string, a int, b string, m double, extra double, em boolean")
    arms = {"all": F.lit(True), "em": F.col("em"), "x": F.col("b") == "x", "none": F.col("a") > 5}
    holds = {"all": lambda r: True, "em": lambda r: r[5], "x": lambda r: r[2] == "x"}
    got = {r.arm: r for r in selection.stage_contribution(df, arms, ["a", "b"], "m", ["m", "extra"]).collect()}
    assert set(got) == set(holds)
    for arm, on in holds.items():
        by = {}
        for r in grid:
            if r[0] == "inner" and on(r):
                by.setdefault((r[1], r[2]), []).append(r[3])
        best = max(by, key=lambda k: sum(by[k]) / len(by[k]))
        read = [r for r in grid if r[0] == "test" and (r[1], r[2]) == best]
        assert (got[arm].a, got[arm].b, got[arm].rows) == (*best, len(read))
        assert got[arm].extra == (pytest.approx(sum(r[4] for r in read) / len(read)) if read else None)
    gains = selection.stage_gains(selection.stage_contribution(df, arms, ["a", "b"], "m", ["m", "extra"]), ["m", "extra"], {"em over all": ("em", "all"), "lost": ("all", "none")})
    value = {(r.gain, r.metric): r.value for r in gains.collect()}
    assert len(value) == 4 and value["lost", "m"] is None and value["em over all", "m"] == pytest.approx(got["em"].m - got["all"].m)


def test_pools_and_matches(spark):
    import itertools

    for _ in range(30):
        columns = rng.randint(1, 5)
        t = np.array([[rng.randint(0, 9) for _ in range(columns)] for _ in range(rng.randint(1, 5))])
        wide = t if t.shape[0] <= t.shape[1] else t.T
        assert pools.best_match(t) == max(sum(wide[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(wide.shape[1]), wide.shape[0]))
    cells = spark.createDataFrame([("a", 1, 5), ("a", 2, 4), ("b", 1, 3)], "a string, b int, n int")
    assert metrics.match_error(cells) == pytest.approx(1 - 7 / 12)
    d = np.array([[0, 1, 9, 9], [1, 0, 9, 9], [9, 9, 0, 2], [9, 9, 2, 0]])
    assert pools.complete_linkage(d, 1).tolist() == [0, 0, 1, 2] and pools.complete_linkage(d, 2).tolist() == [0, 0, 1, 1] and pools.complete_linkage(d, 9).tolist() == [0, 0, 0, 0]
    assert pools.log_spaced(1, 100, 3) == [1, 10, 100]
    pairs = spark.createDataFrame([("p", f"m{i}", "A") for i in range(50)] + [("p", f"n{i}", "B") for i in range(20)], "pool string, member string, label string")
    sizes = {r.label: r["count"] for r in pools.balanced(pairs, seed=1).groupBy("label").count().collect()}
    assert 19 <= sizes["A"] <= 21 and 19 <= sizes["B"] <= 20
    labels = spark.createDataFrame([(i, f"l{i}") for i in range(5)], "node_id long, label string")
    clashes = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "u long, v long")
    assert sorted(r.label for r in pools.independent_labels(labels, clashes).collect()) in (["l0", "l2", "l4"], ["l0", "l3", "l4"])


def test_exchange_tables(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (2**32 - 2, 5)], "u long, v long")
    u, v = exports.unpacked(F.col("pair"))
    assert sorted(tuple(r) for r in exports.traced(pairs).select(u, v).collect()) == [(1, 2), (5, 2**32 - 2)]
    a, b = spark.createDataFrame([(1, "x")], "k int, p string"), spark.createDataFrame([(1, 2.0), (2, 3.0)], "k int, q double")
    assert sorted(tuple(r) for r in exports.shards([a, b], ["k"]).collect()) == [(1, "x", None), (2, None, 3.0)]
    r = spark.createDataFrame([("m", 0.1, 0.9, 0.9), ("n", 0.5, 0.2, 0.1)], "p string, a double, b double, c double")
    assert {tuple(x) for x in exports.responsibilities(r, "p", ["a", "b", "c"]).collect()} == {("m", 2), ("n", 1)}
    assert exports.best_group_count(r, "p", ["a", "b"]).first().p == "m"
    got = exports.with_unassigned(r.select(F.col("p").alias("member")), spark.createDataFrame([("m", 4)], "member string, cluster int"))
    assert {tuple(x) for x in got.collect()} == {("m", "4"), ("n", "unassigned")}


def plain_seeds(counts: np.ndarray, sizes: np.ndarray, k: int) -> list[int]:
    """k seeds among clusters of at least the median size (5 at least): the largest, then the one farthest from all chosen, by divergence."""
    able = np.flatnonzero(sizes >= max(float(np.median(sizes)), 5)) if len(sizes) else np.zeros(0, int)
    if len(able) < k:
        able = np.argsort(-sizes, kind="stable")[: max(k, len(able))]
    p = counts[able] / np.maximum(1e-300, counts[able].sum(-1, keepdims=True))

    def bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        m = (a + b) / 2
        part = lambda x: np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0).sum(-1)
        return ((part(a) + part(b)) / 2).mean(-1)

    chosen = [int(np.argmax(sizes[able]))]
    away = bits(p, p[chosen[0]][None])
    while len(chosen) < min(k, len(able)):
        away[chosen] = -1
        chosen.append(int(np.argmax(away)))
        away = np.minimum(away, bits(p, p[chosen[-1]][None]))
    return [int(able[i]) for i in chosen]


@pytest.mark.parametrize("k", [3, 6, 40])
def test_seeds_are_farthest_first(spark, k):
    rng = np.random.default_rng(k)
    rows = [(i, "".join(rng.choice(list(ALPHABET), 9)), int(rng.integers(1, 6)), 9, int(rng.integers(0, 12))) for i in range(60)]
    known = spark.createDataFrame([r[:4] for r in rows], "node_id long, sequence string, frequency long, length int")
    part = spark.createDataFrame([(r[0], r[4]) for r in rows], "node_id long, rep long")
    reps = sorted({r[4] for r in rows})
    counts, sizes = np.zeros((len(reps), 9, 20)), np.zeros(len(reps))
    for _, sequence, frequency, _, rep in rows:
        sizes[reps.index(rep)] += frequency
        for c, residue in enumerate(sequence):
            counts[reps.index(rep), c, ALPHABET.index(residue)] += frequency
    want = plain_seeds(counts, sizes, k)
    got, got_sizes = motifs.farthest_first(known, part, k)
    assert np.array_equal(got, counts[want]) and np.array_equal(got_sizes, sizes[want])


def test_runs_are_compared_by_set(spark):
    rows = [("a", 10, 4, 2, 8), ("a", 20, 6, 6, 6), ("b", 0, 0, 0, 0), ("b", None, 3, 1, 4), (None, 1, 1, 1, 1)]
    got = selection.compared_runs(spark.createDataFrame(rows, "formula string, edges long, clusters long, singletons long, records long"), "formula")
    assert {r.formula: tuple(r)[1:] for r in got.collect()} == {"a": (2, 15.0, 5.0, 0.625), "b": (2, 0.0, 1.5, 0.25), None: (1, 1.0, 1.0, 1.0)}
    assert selection.compared_runs(spark.createDataFrame([], "formula string, edges long, clusters long, singletons long, records long"), "formula").count() == 0


def test_em_packs_chunks_once_and_adds_as_plain_loops(spark, monkeypatch):
    """Frames are packed once, no round shuffles them, and the rounds give what plain loops over all frames give."""
    rng, k = np.random.default_rng(11), 2
    letters = motifs.ALPHABET + "-"
    rows = sorted({"".join(letters[i] for i in rng.integers(0, 21, 9)) for _ in range(200)})
    frames = spark.createDataFrame([(f, i % 20, 1 + i % 3) for i, f in enumerate(rows)], "frame string, chunk long, weight long").cache()
    counts, mixing, alpha = rng.random((k, 9, 20)) * 5, np.array([2.0, 1.0]), np.full(20, 0.05)
    packed, real = [], motifs.stored
    monkeypatch.setattr(motifs, "stored", lambda df, name: packed.append(name) or real(df, name))
    got = motifs.em(frames, counts, mixing, alpha, 4, 0.0)
    w, mix, c = np.array([1 + i % 3 for i in range(len(rows))], float), mixing / mixing.sum(), counts
    for _ in range(4):
        p = (c + alpha) / (c + alpha).sum(-1, keepdims=True)
        logs = np.array([[np.log(mix[m]) + sum(np.log(p[m, j, letters.index(x)]) for j, x in enumerate(f) if x != "-") for m in range(k)] for f in rows])
        share = np.exp(logs - logs.max(1, keepdims=True))
        share = share / share.sum(1, keepdims=True) * w[:, None]
        c = np.array([[[sum(s[m] for s, f in zip(share, rows, strict=True) if f[j] == a) for a in motifs.ALPHABET] for j in range(9)] for m in range(k)])
        mix = share.sum(0) / share.sum()
    assert packed == ["packed-chunks"] and got.iterations == 4
    assert np.allclose(got.profiles, (c + alpha) / (c + alpha).sum(-1, keepdims=True)) and np.allclose(got.mixing, mix)
    assert {r.frame: r.motif for r in got.labels.collect()} == dict(zip(rows, logs.argmax(1).tolist(), strict=True))


def test_merging_works_out_few_factors_and_merges_as_all_pairs_do(monkeypatch):
    own = np.random.default_rng(5)
    families = own.dirichlet(np.full(20, 0.15), (8, 9))
    counts = np.array([[own.multinomial(1 + i % 7, p) for p in families[i % 8]] for i in range(120)], float)
    counts[60:64] = counts[:4]  # ties
    alpha, worked = own.dirichlet(np.full(20, 5.0)) * 200, []
    evidence, of = motifs.Evidence(alpha), motifs.Evidence.of
    want, group = counts.copy(), np.arange(120)
    merges = 0
    while True:
        live = np.unique(group)
        each = motifs.marginal(want, alpha)
        best = max(((f, -x, -int(y)) for x in live.tolist() for y, f in zip(live[live > x], evidence.factors(want[x], each[x], want[live[live > x]], each[live[live > x]]), strict=True)), default=(0.0, 0, 0))
        if best[0] <= 3.0:
            break
        merges += 1
        want[-best[1]] += want[-best[2]]
        group[group == -best[2]] = -best[1]
    monkeypatch.setattr(motifs.Evidence, "of", lambda self, c: worked.append(len(c)) or of(self, c))
    got = motifs.agglomerate(counts, alpha, 3.0)
    first = {}
    assert got.tolist() == [first.setdefault(g, len(first)) for g in group.tolist()] and merges > 40
    assert sum(worked) < 120 * 119 / 2 + 60 * merges
