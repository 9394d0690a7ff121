"""Ingest, candidates, covers, refinement and outputs against sequential versions."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from motifloom.functions.alphabet import ALPHABET, half_away, residue_similarities
from motifloom.operators import candidates, cover, edges, greedy, motifs, nodes, partitions, refine
from motifloom.operators.components import components
from motifloom.plans import cluster as runs
from motifloom.plans.config import Config
from motifloom.sources import records as sources

rng = random.Random(3)


def all_pairs(known):
    ids = known.select(F.col("node_id").alias("u"))
    return ids.crossJoin(ids.withColumnRenamed("u", "v")).where("u < v")


def random_graph(n, p):
    links = [(u, v, rng.randint(0, 3)) for u in range(n) for v in range(u + 1, n) if rng.random() < p]
    return links, [rng.randint(1, 3) for _ in range(n)]


def tables(spark, links, freq):
    rows = [(i, "".join(ALPHABET[int(d)] for d in f"{i:08d}"), f, 8) for i, f in enumerate(freq)]
    e = spark.createDataFrame([(u, v, w, 0, w, w, w) for u, v, w in links], "u long, v long, weight int, kmer int, anchor int, alignment int, combined int")
    return spark.createDataFrame(rows, "node_id long, sequence string, frequency long, length int"), e


def neighbours(links, n):
    near = [{} for _ in range(n)]
    for u, v, w in links:
        near[u][v] = near[v][u] = w
    return near


@pytest.mark.parametrize("p", [0.04, 0.15])
def test_covers_match_sequential_ones(spark, p):
    n = 45
    links, freq = random_graph(n, p)
    near = neighbours(links, n)
    known, found = tables(spark, links, freq)
    free, want = set(range(n)), {}
    while free:
        key = lambda x: (1 + len(near[x].keys() & free), sum(w for y, w in near[x].items() if y in free), freq[x], -x)
        top = max(free, key=key)
        for y in [top, *(near[top].keys() & free)]:
            want[y] = top
        free -= {y for y, r in want.items() if r == top}
    for small in (0, 12, 10_000):
        assert {r.node_id: r.rep for r in cover.coverage(known, found, small).collect()} == want
    order = sorted(range(n), key=lambda i: f"{i:08d}".translate(str.maketrans("0123456789", ALPHABET[:10])))
    want = {}
    for x in order:
        if x not in want:
            want[x] = x
            for y in near[x]:
                want.setdefault(y, x)
    got = cover.intrinsic(known, found)
    assert {r.node_id: r.rep for r in got.collect()} == want
    assert {r.node_id: r.rep for r in cover.ordered(known, found, F.length("sequence").desc(), F.col("sequence"), small=0).collect()} == want
    assert refine.violations(got, found).count() == 0


def test_refinement_matches_sequential_steps(spark):
    n = 40
    links, freq = random_graph(n, 0.25)
    near = neighbours(links, n)
    known, found = tables(spark, links, freq)
    config = Config(mode="separate_aln_anchor", margin=0.0)
    graph = refine.both_ways(found, config)
    start = cover.intrinsic(known, found)
    part = {r.node_id: r.rep for r in start.collect()}
    # reassignment: all component scores equal the weight, so ties go to the smaller id
    reps = set(part.values())
    want = {}
    for x, rep in part.items():
        best = max(((w, -y) for y, w in near[x].items() if y in reps), default=None)
        want[x] = -best[1] if x not in reps and best and best > (near[x][rep], -rep) else rep
    got = {r.node_id: r.rep for r in refine.reassigned(start, graph, 0).collect()}
    assert got == want
    # representatives
    moved = spark.createDataFrame(list(want.items()), "node_id long, rep long")
    members = {}
    for x, rep in want.items():
        members.setdefault(rep, []).append(x)
    expected = {}
    for rep, own in members.items():
        best, key = rep, (0, 0, 0, freq[rep])
        for x in sorted(own):
            inner = [y for y in near[x] if y in own]
            if len(inner) + 1 == len(own):
                total = sum(near[x][y] * freq[y] for y in inner)
                k = (total, total, total, freq[x])
                if k > key or (k == key and x < best):
                    best, key = x, k
        expected[rep] = best
    assert {r.rep: r.best for r in refine.represented(moved, graph, known).collect()} == expected
    # merging
    size = {rep: len(own) for rep, own in members.items()}
    alive, to = set(members), {}
    for target in sorted(members, key=lambda c: (-size[c], c)):
        if target not in alive:
            continue
        live = [s for s in alive if s != target and all(y in near[target] for y in members[s]) and len(members[target]) >= len(members[s])]
        for s in sorted(live, key=lambda c: (-len(members[c]), c)):
            members[target] = members[target] + members[s]
            alive.discard(s)
            to[s] = target
    merged = {r.node_id: r.rep for r in refine.merged(moved, refine.merge_candidates(moved, graph)).collect()}
    assert merged == {x: to.get(rep, rep) for x, rep in want.items()}


def merged_in_order(members, fit, seeds):
    """The strict merges of the greedy method, one target at a time: (source to target, merges with members that no seed brings to the target)."""
    size, alive, to, unseen = {r: len(own) for r, own in members.items()}, set(members), {}, 0
    members = {r: list(own) for r, own in members.items()}
    for target in sorted(members, key=lambda c: (-size[c], c)):
        if target not in alive:
            continue
        live = [s for s in alive if s != target and (target, s) in seeds and len(members[target]) >= len(members[s])]
        for s in sorted(live, key=lambda c: (-len(members[c]), c)):
            if all((target, y) in fit for y in members[s]):
                unseen += any((target, y) not in seeds for y in members[s])
                members[target] += members[s]
                alive.discard(s)
                to[s] = target
    return to, unseen


def test_greedy_merges_probe_all_members(spark):
    config = Config(method="greedy", threshold=0.5, seed="contiguous", seed_threshold=0.8)
    own = random.Random(5)
    sequences = {"ALVKEFLIV", "IVLDRYVLA"}
    for base in sorted(sequences):
        for _ in range(40):
            x = list(base)
            for _ in range(own.randint(1, 3)):
                x[own.randrange(9)] = own.choice("ALVIMF")
            sequences.add("".join(x))
    known = nodes.features(nodes.load(spark.createDataFrame([(s,) for s in sorted(sequences)], "sequence string"))).persist()
    n, both = known.count(), lambda df: {p for r in df.select("u", "v").collect() for p in ((r.u, r.v), (r.v, r.u))}
    fit, seeds = both(edges.edges(all_pairs(known), known, config)), both(candidates.candidates(known, config.seed, config.seed_threshold))
    families = {}
    for x in range(n):  # each joins the first cluster whose representative it fits; every third founds its own
        families.setdefault(next((r for r in sorted(families) if (r, x) in fit and x % 3), x), []).append(x)
    # a source with a member that fits the target, though no seed brings them together
    t, s, y = next((t, s, y) for t, s in sorted(fit & seeds) if t < s for y in range(n) if (t, y) in fit - seeds and (s, y) in fit)
    z = next(z for z in range(n) if (t, z) in fit and z not in (s, y))
    planted = {t: [t, z], s: [s, y]} | {x: [x] for x in range(n) if x not in (t, s, y, z)}
    for members in (families, planted):
        to, unseen = merged_in_order(members, fit, seeds)
        assert to and (members is families or unseen)
        part = spark.createDataFrame([(x, r) for r, held in members.items() for x in held], "node_id long, rep long")
        got = {r.node_id: r.rep for r in refine.merged(part, refine.probed_merges(part, known, config, greedy.PairScores.of(known, config))).collect()}
        assert got == {x: to.get(r, r) for r, held in members.items() for x in held}
    known.unpersist()


def test_components(spark):
    links = [(i, i + 1) for i in range(20)] + [(50, 40), (60, 60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {50: 40, 40: 40, 60: 60}


SEQUENCES = ["GALTALKLV", "GALVIIIKLV", "ALVIIKLVI", "CCCPPPDDD"] + ["".join(rng.choice("ALVIKF") for _ in range(rng.randint(8, 11))) for _ in range(50)]


def test_candidates_are_all_similar_pairs(spark):
    known = nodes.features(nodes.load(spark.createDataFrame([(s,) for s in SEQUENCES], "sequence string")))
    seqs = {r.node_id: r.sequence for r in known.collect()}
    assert list(seqs.values()) == sorted(set(SEQUENCES)) or sorted(seqs.values()) == sorted(set(SEQUENCES))
    table = residue_similarities()

    def similar(a, b, columns, at):
        for p in columns:
            for q in columns:
                s = sum(table[ALPHABET.index(a[p[k]]) * 20 + ALPHABET.index(b[q[k]])] for k in (0, 1))
                if half_away(s / 2) >= at:
                    return True
        return False

    for seed in nodes.COLUMN_PAIRS:
        columns = nodes.COLUMN_PAIRS[seed]
        want = {(u, v) for u in seqs for v in seqs if u < v and similar(seqs[u][:3], seqs[v][:3], columns, 400) and similar(seqs[u][-3:], seqs[v][-3:], columns, 400)}
        assert {(r.u, r.v) for r in candidates.candidates(known, seed, 0.40).collect()} == want


def test_whole_run_and_outputs(spark, tmp_path):
    rows = [(f"h{i}\t{i}", s) for i, s in enumerate(SEQUENCES + SEQUENCES[:7] + ["BAD", "GALTALKL1"])]
    data = spark.createDataFrame(rows, "header string, sequence string")
    config = Config()
    result = runs.cluster(data, config)
    shuffled = runs.cluster(data.orderBy(F.rand(1)).repartition(5), config)
    clusters = lambda r: {x.node_id: x.rep for x in r.partition.collect()}
    assert clusters(result) == clusters(shuffled) and result.progress.failures == 0
    assert refine.violations(result.partition, result.edges).count() == 0
    greedy = runs.cluster(data, Config(method="greedy"))
    assert greedy.progress.failures == 0
    runs.write_outputs(data, result, config, str(tmp_path / "out"))
    lines = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "out" / "clusters.tsv")).collect()
    assert len(lines) == len(SEQUENCES) + 7 and all("\t" not in r.peptide_header for r in lines) and {r.cluster_id[:4] for r in lines} == {"PC2_"}
    pair = spark.createDataFrame([("a", s) for s in SEQUENCES[:4]], "header string, sequence string")
    got = runs.cluster(pair, config)
    assert got.edges.count() == 1 and got.partition.select("rep").distinct().count() == 3
    assert runs.cluster(pair, Config(prefilter="force")).partition.count() == 4


def test_prefilter_with_the_full_second_pass_is_one_pass(spark, tmp_path):
    data = spark.createDataFrame([(f"h{i}", s) for i, s in enumerate(SEQUENCES)], "header string, sequence string")
    plain = Config(mode="separate_kmer_anchor", threshold=0.4)
    one, two = runs.cluster(data, plain), runs.cluster(data, replace(plain, prefilter="force", full_after_prefilter=True))
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(two.edges) == rows(one.edges) and rows(two.partition) == rows(one.partition) and one.provisional is None
    part = runs.cluster(data, replace(plain, prefilter="force"))
    assert {r[:2] for r in rows(part.edges)} <= {r[:2] for r in rows(one.edges)}
    got = {r.node_id: r for r in partitions.provisional_rows(two.nodes, two.provisional).collect()}
    cover_ = {r.node_id: r.rep for r in two.provisional.collect()}
    at = {r: i for i, r in enumerate(sorted(set(cover_.values())))}
    sequence = {r.node_id: r.sequence for r in two.nodes.collect()}
    assert len(got) == len(cover_) and any(r.assigned_to_nonsingleton for r in got.values())
    for n, rep in cover_.items():
        size = sum(r == rep for r in cover_.values())
        assert tuple(got[n])[1:2] + tuple(got[n])[3:] == (sequence[n][:3] + sequence[n][-3:], at[rep], rep, size, size > 1)
    runs.write_compact(two, plain, str(tmp_path / "compact"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "compact" / "node_clusters.tsv")).count() == len(cover_)


def test_joins_that_cover_and_restriction(spark):
    part = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6)], "node_id long, rep long")
    got = lambda *ids: {r.node_id: r.rep for r in partitions.restricted(part, spark.createDataFrame([(i,) for i in ids], "node_id long")).collect()}
    assert got(2, 3, 3, 5, 6, 9, None) == {2: 2, 3: 2, 5: 5, 6: 6} and got(1, 3) == {1: 1, 3: 1} and got() == {}
    labels = lambda *rows: spark.createDataFrame(list(rows), "node_id long, label string")
    met = partitions.covering_join(labels((2, "a"), (2, "b"), (6, "a")), part, "node_id")
    assert sorted(tuple(r) for r in met.collect()) == [(2, "a", 1), (2, "b", 1), (6, "a", 6)]
    assert partitions.covering_join(labels(), part, "node_id").count() == 0
    for row in ((7, "x"), (None, "x")):
        with pytest.raises(Exception, match="no row for node_id"):
            partitions.covering_join(labels((1, "a"), row), part, "node_id").collect()


def test_node_and_motif_tables(spark, tmp_path):
    data = spark.createDataFrame([(f"h{i}", s) for i, s in enumerate(SEQUENCES[:12])], "header string, sequence string")
    config = Config(merge_motifs=True, motif_count=3, em_iterations=3)
    known = nodes.features(nodes.load(data)).persist()
    part = known.select("node_id", (F.col("node_id") - F.col("node_id") % 2).alias("rep"), F.floor(F.col("node_id") / 2).alias("cluster"))
    result = runs.Result(known, known.limit(0), part.persist(), refine.Progress())
    rows = runs.node_rows(result, config).collect()
    of = {r.sequence: r.node_id for r in known.collect()}
    assert len(rows) == len(of) and all(of[r.representative_sequence] == of[r.sequence] // 2 * 2 for r in rows)
    assert all(r.terminal_kmer_similarity == "1.000" for r in rows if r.sequence == r.representative_sequence)
    runs.write_motifs(result, config, str(tmp_path))
    out = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "motifs.tsv")).collect()
    assert {r.sequence for r in out} == set(of) and {r.motif for r in out} == {"1", "2", "3"}
    for bad in ({"em": False}, {"prefilter": "auto"}, {"full_after_prefilter": True}, {"merge_motifs": True, "em_iterations": 0}, {"merge_motifs": True, "motif_threshold": float("nan")},
                {"merge_motifs": True, "motif_merge": False, "em": False}, {"merge_motifs": True, "motif_merge": False, "motif_count": 2}, {"motif_merge": False}, {"merge_motifs": True, "em_tolerance": -1.0}, {"motif_prior": 2.0}, {"selection": "lazy_exact"}, {"merge_motifs": True, "motif_count": 2, "em": False}):
        with pytest.raises(ValueError):
            Config(**bad)
    assert Config(merge_motifs=True, em_tolerance=0.0).em_tolerance == 0
    labels, mixture = motifs.build(known, part, Config(merge_motifs=True, motif_merge=False, em_iterations=1))
    assert len(mixture.mixing) == 6 and labels.count() == 12  # every cluster starts a motif


def test_fasta(spark, tmp_path):
    text = ">one first\nGALT\n alklv \n\n>two\nCCCPPPDDD\n>three>x\nBBB\n>\n"
    (tmp_path / "a.fasta").write_text(text)
    import gzip

    with gzip.open(tmp_path / "b.fasta.gz", "wt") as f:
        f.write(text)
    (tmp_path / "c.txt").write_text("GALTALKLV\n\ncccpppddd\n")
    want = [("one first", "GALTALKLV"), ("three>x", "BBB"), ("two", "CCCPPPDDD")]
    for name in ("a.fasta", "b.fasta.gz"):
        df = sources.fasta(spark, str(tmp_path / name))
        assert sorted(tuple(r) for r in df.collect()) == want
        assert tuple(sources.counters(df).first()) == (3, 2, 1)
        with pytest.raises(Exception, match="invalid sequence"):
            sources.accepted(df, strict=True).collect()
    assert sorted(r.sequence for r in sources.fasta(spark, str(tmp_path / "c.txt")).collect()) == ["CCCPPPDDD", "GALTALKLV"]
    (tmp_path / "d.fasta").write_text("\n \t>one first\nGALT\n alklv\t\n  >two\r\nCCCPPP\n\tDDD\n>three>x\nB\n \nBB\n  > \n")
    assert sorted(tuple(r) for r in sources.fasta(spark, str(tmp_path / "d.fasta")).collect()) == want
    (tmp_path / "e.fasta").write_text("GALTALKLV\n>one\nAAA\n")
    with pytest.raises(Exception, match="before the first header"):
        sources.fasta(spark, str(tmp_path / "e.fasta")).collect()
    many = [(f"h{i}", "ACDEFGHIK" * (1 + i % 3)) for i in range(3000)]
    (tmp_path / "f.fasta").write_text("".join(f"{' ' * (i % 2)}>{h}\n{s[:5]}\n{s[5:]}\n" for i, (h, s) in enumerate(many)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")  # many parts of one file
    try:
        assert sorted(tuple(r) for r in sources.fasta(spark, str(tmp_path / "f.fasta")).collect()) == sorted(many)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_prefilter_pairs_share_values(spark):
    known = nodes.features(nodes.load(spark.createDataFrame([(s,) for s in SEQUENCES], "sequence string")))
    hyp = {r.node_id: set(r.h) for r in known.collect()}
    want = {(u, v, len(hyp[u] & hyp[v])) for u in hyp for v in hyp if u < v and len(hyp[u] & hyp[v]) >= 2}
    assert {tuple(r) for r in candidates.anchor_pairs(known).collect()} == want
    config = Config(mode="separate_kmer_anchor")
    pairs = candidates.candidates(known)
    assert edges.prefilter_edges(known, config, pairs).count() <= edges.edges(pairs, known, config).count()


def test_unions_counters_and_retention(spark):
    link = lambda *rows: spark.createDataFrame(list(rows), "u long, v long, weight int")
    assert sorted(tuple(r) for r in edges.united(link((1, 2, 5), (3, 4, 1)), link((1, 2, 7), (5, 6, 0))).collect()) == [(1, 2, 7), (3, 4, 1), (5, 6, 0)]
    known = nodes.features(nodes.load(spark.createDataFrame([(s,) for s in SEQUENCES], "sequence string"))).persist()
    config = Config(mode="separate_kmer_anchor", kmer_threshold=0.3, anchor_threshold=0.5)
    found = candidates.hits(known, "contiguous", 0.4)
    got = edges.cost_counters(found, found.distinct(), known, config).first()
    bound = runs.bounds(found.distinct(), known).collect()
    assert (got.index_hits, got.distinct_pairs, got.pairs_scored) == (found.count(), len(bound), sum(r.bound >= 500 for r in bound)) and got.bound_rejected == sum(r.bound < 500 for r in bound) > 0
    kept = edges.edges(found.distinct(), known, config)
    pairs, held, step = {(r.u, r.v) for r in bound}, {(r.u, r.v) for r in kept.collect()}, known.count() // 7
    got = candidates.retention(known, found.distinct(), kept, samples=7).first()
    count = lambda of: sum(x % step == 0 for p in of for x in p)
    assert (got.retrieved, got.kept) == (count(pairs), count(held)) and got.kept > 0
    # the order by candidates' counts
    survivors = runs.survivors(found.distinct(), known, config)
    n = {x: 0 for x in range(known.count())}
    for r in survivors.collect():
        n[r["query"]] += 1
    sequence, near, want = {r.node_id: r.sequence for r in known.collect()}, {x: set() for x in n}, {}
    for u, v in held:
        near[u].add(v)
        near[v].add(u)
    for x in sorted(n, key=lambda i: (-n[i], sequence[i])):
        if x not in want:
            want |= {y: x for y in near[x] if y not in want} | {x: x}
    assert {r.node_id: r.rep for r in cover.kmer_degree(known, kept, survivors).collect()} == want
    known.unpersist()


def test_labelled_exports(spark, tmp_path):
    from motifloom.operators.selection import locus

    (tmp_path / "x.tsv").write_text("pep\tallele\tclass\n galtalklv \tHLA-A*02:01 \tI\nGALTALKLV\tHLA-A*02:01\tI\nCCCPPPDDD\tHLA-B*07\tI\nCCCPPPDDE\tHLA-B*07\tI\nBAD\tHLA-B*07\tI\nACDEFGHIK\tHLA-C*01\tII\n\tx\tI\n")
    got = lambda **more: sorted(tuple(r) for r in sources.labelled(spark, str(tmp_path / "x.tsv"), "allele", "pep", sep="\t", **more).collect())
    assert got(least_members=2) == [("CCCPPPDDD", "HLA-B*07"), ("CCCPPPDDE", "HLA-B*07")]
    assert got(where="class = 'I'") == [("CCCPPPDDD", "HLA-B*07"), ("CCCPPPDDE", "HLA-B*07"), ("GALTALKLV", "HLA-A*02:01")]
    names = spark.createDataFrame([("HLA-A*02:01",), ("HLA-C07",), ("DRB1",), (None,)], "n string")
    assert [r[0] for r in names.select(locus(F.col("n"))).collect()][:3] == ["A", "C", "?"]


def test_greedy_reassignment_moves_on_the_margin_only(spark):
    part = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (3, 1)], "node_id long, rep long")
    links = [(0, 2, 50, 900), (1, 2, 50, 800), (0, 3, 51, 700), (1, 3, 50, 900)]
    rows = [(u, v, w, s, s, s, s) for u, v, w, s in links]
    found = spark.createDataFrame(rows, "u long, v long, weight int, kmer int, anchor int, alignment int, combined int")
    graph = refine.both_ways(found, Config(mode="separate_kmer_anchor", margin=0.0))
    to = lambda margin, greedy_: {r.node_id: r.rep for r in refine.reassigned(part, graph, margin, greedy_).collect()}
    # equal weights are decided by the scores in the graph method alone; a larger weight moves in both, unless it is within the margin
    assert to(0, False) == {0: 0, 1: 1, 2: 0, 3: 0} and to(0, True) == {0: 0, 1: 1, 2: 1, 3: 0} and to(1, False) == to(1, True) == {0: 0, 1: 1, 2: 1, 3: 1}


@pytest.mark.parametrize("seed, at", [("contiguous", 0.4), ("all_column_pairs", 0.4), ("all_column_pairs", 0.8)])
def test_hits_counted_by_buckets_are_those_listed(spark, seed, at):
    known = nodes.features(nodes.load(spark.createDataFrame([(s,) for s in SEQUENCES], "sequence string"))).persist()
    config = Config(mode="separate_kmer_anchor", kmer_threshold=0.3, anchor_threshold=0.5, seed=seed, seed_threshold=at)
    found = candidates.hits(known, seed, at)
    want = edges.cost_counters(found, found.distinct(), known, config).first()
    assert edges.counted_costs(candidates.candidates(known, seed, at), known, config).first() == want and want.index_hits > 0
    empty = known.limit(0)
    assert tuple(edges.counted_costs(candidates.candidates(empty, seed, at), empty, config).first()) == (0, 0, 0, 0)


def test_summary_of_a_run(spark, tmp_path):
    data = spark.createDataFrame([(f"h{i}", s) for i, s in enumerate([*SEQUENCES, SEQUENCES[0], "SHORT", None])], "header string, sequence string")
    for method in ("graph", "greedy"):
        config = Config(mode="separate_kmer_anchor", threshold=0.4, method=method)
        result = runs.cluster(data, config)
        shown = {r.name: r.value for r in runs.run_summary(data, result, config).collect()}
        n = result.nodes.count()
        assert (shown["input_records"], shown["excluded_records"], shown["nodes"]) == (str(data.count()), "2", str(n)) and shown["method"] == method
        costs = runs.run_costs(result, config).first()
        assert costs.possible_pairs == n * (n - 1) // 2 and abs(costs.share_scored - costs.pairs_scored / (n * (n - 1) / 2)) < 1e-12
        assert method == "graph" or costs.pairs_scored == result.pairs_scored
        assert shown["clusters"] == str(result.partition.select("rep").distinct().count()) and shown["converged"] == "True"
        runs.write_summary(data, result, config, str(tmp_path / method))
        lines = [r.value for r in spark.read.text(str(tmp_path / method / "run_summary.txt")).collect()]
        assert lines == [f"{k}: {v}" for k, v in shown.items()]
