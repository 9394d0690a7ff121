"""Labelled pools, selection of settings over result grids, and correlations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from motifloom.operators.motifs import log_gamma


def exclusive_members(pairs: DataFrame, pools: DataFrame) -> DataFrame:
    """(pool, member, label): members of pairs(member, label) that have exactly one of a pool's labels, pools(pool, label)."""
    met = pairs.select("member", "label").distinct().join(pools.select("pool", "label").distinct(), "label")
    return met.groupBy("pool", "member").agg(F.count("*").alias("n"), F.min("label").alias("label")).where("n = 1").select("pool", "member", "label")


def incompatible(similarity: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """(a, b) of similarity(a, b, pct): pairs of different labels, both in labels(label), at least so similar."""
    known = labels.select("label").distinct()
    both = similarity.join(known.select(F.col("label").alias("a")), "a", "left_semi").join(known.select(F.col("label").alias("b")), "b", "left_semi")
    return both.where((F.col("a") != F.col("b")) & (F.col("pct") >= least)).select("a", "b")


def balance(pairs: DataFrame) -> DataFrame:
    """Per pool of pairs(pool, member, label): labels, members, smallest and largest label, imbalance, largest share."""
    sizes = pairs.groupBy("pool", "label").agg(F.count_distinct("member").alias("n"))
    found = sizes.groupBy("pool").agg(F.count("*").alias("labels"), F.sum("n").alias("members"), F.min("n").alias("smallest"), F.max("n").alias("largest"))
    return found.withColumn("imbalance", F.col("largest") / F.col("smallest")).withColumn("max_share", F.col("largest") / F.col("members"))


def locus(label: Column) -> Column:
    """The locus letter of an allele name, '?' without one."""
    found = F.regexp_extract(label, "HLA-([ABC])", 1)
    return F.when(found == "", "?").otherwise(found)


def hashed_sample(df: DataFrame, key: str, n: int, seed: int, *within: str) -> DataFrame:
    """The n rows of each group with the smallest hash of their key: samples of different n are nested."""
    order = W.partitionBy(*within) if within else None
    mark = F.xxhash64(F.lit(seed), key)
    if order is None:
        return df.orderBy(mark, key).limit(n)
    return df.withColumn("_n", F.row_number().over(order.orderBy(mark, key))).where(F.col("_n") <= n).drop("_n")


def choose(grid: DataFrame, setting: list[str], metric: str, singletons: str, by: list[str] | None = None, most: float = 0.5) -> DataFrame:
    """The best setting of each `by`: the largest mean metric among settings whose mean singleton share is at most `most`, or among all if none is; ties to the smaller settings."""
    by = by or []
    means = grid.groupBy(*by, *setting).agg(F.avg(metric).alias(metric), F.avg(singletons).alias(singletons), F.count("*").alias("runs"))
    fits = F.col(singletons) <= most
    order = W.partitionBy(*by).orderBy(F.when(fits, 0).otherwise(1), F.desc(metric), *setting)
    return means.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def band(value: Column, edges: tuple[float, ...] = (1, 6, 12, 30)) -> Column:
    """The interval, open on the left and closed on the right, that holds a value, as text; null outside."""
    out = F.lit(None).cast("string")
    for low, high in zip(edges, edges[1:], strict=False):
        out = F.when((value > low) & (value <= high), f"({low}, {high}]").otherwise(out)
    return out


def mean_and_deviation(df: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Per group the number of rows, and of each metric the mean and the sample deviation, 0 for a single row."""
    parts = [x for m in metrics for x in (F.avg(m).alias(f"{m}_mean"), F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"{m}_sd"))]
    return df.groupBy(*by).agg(F.count("*").alias("rows"), *parts)


def binned(df: DataFrame, x: str, y: str, edges: list[float], least: int = 3) -> DataFrame:
    """(bin, n, mean, error) of y over right-closed bins of x; bins with fewer rows than `least` are left out."""
    out = df.withColumn("bin", sum((F.when(F.col(x) > e, 1).otherwise(0) for e in edges[1:]), F.lit(0))).where((F.col(x) > edges[0]) & (F.col(x) <= edges[-1]))
    return out.groupBy("bin").agg(F.count(y).alias("n"), F.avg(y).alias("mean"), (F.stddev_samp(y) / F.sqrt(F.count(y))).alias("error")).where(F.col("n") >= least)


def average_rank(col: str, *by: str) -> Column:
    """Ranks within groups, equal values with the mean of theirs."""
    return F.rank().over(W.partitionBy(*by).orderBy(col)) + (F.count("*").over(W.partitionBy(*by, col)) - 1) / 2


def spearman(long: DataFrame, by: list[str], x: str, y: str, least: int = 8, values: int = 3) -> DataFrame:
    """(by, n, rho) of each group with enough rows and different x; rho is null where y does not vary."""
    ranked = long.withColumn("_x", average_rank(x, *by)).withColumn("_y", average_rank(y, *by))
    apart = F.try_divide(F.covar_pop("_x", "_y"), F.stddev_pop("_x") * F.stddev_pop("_y"))  # null where a side does not vary
    found = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.when(apart.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), apart))).alias("rho"), F.count_distinct(x).alias("_v"))
    return found.where((F.col("n") >= least) & (F.col("_v") >= values)).drop("_v")


def beta_share(x: Column, a: Column, b: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b), for x from 0 to 1, by its continued fraction.

    The fraction is taken from the side on which it settles fast, with a number of steps that grows with the root of a + b.
    """
    tiny = F.lit(1e-300)
    safe = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)

    def fraction(x: Column, a: Column, b: Column) -> Column:
        def step(acc: Column, m: Column) -> Column:
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            c1, d1 = safe(1 + even / acc["c"]), 1 / safe(1 + even * acc["d"])
            c2, d2 = safe(1 + odd / c1), 1 / safe(1 + odd * d1)
            return F.struct(c2.alias("c"), d2.alias("d"), (acc["h"] * c1 * d1 * c2 * d2).alias("h"))

        d = 1 / safe(1 - (a + b) * x / (a + 1))
        start = F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h"))
        return F.aggregate(F.sequence(F.lit(1), (60 + 4 * F.sqrt(a + b)).cast("int")), start, step)["h"]

    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x))
    near = x < (a + 1) / (a + b + 2)
    inside = F.when(near, front * fraction(x, a, b) / a).otherwise(1 - front * fraction(1 - x, b, a) / b)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inside)


def correlation_p(rho: Column, n: Column) -> Column:
    """The two-sided probability of a correlation at least as far from 0 among n pairs without any, by the t distribution of n - 2 degrees of freedom; null for under 3 pairs."""
    freedom = F.greatest(n - 2, F.lit(1)).cast("double")
    return F.when(n > 2, beta_share(F.greatest(F.lit(0.0), 1 - rho * rho), freedom / 2, F.lit(0.5)))


def rank_correlations(long: DataFrame, by: list[str], x: str, y: str, least: int = 8, values: int = 3) -> DataFrame:
    """(by, n, rho, p, q): spearman() with its probabilities, adjusted as one family; groups whose values do not vary have none."""
    found = spearman(long, by, x, y, least, values).where(F.col("rho").isNotNull())
    return benjamini_hochberg(found.withColumn("p", correlation_p(F.col("rho"), F.col("n"))).withColumn("_family", F.lit(0)), "p", "_family").drop("_family")


def stage_contribution(grid: DataFrame, arms: dict[str, Column], setting: list[str], metric: str, metrics: list[str], split: str = "split", inner: str = "inner", outer: str = "test") -> DataFrame:
    """(arm, setting..., rows, metrics...): of each arm, a condition on the grid, the setting with the best mean metric on inner rows, read on the outer ones.

    Each arm chooses its own setting, so that none is judged by what suits another. Means are compared to nine places; ties go to the smaller setting, nulls first;
    a null in a setting is a value of its own. Arms without inner rows have no row, arms without outer rows have null means.
    """
    held = F.filter(F.array(*[F.when(F.coalesce(on, F.lit(False)), F.lit(name)) for name, on in arms.items()]), lambda a: a.isNotNull())
    means = grid.where(F.col(split) == inner).withColumn("arm", F.explode(held)).groupBy("arm", *setting).agg(F.round(F.avg(metric), 9).alias("_mean"))
    best = means.withColumn("_n", F.row_number().over(W.partitionBy("arm").orderBy(F.desc("_mean"), *setting))).where("_n = 1")
    chosen = best.select("arm", *[F.col(c).alias(f"_{c}") for c in setting])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in setting]
    read = chosen.join(grid.where(F.col(split) == outer), same, "left")
    own = [F.col(f"_{c}").alias(c) for c in setting]
    return read.groupBy("arm", *[f"_{c}" for c in setting]).agg(F.count(split).alias("rows"), *[F.avg(m).alias(m) for m in metrics]).select("arm", *own, "rows", *metrics)


def stage_gains(stages: DataFrame, metrics: list[str], gains: dict[str, tuple[str, str]]) -> DataFrame:
    """(gain, metric, value): of each named pair of arms the first's metric less the second's; null where an arm has none."""
    long = stages.select("arm", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x")).select("arm", "x.metric", "x.value")
    asked = F.explode(F.array(*[F.struct(F.lit(g).alias("gain"), F.lit(a).alias("a"), F.lit(b).alias("b")) for g, (a, b) in gains.items()])).alias("g")
    named = long.select("metric").distinct().select("metric", asked).select("metric", "g.gain", "g.a", "g.b")
    side = lambda c: long.select(F.col("arm").alias(c), "metric", F.col("value").alias(f"v{c}"))
    return named.join(side("a"), ["a", "metric"], "left").join(side("b"), ["b", "metric"], "left").select("gain", "metric", (F.col("va") - F.col("vb")).alias("value"))


def benjamini_hochberg(tests: DataFrame, p: str, *by: str) -> DataFrame:
    """tests with `q`: p adjusted for the number of tests of its family `by`, which are few."""
    order = W.partitionBy(*by).orderBy(F.col(p))
    m = F.count("*").over(W.partitionBy(*by))
    raw = tests.withColumn("_raw", F.col(p) * m / F.row_number().over(order))
    return raw.withColumn("q", F.least(F.lit(1.0), F.min("_raw").over(order.rowsBetween(0, W.unboundedFollowing)))).drop("_raw")


def gaps(results: DataFrame, key: str, tool: str, value: str, tools: list[str]) -> DataFrame:
    """Per key each tool's value, and the first tool's lead over each other."""
    wide = results.groupBy(key).pivot(tool, tools).agg(F.first(value))
    return wide.select(key, *tools, *[(F.col(tools[0]) - F.col(t)).alias(f"gap_{t}") for t in tools[1:]])


def nearest(df: DataFrame, key: str, value: str, targets: list[float]) -> DataFrame:
    """The distinct keys whose value is nearest to each of a few targets; ties to the smaller key."""
    picks = [F.min(F.struct(F.abs(F.col(value) - t).alias("d"), F.col(key).alias("k"))).alias(f"t{i}") for i, t in enumerate(targets)]
    found = df.agg(*picks).select(F.explode(F.array(*[F.col(f"t{i}.k") for i in range(len(targets))])).alias(key))
    return df.join(found.distinct(), key, "left_semi")


def compared_runs(runs: DataFrame, *by: str) -> DataFrame:
    """(by, datasets, mean_edges, mean_clusters, mean_singleton_share) of runs(by, edges, clusters, singletons, records).

    A run's share is that of its records that are alone in their clusters; runs without records have none and do not count in its mean.
    """
    share = F.try_divide(F.col("singletons").cast("double"), F.col("records").cast("double"))
    return runs.groupBy(*by).agg(F.count("*").alias("datasets"), F.avg("edges").alias("mean_edges"), F.avg("clusters").alias("mean_clusters"), F.avg(share).alias("mean_singleton_share"))
