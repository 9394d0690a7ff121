"""Measures of partitions against labels, other partitions and pair sets, over contingency tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from motifloom.operators.pools import best_match


def choose2(n: Column) -> Column:
    return n * (n - 1) / 2


def contingency(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n): how many rows have both."""
    return rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def with_margins(cells: DataFrame) -> DataFrame:
    """cells(a, b, n) with the totals na and nb of their row and column."""
    rows = cells.groupBy(F.col("a").alias("ra")).agg(F.sum("n").alias("na"))
    columns = cells.groupBy(F.col("b").alias("cb")).agg(F.sum("n").alias("nb"))
    return cells.join(rows, F.col("a").eqNullSafe(F.col("ra"))).join(columns, F.col("b").eqNullSafe(F.col("cb"))).select("a", "b", "n", "na", "nb")


def bcubed(cells: DataFrame) -> DataFrame:
    """(label, members, precision, recall, f1, adjusted): BCubed of each label a over clusters b.

    Precision is the mean share of a member's cluster that has its label; adjusted is its gain over
    the label's share of all members, 0 where that is 1.
    """
    n = F.col("n").cast("double")
    total = cells.agg(F.sum("n").alias("all"))
    by = with_margins(cells).groupBy(F.col("a").alias("label")).agg(F.first("na").alias("members"), F.sum(n * n / F.col("nb") / F.col("na")).alias("precision"), F.sum(n * n / F.col("na") / F.col("na")).alias("recall"))
    p, r, prior = F.col("precision"), F.col("recall"), F.col("members") / F.col("all")
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    adjusted = F.when(prior == 1, 0.0).otherwise((p - prior) / (1 - prior))
    return by.crossJoin(F.broadcast(total)).select("label", "members", "precision", "recall", f1.alias("f1"), adjusted.alias("adjusted"))  # total is one row


def bcubed_summary(cells: DataFrame) -> DataFrame:
    """One row: means over labels (macro) and over members (micro) of bcubed()."""
    each = bcubed(cells)
    measures = ("precision", "recall", "f1", "adjusted")
    macro = [F.avg(c).alias(f"macro_{c}") for c in measures]
    micro = [(F.sum(F.col(c) * F.col("members")) / F.sum("members")).alias(f"micro_{c}") for c in measures]
    return each.agg(*macro, *micro)


def agreement(cells: DataFrame) -> DataFrame:
    """One row of two partitions' agreement: ari, nmi, pairwise_jaccard, coassociation recall and precision, rand, vi, exact, pair counts.

    Where a denominator is zero the value is 1. vi is the variation of information, in nats.
    """
    m = with_margins(cells)
    n, na, nb = (F.col(c).cast("double") for c in ("n", "na", "nb"))
    both = m.agg(
        F.sum(choose2(n)).alias("both"), F.sum(n).alias("all"), F.sum(n * F.log(n)).alias("joint"), F.sum(F.when((n == na) & (n == nb), 0).otherwise(1)).alias("split"),
        F.sum(n * (na - 1) / 2).alias("in_a"), F.sum(n * (nb - 1) / 2).alias("in_b"), F.sum(n * F.log(na)).alias("la"), F.sum(n * F.log(nb)).alias("lb"),
    )
    c = F.col
    pairs = choose2(c("all"))
    expected = c("in_a") * c("in_b") / pairs
    most = (c("in_a") + c("in_b")) / 2
    share = lambda x, y: F.when(y == 0, 1.0).otherwise(x / y)
    h = lambda own: F.log("all") - c(own) / c("all")
    mutual = h("la") + h("lb") - (F.log("all") - c("joint") / c("all"))
    return both.select(
        F.when((pairs == 0) | (most == expected), 1.0).otherwise((c("both") - expected) / (most - expected)).alias("ari"), share(2 * mutual, h("la") + h("lb")).alias("nmi"),
        share(c("both"), c("in_a") + c("in_b") - c("both")).alias("pairwise_jaccard"), share(c("both"), c("in_a")).alias("coassociation_recall"),
        share(c("both"), c("in_b")).alias("coassociation_precision"), share(pairs - c("in_a") - c("in_b") + 2 * c("both"), pairs).alias("rand"),
        (h("la") + h("lb") - 2 * mutual).alias("vi"), (c("split") == 0).alias("exact"), c("both").cast("long").alias("shared_pairs"), c("in_a").cast("long").alias("a_pairs"), c("in_b").cast("long").alias("b_pairs"),
    )


def neighbour_jaccard(cells: DataFrame) -> DataFrame:
    """One row: the mean over members of the Jaccard index of both of their clusters, themselves left out; over all, and over those with a neighbour.

    Members of one cell share their value; without any neighbour it is 1.
    """
    m = with_margins(cells)
    other = F.col("na") + F.col("nb") - F.col("n") - 1
    value = F.when(other == 0, 1.0).otherwise((F.col("n") - 1) / other)
    informative = F.when(other > 0, F.col("n"))
    return m.agg((F.sum(value * F.col("n")) / F.sum("n")).alias("neighbour_jaccard"), (F.sum(value * informative) / F.sum(informative)).alias("informative_jaccard"))


def _log_factorials(n: int) -> np.ndarray:
    return np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, n + 1)))))


def expected_mutual_information(cells: DataFrame) -> DataFrame:
    """One row: emi, the mutual information that two partitions with these cluster sizes have by chance.

    Sizes repeat, so the sum runs over pairs of distinct sizes, each with how often it occurs. Terms
    of one pair of sizes are an array in one task; their number is that of distinct sizes, squared.
    """
    m = with_margins(cells)
    total = m.agg(F.sum("n").cast("long").alias("all"))
    sizes = lambda by, own: m.select(by, own).distinct().groupBy(own).agg(F.count("*").alias(f"{own}_times"))
    pairs = sizes("a", "na").crossJoin(sizes("b", "nb")).crossJoin(total)

    @F.pandas_udf(DoubleType())
    def term(a: pd.Series, b: pd.Series, n: pd.Series) -> pd.Series:
        logs = _log_factorials(int(n.max())) if len(n) else np.zeros(1)
        out = []
        for x, y, k in zip(a.astype(int), b.astype(int), n.astype(int), strict=True):
            c = np.arange(max(1, x + y - k), min(x, y) + 1)
            p = logs[x] + logs[y] + logs[k - x] + logs[k - y] - logs[k] - logs[c] - logs[x - c] - logs[y - c] - logs[k - x - y + c]
            out.append(float((c / k * np.log(k * c / (x * y)) * np.exp(p)).sum()))
        return pd.Series(out, dtype="float64")

    return pairs.select((term("na", "nb", "all") * F.col("na_times") * F.col("nb_times")).alias("t")).agg(F.sum("t").alias("emi"))


def adjusted_mutual_information(cells: DataFrame) -> DataFrame:
    """One row: ami, mutual information over chance, normalised by the mean entropy; 1 where both partitions are trivial."""
    m = with_margins(cells).agg(F.sum("n").cast("double").alias("all"), F.sum(F.col("n") * F.log("n")).alias("joint"), F.sum(F.col("n") * F.log("na")).alias("la"), F.sum(F.col("n") * F.log("nb")).alias("lb"))
    h = lambda own: F.log("all") - F.col(own) / F.col("all")
    mutual = h("la") + h("lb") - (F.log("all") - F.col("joint") / F.col("all"))
    room = (h("la") + h("lb")) / 2 - F.col("emi")
    return m.crossJoin(expected_mutual_information(cells)).select(F.when(F.abs(room) < 1e-15, 1.0).otherwise((mutual - F.col("emi")) / room).alias("ami"))  # one row each


def search_quality(true_pairs: DataFrame, scored_pairs: DataFrame) -> DataFrame:
    """One row: true, scored and shared pairs, recall and precision of a search; both tables are (u, v), u < v, without repeats."""
    t, s = true_pairs.select("u", "v", F.lit(1).alias("t")), scored_pairs.select(F.col("u").alias("u2"), F.col("v").alias("v2"), F.lit(1).alias("s"))
    both = t.join(s, (F.col("u") == F.col("u2")) & (F.col("v") == F.col("v2")), "full").agg(F.count("t").alias("true_pairs"), F.count("s").alias("scored_pairs"), F.count_if(F.col("t").isNotNull() & F.col("s").isNotNull()).alias("shared_pairs"))
    return search_shares(both)


def search_shares(counts: DataFrame) -> DataFrame:
    """counts(true_pairs, scored_pairs, shared_pairs) with recall and precision; 1 of nothing."""
    share = lambda of: F.when(F.col(of) == 0, 1.0).otherwise(F.col("shared_pairs") / F.col(of))
    return counts.select("*", share("true_pairs").alias("recall"), share("scored_pairs").alias("precision"))


def missed_pairs(true_pairs: DataFrame, scored_pairs: DataFrame) -> DataFrame:
    """One row of counters over the true pairs that a search missed: true_pairs(u, v, front_seed, end_seed, bound_ok)."""
    gone = true_pairs.join(scored_pairs.select("u", "v"), ["u", "v"], "left_anti")
    front, end, bound = (F.col(c) for c in ("front_seed", "end_seed", "bound_ok"))
    return gone.agg(
        F.count("*").alias("missed"), F.count_if(~front & end).alias("front_missed"), F.count_if(front & ~end).alias("end_missed"), F.count_if(~front & ~end).alias("both_missed"),
        F.count_if(front & end).alias("retrievable"), F.count_if(front & end & bound).alias("unexamined"), F.count_if(~bound).alias("bound_unsound"),
    )


def edge_difference(first: DataFrame, second: DataFrame) -> DataFrame:
    """(u, v, only_in): edges that one table has and the other lacks."""
    a, b = first.select("u", "v"), second.select("u", "v")
    return a.exceptAll(b).withColumn("only_in", F.lit("first")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("second")))


def missing_edge_categories(missing: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """(category, n) of missing edges(u, v): how two partitions (node_id, rep) place their ends."""
    df = missing
    for p, of, name in ((first, "u", "fu"), (first, "v", "fv"), (second, "u", "su"), (second, "v", "sv")):
        named = p.select(F.col("node_id").alias(f"_{name}"), F.col("rep").alias(name))
        df = df.join(named, F.col(of) == F.col(f"_{name}")).drop(f"_{name}")
    same_first, same_second = F.col("fu") == F.col("fv"), F.col("su") == F.col("sv")
    to_rep = (F.col("u") == F.col("fu")) | (F.col("v") == F.col("fv"))
    category = (
        F.when(same_first & same_second & to_rep, "kept, to its representative").when(same_first & same_second, "kept together").when(same_first & to_rep, "split from its representative")
        .when(same_first, "split").when(same_second, "joined").otherwise("apart in both")
    )
    return df.groupBy(category.alias("category")).agg(F.count("*").alias("n"))


def similarity_quantiles(scored: DataFrame, by: str, value: str) -> DataFrame:
    """Of each `by` the largest value, exact interpolated quantiles 0.99, 0.98 and 0.97, and the median."""
    q = F.percentile(value, F.array(F.lit(0.99), F.lit(0.98), F.lit(0.97), F.lit(0.5)))
    out = scored.groupBy(by).agg(F.max(value).alias("max"), q.alias("q"))
    return out.select(by, "max", *[F.get("q", F.lit(i)).alias(c) for i, c in enumerate(("quantile99", "quantile98", "quantile97", "median"))])


def majority_relabelled(cells: DataFrame) -> DataFrame:
    """(a, b, n) of cells whose clusters b are replaced by their most frequent label, ties to the smallest label: the ceiling of merging."""
    best = cells.groupBy(F.col("b").alias("c")).agg(F.max("n").alias("most"))
    tops = cells.join(best, F.col("b") == F.col("c")).where("n = most").groupBy("c").agg(F.min("a").alias("label"))
    return cells.join(tops, F.col("b") == F.col("c")).groupBy("a", F.col("label").alias("b")).agg(F.sum("n").alias("n"))


def match_error(cells: DataFrame, most: int = 2000) -> float:
    """1 less the share of members that the best one-to-one match of labels to clusters holds; at most `most` of either are matched."""
    if max(cells.agg(F.count_distinct("a"), F.count_distinct("b")).first()) > most:
        raise ValueError(f"a match of more than {most} clusters is not computed")
    table = cells.toPandas().pivot_table(index="a", columns="b", values="n", fill_value=0).to_numpy()
    return 1 - best_match(table) / table.sum()
