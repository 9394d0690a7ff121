"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from motifloom.llm.common import columns_of, fresh, written
from motifloom.llm.tokens import batched, rows

_TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Words whose hashes a Python worker keeps.
_KEPT = 60_000


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > _KEPT:
            self.clear()
        self[word] = h = xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 11)
        return h


_hashes = _Hashes()


def buckets(text: str | None, n: int) -> np.ndarray:
    """The buckets of a text's words and word pairs (repeats included), words lower-cased, signs apart."""
    words = _TOKEN.findall((text or "").lower())
    one = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    two = one[:-1] * np.uint64(0x9E3779B97F4A7C15) + (one[1:] ^ (one[1:] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    both = np.concatenate((one, two))
    return ((both ^ (both >> np.uint64(32))) % np.uint64(n)).astype(np.int64)


@dataclass
class Model:
    """ratio: log of target over raw probability of each bucket; threshold: the log weight that tells the labels apart best."""

    ratio: np.ndarray
    threshold: float = 0.0

    def weight(self, text: str | None) -> float:
        found = buckets(text, len(self.ratio))
        return float(self.ratio[found].sum()) if len(found) else 0.0


def bucket_counts(texts: DataFrame, n: int) -> np.ndarray:
    """How often each of the n buckets occurs in all of texts.text: summed in each task, then over tasks by bucket."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator) -> Iterator:
        total, held, size = np.zeros(n, np.int64), [], 0
        for (text,) in rows(batches, "text"):
            held.append(buckets(text, n))
            size += len(held[-1])
            if size > 1 << 20:
                total += np.bincount(np.concatenate(held), minlength=n)
                held, size = [], 0
        total += np.bincount(np.concatenate([*held, np.zeros(0, np.int64)]), minlength=n)
        at = np.flatnonzero(total)
        yield from batched(zip(at.tolist(), total[at].tolist(), strict=True), schema)

    out = np.zeros(n, np.int64)
    for r in texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    n_buckets: int = 20_000, max_rows: int = 20_000, smoothing: float = 1.0, seed: int = 5,
) -> Model:
    """The ratio of two hashed n-gram models: of target texts (label 1), and of all texts of docs.

    The raw model counts every document. The target model, and the threshold, come from at most
    max_rows labelled rows, those with the smallest hash of the id; they are broadcast. The driver
    gets n_buckets counts, however large the corpus. Without labelled rows nothing is rejected.
    """
    own = columns_of(docs, [(id_col, "doc_id"), (text_col, "text")])
    known = labels.select(labels[id_col].cast("long").alias("lid"), labels[label_col].cast("int").alias("label"))
    known = known.where(F.col("lid").isNotNull() & F.col("label").isin(0, 1)).orderBy(F.xxhash64("lid", F.lit(seed)), "lid").limit(max_rows)
    train = written(own.join(F.broadcast(known), F.col("doc_id") == F.col("lid")).select("label", "text"), "quality-train")
    raw, target = bucket_counts(own, n_buckets), bucket_counts(train.where("label = 1"), n_buckets)
    share = lambda c: (c + smoothing) / (c.sum() + smoothing * len(c))
    model = Model(np.log(share(target) / share(raw)) if target.sum() else np.zeros(n_buckets), -math.inf)
    got = train.select("label", weight_column(model, F.col("text")).alias("w")).groupBy("w").agg(F.sum("label").alias("good"), F.count("*").alias("n")).orderBy("w").collect()
    wrong = sum(r.n - r.good for r in got)
    best = wrong
    for i, r in enumerate(got):  # rejecting all up to here; good rows that are rejected count threefold
        wrong += 3 * r.good - (r.n - r.good)
        if wrong < best:
            above = got[i + 1].w if i + 1 < len(got) else r.w + 1
            best, model.threshold = wrong, (r.w + above) / 2
    return model


def weight_column(model: Model, text: Column) -> Column:
    """The log importance weight of a text column: the sum of the ratios of its words and pairs; 0 for null and empty."""

    @F.pandas_udf(DoubleType())
    def weighed(texts: pd.Series) -> pd.Series:
        return pd.Series([model.weight(t) for t in texts], dtype="float64")

    return weighed(text)


def gumbel_key(weight: Column, row: Column, temperature: float, seed: int) -> Column:
    """weight / temperature + Gumbel noise drawn by a hash of row, so the k largest are a sample without replacement by weight."""
    u = (F.shiftrightunsigned(F.xxhash64(row, F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return weight / F.lit(temperature) - F.log(-F.log(u))


def kth_largest(keys: DataFrame, k: int, col: str = "key", parts: int = 2000, few: int = 50_000) -> float | None:
    """The k-th largest value of keys[col], exactly, without sorting the table.

    Rounds of `parts` equal cells between the bounds are counted, keeping the cell that holds the
    k-th, until it has `few` values; these are ranked. k under 1: None. k over the count: the least.
    """
    n, low, high = keys.agg(F.count(col), F.min(col), F.max(col)).first()
    if k < 1 or not n:
        return None
    if k >= n:
        return low
    rest, held = k, keys.where(F.col(col).isNotNull())
    while n > few and low < high:
        wide = (high - low) / parts
        cell = F.greatest(F.lit(0), F.least(F.lit(parts - 1), F.floor((F.col(col) - F.lit(low)) / F.lit(wide))))
        counts = held.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min(col).alias("low"), F.max(col).alias("high")).orderBy(F.desc("cell")).collect()
        for r in counts:
            if rest <= r.n:
                break
            rest -= r.n
        held, n, low, high = held.where((F.col(col) >= F.lit(r.low)) & (F.col(col) <= F.lit(r.high))), r.n, r.low, r.high
    return held.select(F.row_number().over(W.orderBy(F.desc(col))).alias("rank"), col).where(F.col("rank") == min(rest, n)).first()[1] if low < high else low


def select(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: int | None = None, temperature: float = 0.1, seed: int = 3) -> DataFrame:
    """(doc_id, log_weight, key, selected): the `keep` documents with the largest Gumbel keys are selected.

    keep defaults to the number of documents whose weight is over the model's threshold. The lower
    the temperature, the closer to taking the largest weights. Rows with equal ids and weights share
    their noise and are selected together; a null id draws the noise of its text's weight.
    """
    own = columns_of(docs, [(id_col, "doc_id"), (text_col, "text")])
    weighed = own.select("doc_id", weight_column(model, F.col("text")).alias("log_weight"))
    keyed = written(weighed.withColumn("key", _key(F.col("log_weight"), F.col("doc_id"), temperature, seed)), "quality-keys")
    return keyed.withColumn("selected", _over(keyed, model, keep))


def _key(weight: Column, doc_id: Column, temperature: float, seed: int) -> Column:
    return gumbel_key(weight, F.coalesce(doc_id.cast("long"), F.xxhash64(weight)), temperature, seed)


def _over(keyed: DataFrame, model: Model, keep: int | None) -> Column:
    keep = keyed.where(F.col("log_weight") > F.lit(model.threshold)).count() if keep is None else keep
    least = kth_largest(keyed, keep)
    return F.lit(False) if least is None else F.col("key") >= F.lit(least)


def drop_poor(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: int | None = None, temperature: float = 0.1, seed: int = 3) -> DataFrame:
    """docs without the rows that select() leaves out. Every row is kept or left out by its own text and id."""
    name = fresh(docs, "quality_weight")
    weighed = docs.withColumn(name, weight_column(model, docs[text_col]))
    keyed = written(weighed.select(F.col(name).alias("log_weight"), _key(F.col(name), docs[id_col], temperature, seed).alias("key")), "quality-keys")
    keep = keyed.where(F.col("log_weight") > F.lit(model.threshold)).count() if keep is None else keep
    least = kth_largest(keyed, keep)
    if least is None:
        return docs.limit(0)
    return weighed.where(_key(F.col(name), F.col(id_col), temperature, seed) >= F.lit(least)).drop(name)
