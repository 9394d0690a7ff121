"""Steps that several operators take: tables written once, ranks over whole tables, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


_scratch: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the folder in spark.checkpoint.dir and read again: computed once, its lineage cut.

    Where that is unset a temporary folder is made if all runs in one process; a cluster must name a shared one.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _scratch.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def marked() -> int:
    """A point in time for release()."""
    return len(_scratch)


def release(spark: SparkSession, since: int, *kept: DataFrame) -> None:
    """Deletes the tables that stored() wrote since marked() was `since`, but for those that the kept tables are read from."""
    own = {f.rsplit("/", 1)[0].split(":", 1)[-1].lstrip("/") for df in kept for f in df.inputFiles()}
    stays = [p for p in _scratch[since:] if p.split(":", 1)[-1].lstrip("/") in own]
    for path in _scratch[since:]:
        if path not in stays:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _scratch[since:] = stays


def ranked(df: DataFrame, *order: Column, to: str = "rank", parts: int | None = None) -> DataFrame:
    """df with its rank from 0 in the whole order, which must be total, in the column `to`.

    Rows are dealt by range, stored, ranked within each range, and moved by the sizes of the ranges
    before, so no task sorts the whole table.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").count()
    before = sizes.select(F.col("_range").alias("_of"), (F.sum("count").over(W.orderBy("_range")) - F.col("count")).alias("_before"))  # a row a range
    own = F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1
    return dealt.withColumn("_own", own).join(before, F.col("_range") == F.col("_of")).select(*df.columns, (F.col("_own") + F.col("_before")).cast("long").alias(to))


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of edges(u, v, ...), as (src, dst, ...)."""
    rest = [c for c in edges.columns if c not in ("u", "v")]
    turned = lambda a, b: edges.select(F.col(a).alias("src"), F.col(b).alias("dst"), *rest)
    return turned("u", "v").unionByName(turned("v", "u"))
