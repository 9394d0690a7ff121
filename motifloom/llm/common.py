"""Small helpers shared by the operators: scratch tables, fresh column names, range blocks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch that goes to Python; keeps a batch of long texts to some tens of MB.
ARROW_ROWS = 2000
#: How many times larger in memory than on disk tables are taken to be.
COMPRESSED = "16"

_scratch: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and all run in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, kept when executors are lost, without its lineage.

    Such tables can be many times smaller on disk than in memory, so file sizes count COMPRESSED-fold where Spark decides about broadcasts.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.sources.fileCompressionFactor", COMPRESSED)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables of written() that no later step reads, so that they do not add up on disk, and does sweep()."""
    for df in tables:
        _delete(df.sparkSession, df.scratch_path)
        _scratch.remove(df.scratch_path)
    if tables:
        sweep(tables[0].sparkSession)


def sweep(spark: SparkSession) -> None:
    """Has the shuffle files of finished jobs deleted, which Spark does when the driver's garbage is collected."""
    spark.sparkContext._jvm.System.gc()


def marked() -> int:
    """A point in time for release()."""
    return len(_scratch)


def release(spark: SparkSession, since: int = 0, but: Iterable[str] = ()) -> None:
    """Deletes the scratch tables of this session that were made after marked() was `since`, but for some paths. Call it once the results that read them are stored."""
    kept = [p for p in _scratch[since:] if p in but]
    for path in _scratch[since:]:
        if path not in kept:
            _delete(spark, path)
    _scratch[since:] = kept
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of the queries that send texts to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def fresh(df: DataFrame, base: str) -> str:
    """A column name like base that df does not have, whatever the case."""
    have = {c.lower() for c in df.columns}
    while base.lower() in have:
        base = "_" + base
    return base


def columns_of(docs: DataFrame, pairs: Iterable[tuple[str, str]]) -> DataFrame:
    """Only the named columns, renamed; whatever else docs holds can't clash with an operator's own columns."""
    return docs.select(*[docs[c].alias(to) for c, to in pairs])


#: Quantiles of ids that one pass takes beside the number of rows; more ranges than these take a pass of their own.
GRID = 1000


def id_ranges(df: DataFrame, key: str, per_block: int = 1000, most: int = 20_000) -> tuple[Column, int]:
    """The number of the contiguous range of df[key] that a row is in, ascending with the key (nulls: -1), and the rows of df.

    Ranges are cut at approximate quantiles of the keys, wherever these crowd or lie apart, into
    about per_block rows each, or into `most` ranges if that is fewer; the driver sees their bounds.
    Rows with equal keys are in one range. Up to GRID ranges one pass over the keys gives rows and bounds.
    """
    x = F.col(key).cast("double")
    grid = F.percentile_approx(x, [i / GRID for i in range(1, GRID)], 10 * GRID)
    seen = df.agg(F.count("*").alias("rows"), F.count(key).alias("keys"), grid.alias("grid")).first()
    parts = min(most, -(-seen["keys"] // per_block))
    if parts > GRID:
        bounds = df.stat.approxQuantile(key, [i / parts for i in range(1, parts)], 1 / (8 * parts))
    else:
        bounds = [seen.grid[round(i * GRID / parts) - 1] for i in range(1, parts)]
    bounds = sorted(set(bounds))
    if not bounds:
        return F.when(F.col(key).isNull(), F.lit(-1)).otherwise(F.lit(0)).cast("long"), seen["rows"]
    table = F.split(F.lit(",".join(map(repr, bounds))), ",").cast("array<double>")
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    # a binary search: how many bounds are at or below the key
    below = lambda at, step: F.when(F.coalesce(F.get(table, at + step - 1) <= x, F.lit(False)), at + step).otherwise(at)
    block = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), below)
    return F.when(F.col(key).isNull(), F.lit(-1)).otherwise(block).cast("long"), seen["rows"]


def id_blocks(df: DataFrame, key: str, per_block: int = 1000, most: int = 20_000) -> Column:
    """The ranges of id_ranges() alone."""
    return id_ranges(df, key, per_block, most)[0]


def shuffles(spark: SparkSession, rows: int, per_block: int, blocks: int = 4) -> int:
    """Partitions for a shuffle of so many rows by their blocks, a few blocks each: as many as the rows ask for, not less than the session's."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // (per_block * blocks)))
