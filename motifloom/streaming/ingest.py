"""Incremental ingest: records that arrive as files become validated sequences and running frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from motifloom.sources.records import accepted, peptides


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of documents from the Parquet files that come into a folder."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.readStream.schema(schema).parquet(folder)


def frequencies(docs: DataFrame) -> DataFrame:
    """The running frequency of each accepted sequence; the state is one count a distinct sequence."""
    return accepted(peptides(docs)).groupBy("sequence").count().withColumnRenamed("count", "frequency")
