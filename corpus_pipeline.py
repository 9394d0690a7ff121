"""A corpus pipeline: quality, toxicity, near copies, repeated passages, packing. Each stage's rows are written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from motifloom.llm import packing, quality, simhash, suffixes, toxicity
from motifloom.llm.common import marked, release, small_batches, written
from motifloom.llm.queries import WORDS, table, vocabulary


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects.

    Null and empty texts have no words, so their weight is that of no evidence: they stay only if that is over the threshold.
    A row is judged by its own text and id: repeated rows stay or go together, equal texts of other ids differ at the cut alone.
    An empty table stays empty; columns of any other name are handed on as they are.
    """
    return quality.drop_poor(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def keep_harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity lexicon rejects.

    Null and empty texts score 0 and stay. Scores depend on the text alone, so repeated rows and equal texts stay or go together.
    Without labelled rows nothing goes. Columns of any other name are handed on as they are.
    """
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With one document of each group of near copies: that with the smallest id.

    Null, empty and very short texts are copies of those with the same words only. Rows without an id stay; rows that repeat an id are
    one document. No document's links are cut short, however large its group. Columns of any other name are handed on as they are.
    """
    small_batches(spark)
    return simhash.drop_near_copies(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With repeated passages of over 50 words (or of 400 bytes, where these hold few words) cut out of the texts.

    Every row stays, with an empty text if all of it repeats; null texts stay null, n_chars is counted anew. A passage that begins
    twice in one text repeats as well, and repeated rows repeat wholly: both lose it.
    """
    small_batches(spark)
    return suffixes.drop_repeats(docs, words=51, dense=False)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens.

    Null and empty texts have their end id alone. Repeated rows are packed one by one; pieces of equal length are dealt by hash, so the
    order of rows does not matter. An empty table has no pieces.
    """
    small_batches(spark)
    return packing.pack(packing.pieces(docs, vocabulary(WORDS), 4096, end=(2,)), 4096).drop("doc_key")


STAGES = [("quality", keep_quality), ("toxicity", keep_harmless), ("near_copies", keep_one_copy), ("repeats", cut_repeats), ("packing", pack_sequences)]

#: The stages' models and fingerprints have no SQL; tests compare the run with a brute-force one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        since = marked()
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark, since, [docs.scratch_path])
    return docs
