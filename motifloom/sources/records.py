"""Sources: FASTA and bare lists, peptides out of documents, labelled tables; validation and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motifloom.functions.alphabet import ALPHABET

SHORTEST = 8
VALID = f"^[{ALPHABET}]{{{SHORTEST},}}$"


def valid(sequence: Column) -> Column:
    """Whether a sequence has at least 8 residues, all of the alphabet; null counts as invalid."""
    return F.coalesce(sequence.rlike(VALID), F.lit(False))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(header, sequence) of FASTA files, plain or .gz: lines trimmed, blank ones skipped, sequences joined in upper case.

    A file of lines without any header is a bare list, one sequence a line. A record begins at a
    line that starts with '>', blanks before it aside; text that only contains one is left alone. A sequence under an empty
    header fails, an empty header without one is skipped. The reader splits files at '>' after a line end, so a
    file of any number of records is read in parts if it is not compressed; headers after blanks split its blocks again.
    """
    blocks = spark.read.text(path, lineSep="\n>").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("block"))
    # a file's first block alone may begin without a header; of all others the reader took the '>'
    opens = blocks.where("start = 0").groupBy("file").agg(F.min("block").alias("block")).withColumn("first", F.lit(True))
    text = F.when(F.col("first"), F.col("value")).otherwise(F.concat(F.lit("\n>"), F.col("value")))
    parts = blocks.join(opens, ["file", "block"], "left").select("file", F.explode(F.split(text, r"(?:^|\n)[ \t\r\f]*(?=>)")).alias("part"))
    lines = F.filter(F.transform(F.split("part", "\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    cut = parts.select("file", F.col("part").startswith(">").alias("headed"), lines.alias("lines")).where(F.size("lines") > 0)
    files = cut.groupBy("file").agg(F.max("headed").alias("any"))
    parsed = cut.join(files, "file")
    header = F.when(F.col("headed"), F.regexp_replace(F.get("lines", F.lit(0)), r"^>\s*", "")).otherwise("")
    body = F.concat_ws("", F.when(F.col("headed"), F.expr("slice(lines, 2, greatest(size(lines) - 1, 0))")).otherwise(F.col("lines")))
    records = parsed.where("any").select(header.alias("header"), F.upper(body).alias("sequence"))
    nameless = (F.col("header") == "") & (F.col("sequence") != "")
    checked = F.when(nameless, F.raise_error(F.lit("a sequence stands before the first header"))).otherwise(F.col("sequence"))
    named = records.where((F.col("header") != "") | (F.col("sequence") != "")).select("header", checked.cast("string").alias("sequence"))
    bare = parsed.where("not any").select(F.explode("lines").alias("line")).select(F.col("line").alias("header"), F.upper("line").alias("sequence"))
    return named.unionByName(bare)


def peptides(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """One record for each run of letters in documents' texts, in upper case, with the document's columns `keep`."""
    words = F.explode(F.regexp_extract_all(F.col("text"), F.lit("[A-Za-z]+"), F.lit(0))).alias("word")
    return docs.select(*keep, words).select(*keep, F.upper("word").alias("sequence"))


def accepted(records: DataFrame, strict: bool = False) -> DataFrame:
    """The valid records; strict: the first invalid one fails the job."""
    if strict:
        wrong = F.raise_error(F.concat(F.lit("invalid sequence: "), F.coalesce("sequence", F.lit("null"))))
        return records.withColumn("sequence", F.when(valid(F.col("sequence")), F.col("sequence")).otherwise(wrong.cast("string")))
    return records.where(valid(F.col("sequence")))


def counters(records: DataFrame) -> DataFrame:
    """One row: records, accepted, skipped."""
    good = F.count_if(valid(F.col("sequence")))
    return records.agg(F.count("*").alias("records"), good.alias("accepted"), (F.count("*") - good).alias("skipped"))


def clean_header(header: Column) -> Column:
    """A header with tabs and line ends as blanks."""
    return F.translate(header, "\t\r\n", "   ")


def labelled(spark: SparkSession, path: str, group_col: str, member_col: str, least_members: int = 1, where: str | None = None, sep: str = ",") -> DataFrame:
    """(member, label) pairs of a delimited export: trimmed, upper-case valid members, each pair once, of labels with enough members."""
    rows = spark.read.csv(path, header=True, sep=sep)
    rows = rows.where(where) if where else rows
    pairs = rows.select(F.upper(F.trim(member_col)).alias("member"), F.trim(group_col).alias("label")).where(valid(F.col("member"))).distinct()
    return label_floor(pairs, least_members)


def label_floor(pairs: DataFrame, least: int) -> DataFrame:
    """The distinct (member, label) pairs whose label has at least `least` different members."""
    pairs = pairs.select("member", "label").distinct()
    enough = pairs.groupBy("label").count().where(F.col("count") >= least).select("label")
    return pairs.join(enough, "label", "left_semi").select("member", "label")
