"""A content-addressed WARC archive: each payload once, by verified digest; record headers apart; records by join."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motifloom.llm.common import columns_of

#: Date written into records, as the tables have no fetch time.
DATE = "2024-01-01T00:00:00Z"
# Fixed value: the base-32 alphabet, beside the digits that conv() uses.
_BASE32, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"


@dataclass
class Archive:
    """Folders of an archive: headers(record_id, header, block_digest, payload_address) and payloads(address, payload)."""

    path: str

    @property
    def headers(self) -> str:
        return f"{self.path}/headers"

    @property
    def payloads(self) -> str:
        return f"{self.path}/payloads"


def base32_sha1(data: Column) -> Column:
    """The SHA-1 of a binary column in upper-case base 32, 32 characters."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.upper(F.concat(*parts)), _DIGITS, _BASE32)


def _header(kind: Column, uri: Column, record: Column, sha1: Column, size: Column, refers: Column, refers_uri: Column) -> Column:
    """The header block of a record, with CRLF ends and the empty line after it."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    always = [
        F.lit("WARC/1.1\r\n"), line("WARC-Type", kind), line("WARC-Record-ID", record), line("WARC-Date", F.lit(DATE)), line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)), line("Content-Type", F.lit("text/html;charset=utf-8")),
    ]
    revisit = F.concat(
        line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", refers),
        line("WARC-Refers-To-Target-URI", refers_uri), line("Content-Length", F.lit("0")),
    )
    full = line("Content-Length", size.cast("string"))
    return F.concat(*always, F.when(kind == "revisit", revisit).otherwise(full), F.lit("\r\n"))


def record_name(record_id: Column) -> Column:
    """The WARC-Record-ID of an integer id: a URN that holds it."""
    return F.concat(F.lit("<urn:page:"), record_id.cast("string"), F.lit(">"))


def write(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", body_col: str = "html", least_bytes: int = 0) -> Archive:
    """Writes one record a row. Of records with equal payloads of at least least_bytes, the one with the smallest id is a response and the others revisit it.

    Payloads are addressed by SHA-256. Only digests are shuffled to find the first of each payload;
    the payloads of first records alone are written, each once. Null payloads count as empty, null
    addresses as empty URIs with line ends removed; rows without an id are left out; of rows that
    repeat an id and its payload, each is a record.
    """
    archive = Archive(path)
    own = columns_of(pages, [(id_col, "id"), (uri_col, "uri"), (body_col, "body")]).where("id is not null")
    body = F.coalesce(F.col("body"), F.lit("")).cast("binary")
    own = own.select("id", F.translate(F.coalesce("uri", F.lit("")), "\r\n", "").alias("uri"), body.alias("payload"))
    marked = own.select("id", "uri", F.sha2("payload", 256).alias("address"), base32_sha1(F.col("payload")).alias("sha1"), F.length("payload").cast("long").alias("size"))
    first = marked.groupBy("address").agg(F.min(F.struct("id", "uri")).alias("first")).select(F.col("address").alias("held"), "first")
    joined = marked.join(first, F.col("address") == F.col("held"))
    kind = F.when((F.col("size") >= least_bytes) & (F.col("id") != F.col("first.id")), "revisit").otherwise("response")
    header = _header(kind, F.col("uri"), record_name(F.col("id")), F.col("sha1"), F.col("size"), record_name(F.col("first.id")), F.col("first.uri"))
    joined.select(F.col("id").alias("record_id"), header.cast("binary").alias("header"), F.col("address").alias("payload_address")).write.parquet(archive.headers)
    # ids tell first records apart, so rows that repeat one are dropped where the join has them together
    keep = first.select(F.col("first.id").alias("keep_id"), "held")
    bodies = own.select("id", "payload", F.sha2("payload", 256).alias("address"))
    bodies.join(keep, (F.col("id") == F.col("keep_id")) & (F.col("address") == F.col("held"))).dropDuplicates(["id", "address"]).select("address", "payload").write.parquet(archive.payloads)
    return archive


def verified(spark: SparkSession, archive: Archive) -> DataFrame:
    """payloads(address, payload); reading one whose bytes do not have their address fails."""
    stored = spark.read.schema("address string, payload binary").parquet(archive.payloads)
    right = F.when(F.sha2("payload", 256) == F.col("address"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its address "), F.col("address"))))
    return stored.select("address", right.cast("binary").alias("payload"))


def headers(spark: SparkSession, archive: Archive) -> DataFrame:
    """The header fields of every record, read from its header block."""
    stored = spark.read.schema("record_id long, header binary, payload_address string").parquet(archive.headers)
    text = F.col("header").cast("string")
    field = lambda name: F.regexp_extract(text, rf"\r\n{name}: ([^\r]*)\r\n", 1)
    page = lambda name: F.regexp_extract(text, rf"\r\n{name}: <urn:page:(-?[0-9]+)>\r\n", 1)
    return stored.select(
        page("WARC-Record-ID").cast("long").alias("record_id"), "header", "payload_address", field("WARC-Type").alias("record_type"),
        F.nullif(page("WARC-Refers-To"), F.lit("")).cast("long").alias("refers_to"), F.regexp_extract(field("WARC-Payload-Digest"), "sha1:(.*)", 1).alias("stated_digest"),
    )


def records(spark: SparkSession, archive: Archive) -> DataFrame:
    """(record_id, record binary): the exact bytes of each original record; revisits have an empty block."""
    end = F.lit("\r\n\r\n").cast("binary")
    found = headers(spark, archive)
    whole = found.where("record_type = 'response'").join(verified(spark, archive), F.col("payload_address") == F.col("address"))
    whole = whole.select("record_id", F.concat("header", "payload", end).alias("record"))
    return whole.unionByName(found.where("record_type = 'revisit'").select("record_id", F.concat("header", end).alias("record")))


def pages(spark: SparkSession, archive: Archive) -> DataFrame:
    """(record_id, payload): every record's full payload, revisits through the payload that they refer to."""
    found = headers(spark, archive).select("record_id", "payload_address")
    return found.join(verified(spark, archive), F.col("payload_address") == F.col("address")).select("record_id", "payload")


def summary(spark: SparkSession, archive: Archive) -> DataFrame:
    """Per record what the archive holds: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    Each stored payload is verified and measured once; only its digest and size are joined to records.
    A record whose stated digest is not that of its payload fails the job.
    """
    measured = verified(spark, archive).select("address", F.length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))
    joined = headers(spark, archive).join(measured, F.col("payload_address") == F.col("address"))
    digest = F.when(F.col("payload_digest") == F.col("stated_digest"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a record states another digest")))
    return joined.select(F.col("record_id").alias("page_id"), "payload_bytes", digest.cast("string").alias("payload_digest"), "record_type", "refers_to")
