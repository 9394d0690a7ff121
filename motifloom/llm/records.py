"""Token ids as length-delimited binary records with masked checksums, beside an offset index."""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from motifloom.llm.common import columns_of, id_ranges, shuffles
from motifloom.llm.tokens import batched, rows, tokenizer

# Fixed value: what is added to a rotated checksum, so that records may hold records.
MASK = 0xA282EAD8
#: Files that one range of ids may have; shards are numbered by range and file.
FILES = 1 << 20
INDEX = "shard long, row long, doc_id long, at long, size long, n_tokens long, before long"
_INDEX = pa.schema([(c, pa.int64()) for c in ("shard", "row", "doc_id", "at", "size", "n_tokens", "before")])


def masked(data: bytes) -> int:
    """CRC-32 of data, rotated right by 15 bits, plus a constant."""
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    """A record: length (8 bytes), its masked checksum, the data, their masked checksum; little-endian."""
    size = struct.pack("<Q", len(data))
    return size + struct.pack("<I", masked(size)) + data + struct.pack("<I", masked(data))


def unframe(raw: bytes) -> bytes:
    """The data of a record; raises ValueError if a length or checksum differs."""
    if len(raw) < 16:
        raise ValueError("a record is cut off")
    size, check = struct.unpack_from("<QI", raw)
    if masked(raw[:8]) != check or len(raw) != size + 16:
        raise ValueError("a record's length differs")
    data = raw[12 : 12 + size]
    if masked(data) != struct.unpack_from("<I", raw, 12 + size)[0]:
        raise ValueError("a record's checksum differs")
    return data


def pack_ids(ids: bytes, width: int, end: tuple[int, ...] = ()) -> bytes:
    """Ids (bytes of 32-bit integers) and end ids: one byte with the width of an id, then the ids at that width."""
    got = np.concatenate((np.frombuffer(ids, "<u4"), np.array(end, "<u4")))
    return bytes([width]) + got.astype(f"<u{width}").tobytes()


def unpack_ids(data: bytes) -> np.ndarray:
    """The ids of a record's data, as little-endian unsigned 32-bit integers."""
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype("<u4")


def _shard(folder: str, shard: int):
    """The file system and the path in it of a shard's file."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder) if "://" in folder else fs.FileSystem.from_uri("file://" + os.path.abspath(folder))
    return system, f"{root}/shard-{shard:012d}.bin"


class _Writer:
    """One shard's file: written under a name of its own, then renamed, so a repeated task leaves the same file."""

    def __init__(self, folder: str, shard: int):
        self._fs, self._path = _shard(folder, shard)
        self._fs.create_dir(self._path.rpartition("/")[0], recursive=True)
        self._own = f"{self._path}.{uuid.uuid4().hex}"
        self._out, self.at, self.row, self.before = self._fs.open_output_stream(self._own), 0, 0, 0

    def add(self, data: bytes) -> tuple[int, int]:
        raw = frame(data)
        self._out.write(raw)
        at, self.at = self.at, self.at + len(raw)
        return at, len(raw)

    def close(self) -> None:
        self._out.close()
        self._fs.move(self._own, self._path)


def write(docs: DataFrame, folder: str, tokenizer_path: str, end: tuple[int, ...] = (), id_col: str = "doc_id", text_col: str = "text", per_shard: int = 5000, ranges: int = 20_000) -> None:
    """Encodes every text (null: empty) and writes its ids, in ascending order of doc_id over shards and within each.

    folder/data has a file a shard, folder/index a Parquet table: shard, row, doc_id, at (byte of the
    record), size, n_tokens, before (ids before it in the shard). Ids are cut into ranges of about
    per_shard rows, or into so many `ranges` if that is fewer; texts are shuffled once. A range is written as a stream and
    cut again: a file ends after 2 * per_shard rows, whatever the table's size. Null ids come first; of rows with equal ids, each is written.
    """
    own = columns_of(docs, [(id_col, "doc_id"), (text_col, "text")])
    data = f"{folder}/data"

    def run(batches: Iterator) -> Iterator:
        t = tokenizer(tokenizer_path)

        def one():
            out, held, shard = None, None, 0
            for block, doc, text in rows(batches, "block", "doc_id", "text"):
                if block != held or out.row == 2 * per_shard:
                    if out:
                        out.close()
                    held, shard = block, shard + 1 if block == held else (block + 1) * FILES
                    out = _Writer(data, shard)
                ids = t.encode(text)
                at, size = out.add(pack_ids(ids, t.width, end))
                n = len(ids) // 4 + len(end)
                yield shard, out.row, doc, at, size, n, out.before
                out.row, out.before = out.row + 1, out.before + n
            if out:
                out.close()

        yield from batched(one(), _INDEX)

    block, n_rows = id_ranges(own, "doc_id", per_shard, ranges)
    placed = own.withColumn("block", block)
    placed = placed.repartition(shuffles(own.sparkSession, n_rows, per_shard), "block").sortWithinPartitions("block", F.col("doc_id").asc_nulls_first(), "text")
    placed.select("block", "doc_id", "text").mapInArrow(run, INDEX).write.parquet(f"{folder}/index")


def index(spark: SparkSession, folder: str) -> DataFrame:
    """The index with `start`: the ids of all documents before. Only shard totals are summed over shards."""
    found = spark.read.schema(INDEX).parquet(f"{folder}/index")
    totals = found.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    # sums over groups of 4096 shards, then over the groups, so that no window runs over all shards of a large archive
    totals = totals.withColumn("group", F.floor(F.col("shard") / 4096))
    groups = totals.groupBy("group").agg(F.sum("n").alias("g"))
    groups = groups.select(F.col("group").alias("in_group"), (F.sum("g").over(W.orderBy("group")) - F.col("g")).alias("groups_before"))
    within = totals.select("shard", "group", (F.sum("n").over(W.partitionBy("group").orderBy("shard")) - F.col("n")).alias("shards_before"))
    starts = within.join(groups, F.col("group") == F.col("in_group")).select(F.col("shard").alias("of"), (F.col("groups_before") + F.col("shards_before")).alias("shard_start"))
    return found.join(starts, F.col("shard") == F.col("of")).select(*found.columns, (F.col("shard_start") + F.col("before")).alias("start"))


def read(entries: DataFrame, folder: str, ids: bool = True) -> DataFrame:
    """The records that rows of index() name, in any order: (doc_id, start, n_tokens, ids_crc32, ids array<long> if asked for).

    Each is read by its offset and verified. Entries are dealt by shard and opened once a shard.
    """
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * ids
    schema, data = pa.schema(fields), f"{folder}/data"

    def run(batches: Iterator) -> Iterator:
        def one():
            held, stream = None, None
            for shard, doc, at, size, start in rows(batches, "shard", "doc_id", "at", "size", "start"):
                if shard != held:
                    if stream:
                        stream.close()
                    system, path = _shard(data, shard)
                    held, stream = shard, system.open_input_file(path)
                got = unpack_ids(unframe(stream.read_at(size, at)))
                yield (doc, start, len(got), zlib.crc32(got.tobytes())) + (got.tolist(),) * ids
            if stream:
                stream.close()

        yield from batched(one(), schema, 256 if ids else 4096)

    dealt = entries.select("shard", "doc_id", "at", "size", "start").repartition("shard").sortWithinPartitions("shard", "at")
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids)
