"""Binary token records: length-delimited frames with masked checksums, and an offset index for shuffled reads.

A data file is a run of frames, in ascending order of doc_id across the files:

    length   u64   bytes of the payload
    check    u32   masked crc32 of the eight length bytes
    payload        flags u8 (1: doc_id is null, 2: ids take 4 bytes, else 2), doc_id i64, ids
    check    u32   masked crc32 of the payload
    end      u8    0x0A

All numbers are little-endian.  Spark's text sink writes the frames (its line feed is the end byte), so files appear
by the output committer, whole or not at all, in any store that Spark can write.  The index is a Parquet table beside
them: file_no, record, offset, length, doc_id, n_ids, ids_before (ids of the file's earlier records).

The number of files follows from the bytes of all texts, FILE_BYTES of text a file, about, as a reader takes a file
whole; smaller tables have a file for each of the cluster's cores, of LEAST_BYTES at least.
Frames go through the text sink as strings that need not be valid UTF-8: Spark keeps a string's bytes and writes them as
they are, and reading back checks every byte.

Null texts count as empty (one end id).  Very long texts are one record each, whatever their length.  Rows with the same doc_id
keep a fixed order among themselves (by the hash of their text), and equal rows may stand in several files; null
doc_ids come first.  An empty table gives no files and an empty index.  Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trovex.llm.common import binaries, longs, mapped, strings
from trovex.llm.encoding import crc_of, encoder

HEAD, TAIL = struct.Struct("<QI"), struct.Struct("<IB")
OWN = struct.Struct("<Bq")
NO_ID, WIDE = 1, 2
END = 0x0A
#: Checksums are stored rotated and moved, so that a checksum of data that holds checksums stays sound.
ROTATE, MOVE = 15, 0xA282EAD8

#: Bytes of the texts of one data file, about.
FILE_BYTES, LEAST_BYTES = 32 << 20, 1 << 20
INDEX_SCHEMA = "file_no int, record int, offset long, length long, doc_id long, n_ids long, ids_before long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> ROTATE) | (crc << (32 - ROTATE))) + MOVE) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    body = OWN.pack((doc_id is None) * NO_ID + wide * WIDE, doc_id or 0) + ids.astype("<u4" if wide else "<u2").tobytes()
    size = struct.pack("<Q", len(body))
    return b"".join((size, struct.pack("<I", masked(size)), body, struct.pack("<I", masked(body))))


def frames(data: bytes | memoryview) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """(offset, length, doc_id, ids) of each frame of a data file; raises ValueError where a checksum is wrong."""
    view, at = memoryview(data), 0
    while at < len(view):
        end, doc_id, ids = frame_at(view, at)
        yield at, end - at, doc_id, ids
        at = end


def frame_at(view: memoryview, at: int) -> tuple[int, int | None, np.ndarray]:
    """The end, doc_id and ids of the frame at an offset."""
    if at + HEAD.size > len(view):
        raise ValueError(f"the frame at {at} is cut")
    n, check = HEAD.unpack_from(view, at)
    if masked(bytes(view[at : at + 8])) != check:
        raise ValueError(f"the length at {at} is damaged")
    body = view[at + HEAD.size : at + HEAD.size + n]
    end = at + HEAD.size + n + TAIL.size
    if end > len(view):
        raise ValueError(f"the frame at {at} is cut")
    check, last = TAIL.unpack_from(view, end - TAIL.size)
    if masked(bytes(body)) != check or last != END:
        raise ValueError(f"the record at {at} is damaged")
    flags, doc_id = OWN.unpack_from(body)
    ids = np.frombuffer(body[OWN.size :], "<u4" if flags & WIDE else "<u2")
    return end, None if flags & NO_ID else doc_id, ids


def encoded_frames(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """(doc_id, frame) in ascending order of doc_id; partition i holds lower ids than partition i + 1."""

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = encoder(vocabulary).encode(strings(batch.column(1)))
        out = [frame(d, np.append(x, np.uint32(end_id))) for d, x in zip(batch.column(0).to_pylist(), ids, strict=True)]
        return pa.record_batch([batch.column(0), binaries(out)], ["doc_id", "frame"])

    order = [F.col("doc_id"), F.xxhash64("text"), F.col("_at")]  # equal rows are alike, and may be cut apart
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-size // FILE_BYTES), min(docs.sparkSession.sparkContext.defaultParallelism, size // LEAST_BYTES))
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64(F.monotonically_increasing_id()).alias("_at"))
    dealt = rows.repartitionByRange(count, *order).sortWithinPartitions(*order).select("doc_id", "text")
    return mapped(dealt, encode, "doc_id long, frame binary")


def write_records(docs: DataFrame, path: str, vocabulary: str, end_id: int) -> None:
    """Writes the data files to path/data and their index to path/index."""
    spark = docs.sparkSession
    encoded_frames(docs, vocabulary, end_id).select(F.col("frame").cast("string").alias("value")).write.text(f"{path}/data")
    data_index(spark, path).write.parquet(f"{path}/index")


def files(spark: SparkSession, path: str) -> DataFrame:
    """(file_no, content) of the data files."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/data")
    return found.select(F.regexp_extract("path", r"part-(\d+)-[^/]*$", 1).cast("int").alias("file_no"), "content")


def data_index(spark: SparkSession, path: str) -> DataFrame:
    def index(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for no, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            before = 0
            for record, (offset, length, doc_id, ids) in enumerate(frames(content.as_buffer())):
                rows.append((no, record, offset, length, doc_id, len(ids), before))
                before += len(ids)
        columns = list(zip(*rows, strict=True)) or [()] * 7
        kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 5]
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in INDEX_SCHEMA.split(", ")])

    return mapped(files(spark, path), index, INDEX_SCHEMA)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX_SCHEMA).parquet(f"{path}/index")


def file_starts(spark: SparkSession, path: str) -> DataFrame:
    """(file_no, file_start): ids of all earlier files; one row for each file."""
    sizes = read_index(spark, path).groupBy("file_no").agg(F.sum("n_ids").alias("n"))
    before = W.orderBy("file_no").rowsBetween(W.unboundedPreceding, -1)
    return sizes.select("file_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("file_start"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record as (file_no, record, doc_id, ids_before, n_tokens, ids_crc32, ids binary of unsigned 32-bit integers)."""

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        no, record, doc, start, n, crc, raw = [], [], [], [], [], [], []
        for k, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            before = 0
            for i, (_, _, doc_id, ids) in enumerate(frames(content.as_buffer())):
                no.append(k)
                record.append(i)
                doc.append(doc_id)
                start.append(before)
                n.append(len(ids))
                crc.append(crc_of(ids))
                raw.append(ids.astype("<u4").tobytes())
                before += len(ids)
        columns = [pa.array(no, pa.int32()), pa.array(record, pa.int32()), pa.array(doc, pa.int64()), longs(start), longs(n), longs(crc), binaries(raw)]
        return pa.record_batch(columns, ["file_no", "record", "doc_id", "ids_before", "n_tokens", "ids_crc32", "ids"])

    return mapped(files(spark, path), read, "file_no int, record int, doc_id long, ids_before long, n_tokens long, ids_crc32 long, ids binary")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record, read and checked from the data files."""

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        no, doc, start, n, crc = [], [], [], [], []
        for k, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            before = 0
            for _, _, doc_id, ids in frames(content.as_buffer()):
                no.append(k)
                doc.append(doc_id)
                start.append(before)
                n.append(len(ids))
                crc.append(crc_of(ids))
                before += len(ids)
        return pa.record_batch([pa.array(no, pa.int32()), pa.array(doc, pa.int64()), longs(start), longs(n), longs(crc)], ["file_no", "doc_id", "ids_before", "n_tokens", "ids_crc32"])

    rows = mapped(files(spark, path), digest, "file_no int, doc_id long, ids_before long, n_tokens long, ids_crc32 long")
    joined = rows.join(file_starts(spark, path), "file_no")
    return joined.select("doc_id", (F.col("file_start") + F.col("ids_before")).alias("start"), "n_tokens", "ids_crc32")


def read_shuffled(spark: SparkSession, path: str, seed: int) -> DataFrame:
    """(place, doc_id, ids) in a seeded random order by the index: place is sorted within and across partitions.

    Each data file is read once; only the records travel, sorted by their draw.
    """
    picked = read_index(spark, path).select("file_no", "offset", F.xxhash64(F.lit(seed), "file_no", "record").alias("place"))
    wanted = picked.groupBy("file_no").agg(F.collect_list(F.struct("offset", "place")).alias("wanted"))  # as many as one file's records

    def fetch(batch: pa.RecordBatch) -> pa.RecordBatch:
        place, doc, raw = [], [], []
        for content, wanted in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            view = memoryview(content.as_buffer())
            for x in wanted:
                _, doc_id, ids = frame_at(view, x["offset"])
                place.append(x["place"])
                doc.append(doc_id)
                raw.append(ids.astype("<u4").tobytes())
        return pa.record_batch([longs(place), pa.array(doc, pa.int64()), binaries(raw)], ["place", "doc_id", "ids"])

    read = mapped(files(spark, path).join(wanted, "file_no").select("content", "wanted"), fetch, "place long, doc_id long, ids binary")
    return read.repartitionByRange("place").sortWithinPartitions("place")
