"""Postings as bitmaps: a row (gram, bucket, files) holds the files of one gram among 32,768 consecutive file_ids.

AND and OR of searches are bitwise aggregates within a bucket, and counts are counts of bits, so neither looks at single
files.  All functions are Spark's own; a bitmap has 4,096 bytes, of which the runs of zeros are compressed in storage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: File_ids of one bucket.
WIDTH = 32_768


def bitmap_postings(posts: DataFrame) -> DataFrame:
    """(gram, bucket, files) of postings (gram, file_id); repeated postings count once.  Null file_ids are no files."""
    placed = posts.where("file_id IS NOT NULL").select("gram", F.bitmap_bucket_number("file_id").alias("bucket"), F.bitmap_bit_position("file_id").alias("position"))
    return placed.groupBy("gram", "bucket").agg(F.bitmap_construct_agg("position").alias("files"))


def with_delta(base: DataFrame, added: DataFrame) -> DataFrame:
    """Base and delta as one table of bitmaps."""
    return base.unionByName(added).groupBy("gram", "bucket").agg(F.bitmap_or_agg("files").alias("files"))


def search_and(bitmaps: DataFrame, grams: list[str]) -> DataFrame:
    """(bucket, files): the files that have every one of some different grams; no row for none."""
    hits = bitmaps.where(F.col("gram").isin(grams)).groupBy("bucket").agg(F.bitmap_and_agg("files").alias("files"), F.count(F.lit(1)).alias("_n"))
    return hits.where((F.col("_n") == len(grams)) & (F.bitmap_count("files") > 0)).select("bucket", "files")


def search_or(bitmaps: DataFrame, grams: list[str]) -> DataFrame:
    """(bucket, files): the files that have any of some grams."""
    return bitmaps.where(F.col("gram").isin(grams)).groupBy("bucket").agg(F.bitmap_or_agg("files").alias("files"))


def posting_counts(bitmaps: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """(gram, n_files), without removed bitmaps (gram, bucket, files) that may hold files which bitmaps don't."""
    size = F.bitmap_count("files").alias("n")
    if removed is None:
        counts = bitmaps.select("gram", size)
    else:
        pair = bitmaps.unionByName(removed).groupBy("gram", "bucket").agg(F.bitmap_and_agg("files").alias("files"), F.count(F.lit(1)).alias("_n"))
        both = pair.where("_n = 2").join(bitmaps.select("gram", "bucket"), ["gram", "bucket"], "left_semi")
        counts = bitmaps.select("gram", size).union(both.select("gram", -F.bitmap_count("files")))
    return counts.groupBy("gram").agg(F.sum("n").alias("n_files")).where("n_files > 0")


def file_ids(found: DataFrame, *kept: str) -> DataFrame:
    """kept columns and file_id, one row for each bit of (bucket, files)."""
    byte = lambda i: F.expr(f"CAST(conv(hex(substring(files, {i} + 1, 1)), 16, 10) AS INT)")
    full = F.expr("filter(sequence(0, octet_length(files) - 1), i -> substring(files, i + 1, 1) <> X'00')")
    bytes_ = found.select(*kept, "bucket", "files", F.explode(full).alias("_at")).select(*kept, "bucket", "_at", byte("_at").alias("_byte"))
    position = F.explode(F.expr("transform(filter(sequence(0, 7), k -> shiftright(_byte, k) & 1 = 1), k -> _at * 8 + k)")).alias("_position")
    return bytes_.select(*kept, "bucket", position).select(*kept, number(F.col("bucket"), F.col("_position")).alias("file_id"))


def number(bucket: Column, position: Column) -> Column:
    """The file_id of a bit: buckets from 1 on count up from 1, the others down from 0."""
    return F.when(bucket > 0, (bucket - 1) * WIDTH + position + 1).otherwise(bucket * WIDTH - position)
