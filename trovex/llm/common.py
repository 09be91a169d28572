"""What the text operators share: words, the shared folder, batches, running totals."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_SQL = r"[^\x20\x09-\x0D]+"
UPPER_TO_LOWER = {c: c + 32 for c in range(65, 91)}
#: Documents and bytes of one Arrow batch, so that a batch of long documents fits a Python worker.
BATCH_ROWS = 1000
#: Buckets, blocks or ranges that rows equal in every column are dealt to, at most.
REPEATS = 64
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: str) -> str:
    """Lower-cases A-Z only."""
    return text.lower() if text.isascii() else text.translate(UPPER_TO_LOWER)


def bounded(spark: SparkSession) -> None:
    """Bounds the bytes of the batches that go to Python, as texts are long; the only setting of the session that is changed, always to the same value."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most so many rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def private(df: DataFrame, name: str) -> str:
    """A name for a column of our own, which df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def small(df: DataFrame, bound: int = 1_000_000) -> DataFrame:
    """A stored table of a few numbers a row: broadcast if it has at most bound rows, else left to be shuffled."""
    return F.broadcast(df) if df.count() <= bound else df


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir that driver and executors share; where it is unset, in local mode, one of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = f"file://{tempfile.gettempdir()}/trovex-shared"
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path for one table in the shared folder."""
    return f"{shared_folder(spark)}/trovex/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Writes df to the shared folder and reads it again: the lineage ends there, and a lost executor costs no more than what reads it."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mapped(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = BATCH_ROWS) -> DataFrame:
    """mapInArrow with a function of one batch, of at most so many rows, that gives one batch."""
    bounded(df.sparkSession)
    return df.mapInArrow(lambda batches: map(f, slices(batches, rows)), schema)


def unsigned_draw(*parts: Column | str) -> Column:
    """A number in (0, 1), the same for the same parts everywhere."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / float(1 << 53)


def numbered(df: DataFrame, group: list[str], order: list[Column], name: str, rows_each: int = 20_000, at_least: int = 64) -> DataFrame:
    """Adds name: a gapless number from 0 in each group, without one task for a group.

    Rows are dealt to buckets by the hash of their whole row, numbered in each (group, bucket), and moved up by the
    sizes of the buckets before, a small table.  Rows that are equal in every column are dealt by their place in the
    table as well, so they don't share a bucket; as they are alike, the numbers depend on the rows and their count only
    where none repeats.
    """
    df = stored(df.withColumn("_at", F.monotonically_increasing_id()), "rows")
    buckets = max(at_least, -(-df.count() // rows_each))
    dealt = df.withColumn("_bucket", F.pmod(F.pmod(F.xxhash64(*[c for c in df.columns if c != "_at"]), F.lit(buckets)) + F.pmod(F.xxhash64("_at"), F.lit(REPEATS)), F.lit(buckets)).cast("int")).drop("_at")
    df = df.drop("_at")
    from pyspark.sql import Window as W

    sizes = dealt.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(*group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(W.partitionBy(*group, "_bucket").orderBy(*order)) - 1
    keys = [F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}")) for g in group] + [F.col("l._bucket") == F.col("r._bucket")]
    on = keys[0]
    for k in keys[1:]:
        on = on & k
    left = dealt.withColumn("_place", place).alias("l")
    return left.join(sizes.alias("r"), on).select(*[F.col(f"l.{c}") for c in df.columns], (F.col("l._place") + F.col("r._before")).alias(name))


def drawn(df: DataFrame, most: int, rank: Column, *ties: str) -> DataFrame:
    """The rows of the lowest ranks, most at most; rank is a 64-bit hash.

    A larger table is first cut to the ranks that about twice as many rows have, so few rows travel to be sorted.
    """
    df = df.withColumn("_rank", rank)
    n = df.count()
    if n > 4 * most:
        df = df.where(F.col("_rank") < int(-(1 << 63) + (1 << 64) * 2 * most / n))
    return df.orderBy("_rank", *ties).limit(most).drop("_rank")


def strings(column: pa.Array) -> list[str]:
    """A column of texts as Python strings; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def binaries(chunks: list[bytes]) -> pa.Array:
    return pa.array(chunks, type=pa.binary())


def longs(values: list[int] | np.ndarray) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.int64))
