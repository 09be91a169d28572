"""Files as tables: JSON arrays, folders of JSON objects, listings by extension, snapshots with a version and an age."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A snapshot that is older than this is built anew.
OLDEST = timedelta(hours=24)
LISTING = "path string, name string, size long, modified timestamp"
ENTRY = "version int, created timestamp_ntz, path string"


def _or_empty(spark: SparkSession, read: Callable[[], DataFrame], schema: str) -> DataFrame:
    """What read gives; no rows where its path does not exist."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The elements of a file that holds one JSON array; a file that is no JSON is an error, a missing one has no rows.

    One file is read by one task, as its records can only be told from its start on.
    """
    reader = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST")
    return _or_empty(spark, lambda: reader.json(path), schema)


def json_folder(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """An object for each *.json file of a folder, not of those below it; files that are no JSON are left out."""
    reader = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.json")
    return _or_empty(spark, lambda: reader.json(folder), schema)


def listing(spark: SparkSession, folder: str, extension: str) -> DataFrame:
    """(path, name, size, modified) of the files at any depth with an extension, whatever its case; contents are not read.

    name is the file's name without its extension.
    """

    def read() -> DataFrame:
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
        whole = F.element_at(F.split("path", "/"), -1)
        ends = F.endswith(F.lower(whole), F.lit("." + extension.lstrip(".").lower()))
        name = F.regexp_replace(whole, r"(?<=.)\.[^.]*$", "")
        return rows.where(ends & (name != whole)).select("path", name.alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))

    return _or_empty(spark, read, LISTING)


def snapshot(spark: SparkSession, folder: str, version: int, now: datetime, build: Callable[[], DataFrame], oldest: timedelta = OLDEST) -> DataFrame:
    """The newest stored rows of a version, or, where there are none or they are older than oldest, what build gives.

    New rows are written first and then entered in the list of snapshots, so a reader never sees half of them.
    """
    entries = _or_empty(spark, lambda: spark.read.schema(ENTRY).parquet(f"{folder}/entries"), ENTRY)
    last = entries.where(F.col("version") == version).orderBy(F.desc("created")).first()
    if last is not None and now - last.created <= oldest:
        return spark.read.parquet(last.path)
    path = f"{folder}/rows-{uuid4().hex}"
    build().write.parquet(path)
    spark.createDataFrame([(version, now, path)], ENTRY).coalesce(1).write.mode("append").parquet(f"{folder}/entries")
    return spark.read.parquet(path)
