"""Tables that grow by numbered batches and are merged into versioned bases, on files alone.

    <path>/<kind>/batch=N      what micro-batch N appended; a batch that runs again writes the same files again
    <path>/<kind>-V            a base: all batches up to some number, merged
    <path>/versions/version=V  (merged, at): the last batch that base V has merged, and when; written last, so a
                               version that can be seen is whole

Readers take the newest version and the batches after it.  Nothing that a reader may hold is written again; clean()
removes versions older than the kept ones and the batches that all kept ones have merged.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSIONS = "merged long, at timestamp_ntz, version long"


@dataclass(frozen=True)
class Versioned:
    spark: SparkSession
    path: str

    def append(self, kind: str, number: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{kind}/batch={number}")

    def _read(self, folder: str, schema: str) -> DataFrame:
        """What is in a folder with partitions; nothing where there is no folder yet."""
        try:
            return self.spark.read.schema(schema).option("basePath", f"{self.path}/{folder}").parquet(f"{self.path}/{folder}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise  # a read that fails is not an empty table
            return self.spark.createDataFrame([], schema)

    def batch(self, kind: str, schema: str, number: int) -> DataFrame:
        """One batch as it was written."""
        return self.spark.read.schema(schema).parquet(f"{self.path}/{kind}/batch={number}")

    def batches(self, kind: str, schema: str, after: int, until: int | None = None) -> DataFrame:
        """The rows of the batches after a number, and up to another; other batches are not read."""
        found = self._read(kind, f"{schema}, batch long").where(F.col("batch") > after)
        return (found if until is None else found.where(F.col("batch") <= until)).drop("batch")

    def last_batch(self, kind: str, schema: str) -> int:
        """The number of the last batch, -1 without one."""
        found = self._read(kind, f"{schema}, batch long").agg(F.max("batch")).first()[0]
        return -1 if found is None else found

    def versions(self) -> DataFrame:
        """(version, merged, at), one row for each version that is kept."""
        return self._read("versions", VERSIONS).select("version", "merged", "at")

    def newest(self) -> tuple[int, int, datetime | None]:
        """(version, merged, at) of the newest version; (0, -1, null) before the first."""
        row = self.versions().agg(F.max(F.struct("version", "merged", "at")).alias("v")).first()
        return tuple(row.v) if row and row.v else (0, -1, None)

    def base(self, kind: str, schema: str, version: int) -> DataFrame:
        """A base as it was written; version 0 is empty."""
        return self.spark.read.schema(schema).parquet(f"{self.path}/{kind}-{version}") if version else self.spark.createDataFrame([], schema)

    def write_base(self, kind: str, version: int, rows: DataFrame) -> None:
        """Writes a base that no version points at yet; what a failed attempt left is replaced."""
        rows.write.mode("overwrite").parquet(f"{self.path}/{kind}-{version}")

    def publish(self, version: int, merged: int, at: datetime) -> None:
        """Points readers at a version whose bases are written."""
        self.spark.createDataFrame([(merged, at)], "merged long, at timestamp_ntz").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/versions/version={version}")

    def unmerged_bytes(self, kind: str) -> int:
        """Bytes of the batches that no base has merged; names and sizes of files alone are read."""
        merged = self.newest()[1]
        batch = F.regexp_extract("path", r"/batch=(\d+)/", 1).try_cast("long")
        try:
            found = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(f"{self.path}/{kind}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0
        return found.where(batch > merged).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]

    def due(self, kind: str, threshold_mb: int, every_seconds: float, now: datetime) -> bool:
        """Whether the last merge is so long ago, and what has come since then so large."""
        at = self.newest()[2]
        return (at is None or (now - at).total_seconds() >= every_seconds) and self.unmerged_bytes(kind) >> 20 >= threshold_mb

    def clean(self, kinds: list[str], keep: int = 2) -> int:
        """Removes what readers of the newest keep versions don't need; returns the number of folders that went.

        The pointer of a version goes before its bases, so no reader is led to one that is on its way out.
        """
        kept = [(r.version, r.merged) for r in self.versions().orderBy(F.desc("version")).limit(keep).collect()]
        if len(kept) < keep:
            return 0
        oldest, merged = kept[-1]
        names = lambda folder: [p.getPath() for p in self._listed(folder)]
        number = lambda p, sep: int(t) if (t := p.getName().rpartition(sep)[2]).isdigit() else None
        gone = [p for p in names("versions") if (n := number(p, "=")) is not None and n < oldest]
        gone += [p for p in names("") for kind in kinds if p.getName().startswith(f"{kind}-") and (n := number(p, "-")) is not None and n < oldest]
        gone += [p for kind in kinds for p in names(kind) if p.getName().startswith("batch=") and (n := number(p, "=")) is not None and n <= merged]
        for p in gone:
            self._files(p).delete(p, True)
        return len(gone)

    def _files(self, path: object) -> object:
        """The file system of a path of the JVM's."""
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self, folder: str) -> list:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}".rstrip("/"))
        files = self._files(at)
        return list(files.listStatus(at)) if files.exists(at) else []
