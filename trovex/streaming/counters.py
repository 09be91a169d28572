"""Usage counters that follow a stream: partial counts a micro-batch, merged on read and by compaction.

A counter that is raised on each use needs no update in place: counts add up, first and last uses are least and
greatest, a title is the one of the greatest (ts, event_id).  Each micro-batch writes its own partial counts under its
number, so a batch that runs twice counts once.  compact() merges them into the base of a new version (versioned.py).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from trovex.streaming.cdc import utc_now
from trovex.streaming.versioned import Versioned


class Counters:
    """Counters by keys of a log with ts and event_id, and the latest value of other columns, kept in the folder at."""

    def __init__(self, spark: SparkSession, at: str, log: StructType, keys: list[str], latest: tuple[str, ...] = ()):
        self.table, self.keys, self.latest = Versioned(spark, at), keys, latest
        kinds = {f.name: f.dataType.simpleString() for f in log}
        place = f"struct<ts:{kinds['ts']},event_id:{kinds['event_id']}>"
        columns = [*((k, kinds[k]) for k in keys), ("count", "bigint"), ("last_used", kinds["ts"]), ("created_at", kinds["ts"]), ("place", place), *((c, kinds[c]) for c in latest)]
        self.schema = ", ".join(f"`{name}` {kind}" for name, kind in columns)

    def partial(self, log: DataFrame) -> DataFrame:
        place = F.struct("ts", "event_id")
        return log.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("count"), F.max("ts").alias("last_used"), F.min("ts").alias("created_at"), F.max(place).alias("place"), *[F.max_by(c, place).alias(c) for c in self.latest])

    def merged(self, parts: DataFrame) -> DataFrame:
        return parts.groupBy(*self.keys).agg(F.sum("count").alias("count"), F.max("last_used").alias("last_used"), F.min("created_at").alias("created_at"), F.max("place").alias("place"), *[F.max_by(c, "place").alias(c) for c in self.latest])

    def append(self, batch: DataFrame, number: int) -> None:
        self.table.append("counts", number, self.partial(batch))

    def follow(self, log: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        """Starts a query that counts a stream; its place is in checkpoint."""
        writer = log.writeStream.foreachBatch(self.append).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")).start()

    def _parts(self, until: int | None = None) -> DataFrame:
        version, merged, _ = self.table.newest()
        return self.table.base("total", self.schema, version).unionByName(self.table.batches("counts", self.schema, merged, until))

    def read(self) -> DataFrame:
        """(keys, count, last_used, created_at, latest columns) of all batches so far."""
        return self.merged(self._parts()).drop("place")

    def compact(self, now: datetime | None = None, keep: int = 2) -> int:
        """Merges all batches into a new version, and removes what the newest keep versions don't need; returns the version."""
        version, merged, _ = self.table.newest()
        last = max(merged, self.table.last_batch("counts", self.schema))  # a batch that comes meanwhile is left for the next time
        self.table.write_base("total", version + 1, self.merged(self._parts(last)))
        self.table.publish(version + 1, last, now or utc_now())
        self.table.clean(["counts", "total"], keep)
        return version + 1
