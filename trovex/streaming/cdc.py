"""A change journal that keeps a file table and its trigram index up to date.

Each micro-batch of changes is appended under its number: the changes; the postings (gram, frn, seq) of the names that
they leave; and marks (frn, seq), after which older postings of a file no longer hold.  A batch that runs again writes
the same files again.  The latest change of each file counts; a deleted file has none, and a rename is the delete of
the old name and the insert of the new one, which the latest change alone expresses.

compact() merges batches and base into a new version (versioned.py): the state, and the index, whose postings are
carried over without a look at the names and sorted by gram, so a search reads the row groups of its grams.  Readers
go on with the old version until then.  A journal comes in the order of seq: a change that arrives after a compaction
has merged later ones counts only where the file is still there.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from trovex.functions.text import contains, trigrams
from trovex.operators.index import query_grams
from trovex.streaming.versioned import Versioned

CREATE, DELETE, RENAME = 0x100, 0x200, 0x1000
STATE = "frn long, name string, seq long"
CHANGE = "seq long, frn long, reason int, name string, ts timestamp_ntz"
POSTING, MARK = "gram string, frn long, seq long", "frn long, seq long"
#: Megabytes of a delta at which it is merged, and seconds between merges.
MERGE_MB, MERGE_SECONDS = 50, 300
#: Folders of batches, and of bases.
KINDS = ["delta", "postings", "marks", "base", "index"]


def utc_now() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)


def told(changes: DataFrame) -> DataFrame:
    """The changes that say something of a file's name."""
    return changes.where(F.col("reason").bitwiseAND(F.lit(CREATE | DELETE | RENAME)) != 0)


def latest_state(changes: DataFrame) -> DataFrame:
    """(frn, name, seq) of the files that are there after all changes."""
    last = told(changes).groupBy("frn").agg(F.max_by(F.struct("name", "reason", "seq"), "seq").alias("c"))
    return last.where(F.col("c.reason").bitwiseAND(F.lit(DELETE)) == 0).select("frn", "c.name", "c.seq")


def append_changes(batch: DataFrame, table: str, number: int) -> None:
    """Appends one micro-batch: its changes, then what they do to the index."""
    at = Versioned(batch.sparkSession, table)
    at.append("delta", number, batch.select("seq", "frn", "reason", "name", "ts"))
    changes = at.batch("delta", CHANGE, number)
    at.append("marks", number, told(changes).groupBy("frn").agg(F.max("seq").alias("seq")))
    at.append("postings", number, latest_state(changes).select(F.explode(trigrams(F.col("name"))).alias("gram"), "frn", "seq"))


def follow(changes: DataFrame, table: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Starts a query that appends a stream of changes to a table and its index.

    Its place in the stream is in checkpoint; after a restart it goes on from there.
    """
    writer = changes.writeStream.foreachBatch(lambda batch, number: append_changes(batch, table, number)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")).start()


def versions(spark: SparkSession, table: str) -> DataFrame:
    """(version, merged, at): base versions, the last batch that each has merged, and when."""
    return Versioned(spark, table).versions()


def current(spark: SparkSession, table: str, until: int | None = None) -> tuple[DataFrame, int, int]:
    """The state of a table, its version, and the last batch that the base has merged; until: the last batch that counts."""
    at = Versioned(spark, table)
    version, merged, _ = at.newest()
    base = at.base("base", STATE, version).select("seq", "frn", F.lit(CREATE).alias("reason"), "name", F.lit(None).cast("timestamp_ntz").alias("ts"))
    return latest_state(at.batches("delta", CHANGE, merged, until).unionByName(base)), version, merged


def live(posts: DataFrame, marks: DataFrame, base: DataFrame) -> DataFrame:
    """Rows with (frn, seq) that no later change or base state of their file has replaced."""
    last = marks.groupBy("frn").agg(F.max("seq").alias("_last"))
    kept = posts.join(last, "frn", "left").join(base.select("frn", F.col("seq").alias("_base")), "frn", "left")
    return kept.where("seq >= coalesce(_last, seq) AND seq >= coalesce(_base, seq)").select(*posts.columns)


def search(spark: SparkSession, table: str, query: str) -> DataFrame:
    """(frn, name) of the files that now have every gram of query, as base index and later postings tell."""
    at = Versioned(spark, table)
    version, merged, _ = at.newest()
    grams = query_grams(query)
    posts = at.base("index", POSTING, version).union(at.batches("postings", POSTING, merged)).where(F.col("gram").isin(grams))
    hits = posts.groupBy("frn", "seq").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(grams)).select("frn", "seq")
    base = at.base("base", STATE, version)
    names = base.union(told(at.batches("delta", CHANGE, merged)).select("frn", "name", "seq"))
    return live(hits, at.batches("marks", MARK, merged), base).join(names, ["frn", "seq"]).select("frn", "name")


def search_exact(spark: SparkSession, table: str, query: str) -> DataFrame:
    """(frn, name) of the files whose name now contains query; short queries are held against the state itself."""
    found = search(spark, table, query) if len(query) >= 3 else current(spark, table)[0].select("frn", "name")
    return found.where(contains(F.col("name"), query))


def compact(spark: SparkSession, table: str, now: datetime | None = None) -> int:
    """Merges state and index as the bases of a new version; returns the version.  Batches that come meanwhile are left for the next time."""
    at = Versioned(spark, table)
    version, merged, _ = at.newest()
    last = max(merged, at.last_batch("postings", POSTING))  # a batch writes its postings last
    base, new = at.base("base", STATE, version), version + 1
    at.write_base("base", new, current(spark, table, last)[0])
    state = at.base("base", STATE, new)
    marks = at.batches("marks", MARK, merged, last).groupBy("frn").agg(F.max("seq").alias("_last"))
    old = at.base("index", POSTING, version).join(marks, "frn", "left").where("_last IS NULL OR seq >= _last").select("gram", "frn", "seq")
    fresh = at.batches("postings", POSTING, merged, last).join(state.select("frn", "seq"), ["frn", "seq"], "left_semi")
    fresh = fresh.join(base.select("frn", "seq"), ["frn", "seq"], "left_anti").select("gram", "frn", "seq")  # a change that the base has already
    at.write_base("index", new, old.union(fresh.distinct()).repartitionByRange("gram", "frn").sortWithinPartitions("gram", "frn"))
    at.publish(new, last, now or utc_now())
    return new


def due(spark: SparkSession, table: str, threshold_mb: int = MERGE_MB, every_seconds: float = MERGE_SECONDS, now: datetime | None = None) -> bool:
    """Whether a merge is due: the last one is long enough ago, and the changes since then are large enough."""
    return Versioned(spark, table).due("delta", threshold_mb, every_seconds, now or utc_now())


def compact_if_due(spark: SparkSession, table: str, threshold_mb: int = MERGE_MB, every_seconds: float = MERGE_SECONDS, now: datetime | None = None, keep: int = 2) -> int | None:
    """compact() where it is due, then the removal of what the newest keep versions don't need: the new version, else null."""
    if not due(spark, table, threshold_mb, every_seconds, now):
        return None
    new = compact(spark, table, now)
    Versioned(spark, table).clean(KINDS, keep)
    return new
