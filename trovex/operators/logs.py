"""Histories and logs: filters, paging, order-dependent dedup, retention, conditional counts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def like_any(rows: DataFrame, text: str, *columns: str) -> DataFrame:
    """Rows with a column like %text%, whatever the case; a null column is not.  % and _ in text are wild, a backslash is itself."""
    test, pattern = F.lit(False), "%" + text.replace("\\", "\\\\") + "%"
    for c in columns:
        test = test | F.coalesce(F.col(c).ilike(pattern), F.lit(False))
    return rows.where(test)


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def _beside(rows: DataFrame, group: str, order: list[str], kept: str, part: Column, back: bool) -> DataFrame:
    """rows with _near: struct(kept) of the row before (back) or after in their group, null without one.

    part rises with the order and cuts a group, so that one large group is many windows.  Each part also gets the row
    next to it from the part before or after, of which the outer window sees one row a part.
    """
    cut = rows.withColumn("_part", part)
    ends = cut.groupBy(group, "_part").agg((F.max_by if back else F.min_by)(F.struct(kept), F.struct(*order)).alias("_kept"))
    step = F.lag if back else F.lead
    ends = ends.withColumn("_kept", step("_kept").over(W.partitionBy(group).orderBy("_part"))).where("_kept is not null")
    both = cut.withColumns({"_kept": F.struct(kept), "_end": F.lit(False)}).unionByName(ends.withColumn("_end", F.lit(True)), allowMissingColumns=True)
    near = step("_kept").over(W.partitionBy(group, "_part").orderBy(F.desc("_end") if back else F.asc("_end"), *order))
    return both.withColumn("_near", near).where(~F.col("_end")).drop("_part", "_kept", "_end")


def consecutive_dropped(rows: DataFrame, group: str, order: list[str], value: str, part: Column) -> DataFrame:
    """Without the rows whose value is that of the row before in their group; part as in _beside, the hour for example."""
    near = _beside(rows, group, order, value, part, back=True)
    return near.where(F.col("_near").isNull() | ~F.col(f"_near.{value}").eqNullSafe(F.col(value))).drop("_near")


def newest(rows: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The first n rows of an order: what a ring buffer or a retention by count keeps."""
    return rows.orderBy(*order).limit(n)


def streamed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with each group's rows one after another, in order, in one partition."""
    return rows.repartition(group).sortWithinPartitions(group, *order)


def last_n_dedup(rows: DataFrame, group: str, order: list[str], value: str, n: int = 10) -> DataFrame:
    """Without the rows whose value is among the last n accepted ones of their group.

    Rejected rows don't enter the window, so each verdict hangs on those before.  A task walks its groups in order and
    holds n values of one group.
    """
    at, key = rows.columns.index(value), rows.columns.index(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: object = object()
        window: list[object] = []
        for batch in batches:
            keep = []
            for g, v in zip(batch.column(key).to_pylist(), batch.column(at).to_pylist(), strict=True):
                if g != current:
                    current, window = g, []
                keep.append(v not in window)
                if keep[-1]:
                    window = [*window[1 - n :], v] if n > 1 else [v]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return streamed(rows, group, order).mapInArrow(run, rows.schema)


def bounded_history(log: DataFrame, group: str, order: list[str], value: str, most: int = 20) -> DataFrame:
    """(group, value, frequency, place) of the history that each group ends with.

    A new value goes to the front and pushes out the last beyond most; one that is there is counted where it stands.
    """
    kind, kept = log.schema[group].dataType.simpleString(), log.schema[value].dataType.simpleString()
    at, key = log.columns.index(value), log.columns.index(group)
    schema = f"{group} {kind}, {value} {kept}, frequency long, place int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, started = None, False
        items: list[list] = []

        def close(like: pa.RecordBatch) -> pa.RecordBatch:
            columns = [pa.array([current] * len(items), like.schema.field(key).type), pa.array([x[0] for x in items], like.schema.field(at).type)]
            return pa.record_batch([*columns, pa.array([x[1] for x in items], pa.int64()), pa.array(range(len(items)), pa.int32())], [group, value, "frequency", "place"])

        batch = None
        for batch in batches:
            for g, v in zip(batch.column(key).to_pylist(), batch.column(at).to_pylist(), strict=True):
                if not started or g != current:
                    if items:
                        yield close(batch)
                    current, started, items = g, True, []
                for x in items:
                    if x[0] == v:
                        x[1] += 1
                        break
                else:
                    items.insert(0, [v, 1])
                    del items[most:]
        if items:
            yield close(batch)

    return streamed(log, group, order).mapInArrow(run, schema)


def toggled(flag: Column) -> Column:
    return 1 - flag


def tags_of(csv: Column) -> Column:
    """The tags of a comma-separated list, trimmed, without empty ones; null has none."""
    parts = F.transform(F.split(F.coalesce(csv, F.lit("")), ","), lambda t: F.trim(t))
    return F.filter(parts, lambda t: t != "")


def with_tag(csv: Column, tag: str) -> Column:
    """The list with one tag more, once."""
    return F.array_join(F.array_union(tags_of(csv), F.array(F.lit(tag))), ",")


def clipboard_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("favorite") == 1).alias("favorites"),
        F.count_if(F.col("content_type") == "user").alias("texts"),
        F.count_if(F.col("content_type") == "assistant").alias("answers"),
    )


def audit_counts(log: DataFrame) -> DataFrame:
    """One row; program executions and changes of settings are not counted but in the total."""
    kind, denied = F.col("kind"), ~F.col("allowed")
    return log.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(kind == "PermissionCheck").alias("permission_checks"),
        F.count_if((kind == "PermissionCheck") & denied).alias("permission_denied"),
        F.count_if(kind == "FileAccess").alias("file_accesses"),
        F.count_if((kind == "FileAccess") & denied).alias("file_denied"),
        F.count_if(kind == "NetworkAccess").alias("network_accesses"),
        F.count_if(kind == "Violation").alias("violations"),
    )


def exported_json(rows: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """One row: the newest n rows as a JSON array, oldest first."""
    kept = rows.orderBy(*order).limit(n)
    return kept.agg(F.to_json(F.sort_array(F.collect_list(F.struct(*rows.columns)))).alias("json"))  # n rows


def sampled_hash(width: Column, height: Column, data: Column) -> Column:
    """A hash of the sizes and the first thousand characters."""
    return F.md5(F.concat_ws("|", width.cast("string"), height.cast("string"), F.substring(data, 1, 1000)))


def settled(log: DataFrame, group: str, order: list[str], gap_seconds: float, part: Column) -> DataFrame:
    """The rows after which nothing follows within a gap: what a debounced input sends.  order begins with the time."""
    ts = order[0]
    near = _beside(log, group, order, ts, part, back=False)
    gone = F.unix_micros(F.col(f"_near.{ts}").cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))
    return near.where(gone.isNull() | (gone > gap_seconds * 1_000_000)).drop("_near")


def without(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows without those that the keys name, by the columns of keys: a delete by id or by key.  A null key names no row."""
    return rows.join(keys.distinct(), keys.columns, "left_anti")


def drive_status(sizes: DataFrame) -> DataFrame:
    """(drive, size_mb, estimated_files, drives, total_files) of sizes (drive, bytes): a file is taken to need 100 bytes."""
    each = sizes.groupBy("drive").agg(F.sum("bytes").alias("b")).select("drive", F.expr("b div 1048576").alias("size_mb"), F.expr("b div 100").alias("estimated_files"))
    total = each.agg(F.count(F.lit(1)).alias("drives"), F.coalesce(F.sum("estimated_files"), F.lit(0)).alias("total_files"))
    return each.crossJoin(F.broadcast(total))  # one row
