"""The bounded cache of parents: paths of changes in a stream against a plain walk, and the size of the state."""

from __future__ import annotations

import random

import pytest

from trovex.streaming import parents
from trovex.streaming.cdc import CREATE, DELETE, RENAME


@pytest.fixture
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", parents.ROCKSDB)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def plain(rows):
    """The path of each change as the tree then is; what the changes never told of is left to the table of paths."""
    nodes, out = {}, {}
    for volume, seq, frn, parent, name, reason in sorted(rows, key=lambda r: r[1]):
        nodes[volume, frn] = (parent, name)
        parts, at = [], frn
        while at and (volume, at) in nodes and len(parts) < parents.DEEPEST:
            parts.append(nodes[volume, at][1])
            at = nodes[volume, at][0]
        out[volume, seq] = "\\".join(([f"old{at}"] if at else []) + parts[::-1])
        if reason & DELETE:
            del nodes[volume, frn]
    return out


def test_paths_in_a_stream_with_few_entries(spark, rocksdb, tmp_path):
    """Parents that were evicted or never told of come from the table of paths; the state stays within its bound."""
    rng = random.Random(8)
    rows, stay = [], {"C": {}, "D": {}}
    for seq in range(400):
        volume = rng.choice("CD")
        # folders 1-9 are in the table of paths alone; others are told once and keep their names, so the table knows them, too
        known = [*range(1, 10), *stay[volume]]
        frn = 100 + seq
        parent = rng.choice(known[-30:])
        rows.append((volume, seq, frn, parent, f"n{seq}", rng.choice([CREATE, RENAME])))
        stay[volume][frn] = (parent, f"n{seq}")
        if seq % 10 == 9:
            gone = 10_000 + seq
            rows.append((volume, seq + 1000, gone, parent, "gone", DELETE))
    rows.sort(key=lambda r: r[1])
    source, mark, out = (str(tmp_path / x) for x in ("in", "mark", "out"))
    paths = {(v, i): f"old{i}" for v in "CD" for i in range(1, 10)}
    for v in "CD":
        for frn, (parent, name) in stay[v].items():
            paths[v, frn] = f"{paths[v, parent]}\\{name}"
    table = spark.createDataFrame([(v, f, p) for (v, f), p in paths.items()], "volume string, frn long, path string")

    def complete(batch, number):
        parents.completed(batch, table).write.mode("overwrite").parquet(f"{out}/batch={number}")

    for i in range(0, len(rows), 90):
        spark.createDataFrame(rows[i : i + 90], parents.CHANGE).coalesce(1).write.mode("append").parquet(source)
        stream = parents.resolved(spark.readStream.schema(parents.CHANGE).parquet(source), most=40)
        stream.writeStream.foreachBatch(complete).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    got = {(r.volume, r.seq): r for r in spark.read.parquet(out).collect()}
    assert all(r.complete for r in got.values())
    assert {k: r.path for k, r in got.items()} == plain(rows)
    state = spark.read.format("statestore").option("path", mark).option("stateVarName", "parents").load()
    sizes = {r.v: r.n for r in state.selectExpr("key.volume AS v").groupBy("v").count().withColumnRenamed("count", "n").collect()}
    assert set(sizes) == {"C", "D"} and max(sizes.values()) <= 40


def test_renames_and_unknown_parents(spark, rocksdb, tmp_path):
    rows = [
        ("C", 1, 5, 0, "docs", CREATE), ("C", 2, 6, 5, "a.txt", CREATE), ("C", 3, 5, 0, "papers", RENAME), ("C", 4, 7, 5, "b.txt", CREATE),
        ("C", 5, 5, 0, "papers", DELETE), ("C", 6, 8, 5, "c.txt", CREATE), ("C", 7, 9, 77, "d.txt", CREATE),
    ]
    source, mark, out = (str(tmp_path / x) for x in ("in", "mark", "out"))
    spark.createDataFrame(rows, parents.CHANGE).coalesce(1).write.parquet(source)
    stream = parents.resolved(spark.readStream.schema(parents.CHANGE).parquet(source), ttl_seconds=3600)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        stream.writeStream.format("parquet").option("checkpointLocation", mark).trigger(availableNow=True).start(out).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    table = spark.createDataFrame([("C", 77, "x\\y"), ("D", 5, "wrong")], "volume string, frn long, path string")
    got = {r.seq: (r.path, r.complete) for r in parents.completed(spark.read.schema(parents.RESOLVED).parquet(out), table).collect()}
    assert got == {1: ("docs", True), 2: ("docs\\a.txt", True), 3: ("papers", True), 4: ("papers\\b.txt", True), 5: ("papers", True), 6: ("c.txt", False), 7: ("x\\y\\d.txt", True)}
