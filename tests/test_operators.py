"""Order-dependent operators, trees, the index on disk, streams: against plain Python."""

from __future__ import annotations

import json
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trovex.catalogue import QUERIES
from trovex.operators import hierarchy, index, logs, ranking, rules, usage
from trovex.sources import files
from trovex.sources.entities import audit, changes
from trovex.streaming import cdc, dedup


def walked(rows, n=10):
    """Sequence numbers that a walk over (group, seq, value) accepts."""
    windows, out = {}, set()
    for g, seq, v in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        w = windows.setdefault(g, [])
        if v not in w:
            w.append(v)
            del w[:-n]
            out.add((g, seq))
    return out


@pytest.fixture(scope="module")
def log():
    rng = random.Random(3)
    rows = [(rng.choice([1, 2, None]), i, rng.choice([*"abcdefghijklmnop", None])) for i in range(600)]
    rng.shuffle(rows)
    return rows


def test_last_n_dedup(spark, log):
    df = spark.createDataFrame(log, "g int, seq int, v string")
    got = {(r.g, r.seq) for r in logs.last_n_dedup(df, "g", ["seq"], "v").collect()}
    assert got == walked(log)
    one = {(r.g, r.seq) for r in logs.last_n_dedup(df, "g", ["seq"], "v", n=1).collect()}
    assert one == walked(log, 1)


def test_bounded_history(spark, log):
    want = {}
    for g, _, v in sorted(log, key=lambda r: (str(r[0]), r[1])):
        items = want.setdefault(g, [])
        for x in items:
            if x[0] == v:
                x[1] += 1
                break
        else:
            items.insert(0, [v, 1])
            del items[8:]
    df = spark.createDataFrame(log, "g int, seq int, v string")
    rows = logs.bounded_history(df, "g", ["seq"], "v", most=8).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r.place):
        got.setdefault(r.g, []).append([r.v, r.frequency])
    assert got == want
    assert logs.bounded_history(df.limit(0), "g", ["seq"], "v").count() == 0


def test_paths_stop_at_cycles(spark):
    edges = [(1, 0, "a"), (2, 1, "b"), (3, 2, "c"), (4, 5, "x"), (5, 4, "y"), (6, 99, "lost")]
    got = {r.frn: (r.path, r.depth) for r in hierarchy.paths(spark.createDataFrame(edges, "frn long, parent_frn long, name string")).collect()}
    assert got == {1: ("a", 1), 2: ("a\\b", 2), 3: ("a\\b\\c", 3)}


def test_flattened_tree(spark):
    tree = {"type": "folder", "name": "bar", "children": [{"type": "url", "name": "one", "url": "u1"}, {"type": "folder", "name": "in", "children": [{"type": "url", "name": "two", "url": "u2"}]}]}
    df = spark.createDataFrame([(1, json.dumps(tree)), (2, "{"), (3, None)], "id int, tree string")
    got = {(r.id, r.title, r.url, r.folder) for r in hierarchy.flattened(df, "id", "tree").collect()}
    assert got == {(1, "one", "u1", "bar"), (1, "two", "u2", "bar/in")}


def test_index_on_disk(spark, tmp_path):
    files = spark.createDataFrame([(1, "alpha.txt"), (2, "beta.txt"), (3, "alphabet")], "file_id long, name string")
    index.write_index(index.postings(files), str(tmp_path / "index"))
    posts = index.read_index(spark, str(tmp_path / "index"))
    assert {r.file_id for r in index.search_and(posts, "ALPHA").collect()} == {1, 3}
    removed = spark.createDataFrame([(1,)], "file_id long")
    live = index.with_delta(posts, index.postings(files.limit(0)), removed)
    assert {r.file_id for r in index.search_and(live, "alpha").collect()} == {3}
    plan = posts.where(F.col("gram").isin(["alp"]))._jdf.queryExecution().toString()
    assert "PushedFilters: [In(gram" in plan or "PushedFilters: [IsNotNull(gram), EqualTo(gram" in plan


def test_audit_export(spark, sf_dir):
    text = QUERIES["audit_export_json"](spark, sf_dir).first()[0]
    newest = [r.event_id for r in audit(spark, sf_dir).orderBy(F.desc("ts"), F.desc("event_id")).limit(1000).collect()]
    assert sorted(x["event_id"] for x in json.loads(text)) == sorted(newest)


def test_sources_that_fail_are_left_out(spark):
    good = spark.createDataFrame([("1", "t", "s", 1, "p")], "id string, title string, subtitle string, score int, plugin_id string")
    sources = ranking.Sources()
    sources.register("good", lambda q: good)
    sources.register("bad", lambda q: good.select("nothing"))
    failed = {}
    assert sources.search("x", failed=failed).count() == 1
    assert list(failed) == ["bad"]
    with pytest.raises(Exception, match="nothing"):
        sources.search("x")
    with pytest.raises(ValueError, match="no source"):
        sources.search("x", disabled=("good",), failed={})


def test_lookups_in_blocks(spark):
    counts = spark.createDataFrame([("a1", 4), ("b2x", 7), ("2", 3)], "query string, count long")
    wanted = spark.range(5).select(F.col("id").cast("string").alias("text"))
    want = {"0": 0, "1": 4, "2": 3, "3": 0, "4": 0}
    assert {r.text: r.usage for r in usage.exact_or_fuzzy(wanted, counts, bound=1).collect()} == want
    assert {r.text: r.usage for r in usage.exact_or_fuzzy(wanted, counts).collect()} == want


def test_fuzzy_texts_are_values(spark):
    counts = spark.createDataFrame([("a'b", 4), ("c", 7), ("x\\y", 2)], "query string, count long")
    assert usage.fuzzy_max(counts, "a'b").first().usage == 4
    assert usage.fuzzy_max(counts, "' OR true OR '").first().usage == 0
    assert usage.fuzzy_max(counts, "\\' OR true OR '").first().usage == 0
    assert usage.fuzzy_max(counts, "x\\").first().usage == 2
    assert usage.fuzzy_max(counts, "c\\").first().usage == 7


def test_deep_trees_are_opened_whole(spark):
    tree = {"type": "url", "name": "leaf", "url": "u"}
    for i in range(12, 0, -1):
        tree = {"type": "folder", "name": f"f{i}", "children": [tree]}
    rows = hierarchy.flattened(spark.createDataFrame([(1, json.dumps(tree))], "id int, tree string"), "id", "tree").collect()
    assert [(r.title, r.folder) for r in rows] == [("leaf", "/".join(f"f{i}" for i in range(1, 13)))]
    assert hierarchy.flattened(spark.createDataFrame([], "id int, tree string"), "id", "tree").count() == 0


def test_a_read_that_fails_is_no_empty_table(spark, tmp_path):
    assert cdc.versions(spark, str(tmp_path)).count() == 0
    (tmp_path / "versions").mkdir()
    (tmp_path / "versions" / "part-0.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception):  # noqa: B017  whatever the reader raises
        cdc.versions(spark, str(tmp_path)).collect()


def test_time_range(spark):
    rows = spark.createDataFrame([("23:00",), ("03:00",), ("12:00",), (None,)], "now string").select(F.create_map(F.lit("now"), "now").alias("v"))
    holds = lambda a, b: [r[0] for r in rows.select(rules.condition({"type": "TimeRange", "start": a, "end": b}, F.col("v"))).collect()]
    assert holds("22:00", "04:00") == [True, True, False, False]
    assert holds("09:00", "17:00") == [False, False, True, False]


def test_stream_of_changes(spark, sf_dir, tmp_path):
    """The stream's state, across a restart and a compaction, is that of all changes at once."""
    source, table, mark = (str(tmp_path / x) for x in ("in", "table", "mark"))
    all_changes = changes(spark, sf_dir)
    schema = all_changes.schema
    parts = [all_changes.where(f"floor(seq / 400) = {i}") for i in range(3)]
    for i, part in enumerate(parts):
        part.write.mode("append").parquet(source)
        cdc.follow(spark.readStream.schema(schema).parquet(source), table, mark).awaitTermination()
        if i == 1:
            assert cdc.compact(spark, table) == 1
    state, version, _ = cdc.current(spark, table)
    assert version == 1
    assert {tuple(r) for r in state.collect()} == {tuple(r) for r in cdc.latest_state(all_changes).collect()}
    cdc.compact(spark, table)
    again, version, _ = cdc.current(spark, table)
    assert version == 2
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in state.collect()}


def test_stream_dedup(spark, log, tmp_path):
    source = str(tmp_path / "in")
    rows = sorted((r for r in log if None not in r), key=lambda r: r[1])
    schema = "g int, seq int, v string"
    spark.createDataFrame(rows[:200], schema).coalesce(1).write.parquet(source)
    stream = dedup.last_n_dedup(spark.readStream.schema(schema).parquet(source), "g", ["seq"], "v")
    out = {"path": str(tmp_path / "out"), "checkpointLocation": str(tmp_path / "mark")}
    stream.writeStream.format("parquet").options(**out).trigger(availableNow=True).start().awaitTermination()
    spark.createDataFrame(rows[200:], schema).coalesce(1).write.mode("append").parquet(source)
    stream.writeStream.format("parquet").options(**out).trigger(availableNow=True).start().awaitTermination()
    assert {(r.g, r.seq) for r in spark.read.parquet(out["path"]).collect()} == walked(rows)


def test_hot_groups_are_cut(spark):
    """A group that holds most rows is many windows; results are those of a plain walk."""
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 2, None]), t, i, rng.choice(["a", "b", None])) for i, t in enumerate(rng.choice([None, *range(40)]) for _ in range(500))]
    df = spark.createDataFrame(rows, "g int, ts int, event_id int, v string")
    before, want = {}, set()
    key = lambda r: (r[1] is not None, r[1] or 0, r[2])
    for g, _, i, v in sorted(rows, key=key):
        if before.get(g, ()) != (v,):
            want.add(i)
        before[g] = (v,)
    assert {r.event_id for r in logs.consecutive_dropped(df, "g", ["ts", "event_id"], "v", F.floor(F.col("ts") / 7)).collect()} == want

    timed = [(g, t, i) for g, t, i, _ in rows if t is not None]
    log = spark.createDataFrame(timed, "g int, s int, event_id int").select("g", F.timestamp_seconds("s").alias("ts"), "event_id")
    groups, last = {}, set()
    for g, t, i in sorted(timed, key=lambda r: r[1:]):
        groups.setdefault(g, []).append((t, i))
    for walk in groups.values():
        last |= {a[1] for a, b in zip(walk, [*walk[1:], (10**9, 0)], strict=True) if b[0] - a[0] > 1.5}
    got = {r.event_id for r in logs.settled(log, "g", ["ts", "event_id"], 1.5, F.floor(F.unix_seconds("ts") / 7)).collect()}
    assert got == last


def test_files_as_tables(spark, tmp_path):
    (tmp_path / "history.json").write_text(json.dumps([{"query": "a", "frequency": 2}, {"query": "b\n", "frequency": None}]))
    rows = files.json_array(spark, str(tmp_path / "history.json"), "query string, frequency long").collect()
    assert [tuple(r) for r in rows] == [("a", 2), ("b\n", None)]
    assert files.json_array(spark, str(tmp_path / "none.json"), "query string").count() == 0
    flows = tmp_path / "flows"
    (flows / "deeper").mkdir(parents=True)
    (flows / "one.json").write_text(json.dumps({"id": "1", "name": "first"}, indent=1))
    (flows / "bad.json").write_text("{no")
    (flows / "note.txt").write_text('{"id": "2"}')
    assert [tuple(r) for r in files.json_folder(spark, str(flows), "id string, name string").collect()] == [("1", "first")]
    for name in ("a.lnk", "B.LNK", "c.exe", "deeper/d.e.lnk", ".lnk", "lnk"):
        (flows / name).write_bytes(b"xyz")
    assert {(r.name, r.size) for r in files.listing(spark, str(flows), ".lnk").collect()} == {("a", 3), ("B", 3), ("d.e", 3)}
    assert files.listing(spark, str(tmp_path / "none"), "lnk").count() == 0


def test_snapshots(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(len(built))

    at = datetime(2024, 1, 1)
    take = lambda version, hours: files.snapshot(spark, str(tmp_path), version, at + timedelta(hours=hours), build).count()
    assert [take(1, 0), take(1, 24), take(1, 25), take(1, 26), take(2, 26), take(1, 26)] == [1, 1, 2, 2, 3, 2]


def test_compaction_is_due_by_size(spark, tmp_path):
    table = str(tmp_path / "t")
    spark.createDataFrame([(1, 1, 0x100, "a", None)], cdc.CHANGE).write.parquet(f"{table}/delta/batch=0")
    assert cdc.compact_if_due(spark, table) is None
    assert cdc.compact_if_due(spark, table, threshold_mb=0) == 1
    assert not cdc.due(spark, table, threshold_mb=1)


def test_idle_state_is_dropped(spark, tmp_path):
    source, out = str(tmp_path / "in"), {"path": str(tmp_path / "out"), "checkpointLocation": str(tmp_path / "mark")}
    schema = "g int, seq int, v string"

    def send(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = dedup.clipboard_texts(spark.readStream.schema(schema).parquet(source), "v")
        stream = dedup.last_n_dedup(stream, "g", ["seq"], "v", idle_seconds=1)
        stream.writeStream.format("parquet").options(**out).trigger(availableNow=True).start().awaitTermination()
        time.sleep(2)

    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        send([(1, 1, "a"), (1, 2, "a"), (1, 3, ""), (1, 4, None), (1, 5, "x" * 100_000)])
        send([(2, 6, "b")])  # the state of group 1 goes
        send([(1, 7, "a")])
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert sorted((r.g, r.seq) for r in spark.read.parquet(out["path"]).collect()) == [(1, 1), (1, 7), (2, 6)]


def test_delete_by_key(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (3, "b")], "id int, v string")
    assert {r.id for r in logs.without(rows, spark.createDataFrame([(3,), (None,), (9,)], "id int")).collect()} == {1, 2}
    assert {r.id for r in logs.without(rows, spark.createDataFrame([("a",), (None,)], "v string")).collect()} == {2, 3}


def test_a_backslash_is_itself(spark):
    rows = spark.createDataFrame([(1, "a\\b"), (2, "ab"), (3, None), (4, "A\\B c"), (5, "a_b")], "id int, v string")
    found = lambda text: {r.id for r in logs.like_any(rows, text, "v").collect()}
    assert [found("a\\b"), found("\\"), found("a_b"), found("%"), found("\\\\")] == [{1, 4}, {1, 4}, {1, 4, 5}, {1, 2, 4, 5}, set()]


def test_kinds_and_signs(spark):
    rows = spark.createDataFrame([("a.JSON", False), ("b.jsx", False), ("c.webp", False), ("d.bat", False), ("e", False), ("f.zip", False), ("g.log", True), ("x.dockerfile", False)], "p string, folder boolean")
    assert [r[0] for r in rows.select(rules.file_type(F.col("p"))).collect()] == ["json", "code", "image", "binary", "binary", "binary", "text", "text"]
    assert [r[0] for r in rows.select(rules.icon(F.col("p"), F.col("folder"))).collect()] == ["📄", "📄", "📄", "📄", "📄", "📦", "📁", "📄"]


def test_drives_come_from_the_table(spark, tmp_path):
    """More matches than a drive gives, on drives of any name."""
    rows = spark.range(300).select(F.col("id").alias("p_partkey"), F.lit("bee").alias("p_name"), F.lit("b").alias("p_brand"), F.lit("t").alias("p_type"), F.lit(1).alias("p_size"))
    rows.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    got = [tuple(r) for r in QUERIES["per_drive_cap"](spark, str(tmp_path)).select("drive", "file_id").collect()]
    by = {d: [i for i in range(300) if "CDE"[i % 3] == d][:20] for d in "CDE"}
    assert sorted(got) == sorted([(d, i) for d in "CDE" for i in by[d]][:50])


def test_a_delta_takes_the_place_of_base_postings(spark):
    base = spark.createDataFrame([("abc", 1), ("bcd", 1), ("abc", 2), ("abc", 3)], "gram string, file_id long")
    added = spark.createDataFrame([("xyz", 1), ("abc", 4), ("xyz", 5)], "gram string, file_id long")
    removed = spark.createDataFrame([(2,), (5,)], "file_id long")
    assert sorted(map(tuple, index.with_delta(base, added, removed).collect())) == [("abc", 3), ("abc", 4), ("xyz", 1)]


@pytest.mark.parametrize("query", ["Abc", "ABCD", "ab", "", "öl", "日本語"])
def test_a_scan_finds_what_the_index_finds(spark, query):
    names = ["abc", "xabcd", "bcdabc", "ab", "AB", "a", "öl", "日本語", "日本", ""]
    df = spark.createDataFrame(list(enumerate(names)), "file_id long, name string")
    want = {r.file_id for r in index.search_and(index.postings(df), query).collect()}
    assert {r.file_id for r in index.scan_and(df, query).collect()} == want
