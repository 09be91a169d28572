"""Workflows, plugins, deadlines of sources, and the journal as a streaming source."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from trovex.operators import workflows
from trovex.operators.plugins import Plugins
from trovex.operators.ranking import Sources
from trovex.sources import journal
from trovex.streaming import cdc


def run(spark, steps, variables=None, most=20):
    """(variables, effects as (step, kind, detail), error) of one workflow."""
    start = F.create_map(*[F.lit(x) for pair in (variables or {"a": "1"}).items() for x in pair])
    r = workflows.executed(spark.range(1), steps, start, "r", most).first().r
    return r.variables, [(e.step, e.kind, e.detail) for e in r.effects], r.error


def put(name, value, **more):
    return {"id": f"set {name}", "action": {"type": "SetVariable", "name": name, "value": value}, **more}


def equals(name, value):
    return {"type": "VariableEquals", "name": name, "value": value}


BAD = {"id": "bad", "action": {"type": "PluginQuery", "plugin_id": "p", "query": "q"}}


def test_variables_and_conditions(spark):
    assert run(spark, [put("greeting", "Hello, World!")]) == ({"a": "1", "greeting": "Hello, World!"}, [], None)
    steps = [put("b", "${a}${none}x"), put("a", "2"), put("c", "${b}", condition=equals("a", "1")), put("d", "${a}", condition=equals("a", "2"))]
    assert run(spark, steps) == ({"a": "2", "b": "1${none}x", "d": "2"}, [], None)
    assert run(spark, []) == ({"a": "1"}, [], None)


def test_branches_and_effects(spark):
    steps = [{"id": "if", "action": {"type": "If", "condition": equals("a", "1"), "then_steps": [
        {"id": "run", "action": {"type": "ExecuteCommand", "command": "ls", "args": ["-l", "${a}"]}},
        {"id": "inner", "action": {"type": "If", "condition": equals("a", "2"), "then_steps": [put("b", "no")]}},
        {"id": "get", "action": {"type": "HttpRequest", "method": "GET", "url": "http://x/${a}"}}], "else_steps": [put("b", "else")]}},
        {"id": "wait", "action": {"type": "Delay", "milliseconds": 5}}]
    effects = [("run", "ExecuteCommand", {"command": "ls", "args": "-l 1"}), ("get", "HttpRequest", {"method": "GET", "url": "http://x/1"}), ("wait", "Delay", {"milliseconds": "5"})]
    assert run(spark, steps) == ({"a": "1"}, effects, None)
    assert run(spark, steps, {"a": "3"}) == ({"a": "3", "b": "else"}, effects[2:], None)
    rows = workflows.executed(spark.range(2), steps, F.create_map(F.lit("a"), (F.col("id") + 1).cast("string")), "r")
    found = [(r.id, r.number, r.step) for r in workflows.effects(rows, "r", "id").collect()]
    assert sorted(found) == [(0, 0, "run"), (0, 1, "get"), (0, 2, "wait"), (1, 0, "wait")]


def test_loops(spark):
    add = put("n", "${n}i")
    loop = lambda **more: [{"id": "loop", "action": {"type": "Loop", "steps": [add], **more}}]
    short = {"type": "Not", "condition": {"type": "VariableContains", "name": "n", "substring": "iii"}}
    assert run(spark, loop(count=4), {"n": ""})[0] == {"n": "iiii"}
    assert run(spark, loop(count=0), {"n": ""})[0] == {"n": ""}
    assert run(spark, loop(count=9, condition=short), {"n": ""})[0] == {"n": "iii"}
    assert run(spark, loop(condition=short), {"n": ""}) == ({"n": "iii"}, [], None)
    assert run(spark, loop(condition=equals("x", "y")), {"n": ""})[0] == {"n": ""}
    assert run(spark, loop(condition=equals("a", "1")), {"n": "", "a": "1"}, most=7) == ({"n": "i" * 7, "a": "1"}, [], "loop: the loop does not end")
    assert run(spark, loop(), {"n": ""})[0] == {"n": ""}


@pytest.mark.parametrize(
    ("on_error", "want"),
    [
        (None, ({"a": "1", "b": "x"}, [], "bad: unsupported action PluginQuery")),
        ({"type": "Stop"}, ({"a": "1", "b": "x"}, [], "bad: unsupported action PluginQuery")),
        ({"type": "Continue"}, ({"a": "1", "b": "x", "c": "z"}, [], None)),
        ({"type": "Retry", "max_attempts": 2, "delay_ms": 1}, ({"a": "1", "b": "x", "c": "z"}, [], None)),
        ({"type": "Fallback", "steps": [put("b", "f")]}, ({"a": "1", "b": "f", "c": "z"}, [], None)),
        ({"type": "Fallback", "steps": [put("b", "f"), BAD, put("b", "g")]}, ({"a": "1", "b": "f"}, [], "bad: unsupported action PluginQuery")),
    ],
)
def test_errors(spark, on_error, want):
    step = {"id": "try", "action": {"type": "If", "condition": equals("a", "1"), "then_steps": [put("b", "x"), BAD, put("b", "y")]}}
    assert run(spark, [step | ({"on_error": on_error} if on_error else {}), put("c", "z")]) == want


def test_long_workflows_stay_small(spark):
    """Sixty steps one after another: the plan grows with the steps, not as a power of them."""
    variables, _, error = run(spark, [put(f"v{i}", f"${{v{i - 1}}}x") for i in range(1, 61)], {"v0": ""})
    assert variables["v60"] == "x" * 60 and error is None


def test_plugins_answer_all_queries_at_once(spark):
    class Twice:
        def eval(self, query: str):
            yield query, query * 2, 1.0

    found = Plugins(spark)
    with pytest.raises(ValueError, match="no plugin"):
        found.answers(spark.createDataFrame([("a",)], "query string"))
    found.register_class("twice", Twice)
    found.register_sql("upper", "SELECT query, upper(query), 2D WHERE query <> 'b'")
    queries = spark.createDataFrame([("a",), ("b",), ("a",)], "query string")
    assert {(r.query, r.plugin_id, r.title) for r in found.answers(queries).collect()} == {("a", "twice", "aa"), ("b", "twice", "bb"), ("a", "upper", "A")}
    assert {r.plugin_id for r in found.answers(queries, disabled=("twice",)).collect()} == {"upper"}


def test_a_source_that_hangs_is_cancelled(spark):
    """The others answer; the late one is named, and its job ends."""
    row = spark.createDataFrame([("1", "t", "s", 1, "p")], "id string, title string, subtitle string, score int, plugin_id string")

    @F.udf("string")
    def slow(x):
        time.sleep(300)
        return x

    sources = Sources()
    sources.register("good", lambda q: row)
    sources.register("hangs", lambda q: row.withColumn("title", slow("title")))
    sources.register("plans for ever", lambda q: time.sleep(60) or row)
    sources.register("bad", lambda q: row.select("nothing"))
    failed = {}
    row.withColumn("title", F.udf(str)("title")).collect()  # starts what all sources need
    began = time.monotonic()
    assert [r.id for r in sources.gathered(spark, "x", 20, failed=failed).collect()] == ["1"]
    assert time.monotonic() - began < 50
    assert set(failed) == {"hangs", "plans for ever", "bad"}
    assert isinstance(failed["hangs"], TimeoutError) and "nothing" in str(failed["bad"])
    for _ in range(20):
        if running := spark.sparkContext.statusTracker().getActiveJobsIds():
            time.sleep(0.5)
    assert not running
    with pytest.raises(ValueError, match="no source"):
        sources.gathered(spark, "x", 1, disabled=("good", "bad", "plans for ever"))


def test_journal_source(spark, tmp_path):
    """A restart in the midst of a segment loses and repeats nothing."""
    spark.dataSource.register(journal.JournalSource)
    folder, out, mark = (str(tmp_path / x) for x in ("journal", "out", "mark"))
    rows = [(i, i % 7, [0x100, 0x1000, 0x200][i % 3], f"name {i}\n") for i in range(50)]

    def follow():
        stream = spark.readStream.format("journal").option("path", folder).load()
        stream.writeStream.format("parquet").option("checkpointLocation", mark).trigger(availableNow=True).start(out).awaitTermination()
        return sorted(map(tuple, spark.read.parquet(out).collect()))

    journal.write_segment(folder, rows[:20])
    assert follow() == rows[:20]
    assert follow() == rows[:20]
    journal.write_segment(folder, rows[20:21])
    journal.write_segment(folder, rows[21:])
    (tmp_path / "journal" / "_half-written").write_text("[1, ")
    assert follow() == rows
    assert sorted(map(tuple, spark.read.format("journal").option("path", folder).load().collect())) == rows
    assert [p.segment for p in journal.parts(folder, 5, 5)] == [journal.segments(folder)[0][2]]
    assert [r[0] for p in journal.parts(folder, 18, 22) for r in journal.changes(p)] == [19, 20, 21, 22]


def test_journal_source_feeds_the_index(spark, tmp_path):
    spark.dataSource.register(journal.JournalSource)
    folder, table, mark = (str(tmp_path / x) for x in ("journal", "table", "mark"))
    rows = [(1, 1, 0x100, "report.txt"), (2, 2, 0x100, "other.txt"), (3, 1, 0x1000, "renamed.txt"), (4, 2, 0x1000, "report two")]
    for part in (rows[:2], rows[2:]):
        journal.write_segment(folder, part)
        stream = spark.readStream.format("journal").option("path", folder).load().withColumn("ts", F.lit(None).cast("timestamp_ntz"))
        cdc.follow(stream, table, mark).awaitTermination()
    assert [tuple(r) for r in cdc.search(spark, table, "report").collect()] == [(2, "report two")]
