"""The index that follows a journal, versions and their clean-up, streaming counters, bitmap postings, lookups by grams."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from trovex.operators import bitmaps, containment, index, usage
from trovex.sources.entities import changes, clicks
from trovex.streaming import cdc
from trovex.streaming.counters import Counters
from trovex.streaming.versioned import Versioned

NAMES = ["Report.txt", "report_old.txt", "ab", "a", "öl", "日本語.md", "summary report", "rep", ""]


def journal(seed, n=120, files=15):
    """(seq, frn, reason, name, ts): creates, renames, deletes, and changes that say nothing of a name."""
    rng = random.Random(seed)
    return [(i, rng.randrange(files), rng.choice([0x100, 0x100, 0x200, 0x1000, 0x1000, 2]), rng.choice(NAMES) + str(rng.randrange(3)), None) for i in range(n)]


def state_of(rows):
    out = {}
    for _, frn, reason, name, _ in sorted(rows):
        if reason & 0x1300:
            out[frn] = name if not reason & 0x200 else None
    return {(f, n) for f, n in out.items() if n is not None}


def with_grams(state, query):
    grams = index.query_grams(query)
    return {(f, n) for f, n in state if grams and set(grams) <= set(index.query_grams(n))}


def pairs(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


@pytest.mark.parametrize("merges", [(), (0,), (1, 3)])
def test_index_follows_the_journal(spark, tmp_path, merges):
    """After each batch a search finds what an index built anew from the latest state would; a batch that comes twice changes nothing."""
    rows, table = journal(4), str(tmp_path)
    for number in range(5):
        batch = spark.createDataFrame(rows[number * 24 : number * 24 + 24], cdc.CHANGE)
        for _ in range(1 + number % 2):
            cdc.append_changes(batch, table, number)
        if number in merges:
            cdc.compact(spark, table)
        state = state_of(rows[: number * 24 + 24])
        if number in (0, 2, 4):
            for query in ("REPORT", "rep", "a0", "日本語", "zzz"):
                assert pairs(cdc.search(spark, table, query)) == with_grams(state, query)
            assert pairs(cdc.search_exact(spark, table, "port")) == {(f, n) for f, n in state if "port" in n.lower()}
            assert pairs(cdc.search_exact(spark, table, "ö")) == {(f, n) for f, n in state if "ö" in n}


def test_index_of_a_stream(spark, sf_dir, tmp_path):
    """Micro-batches of a stream, a restart and a merge: postings of the base are those of the state, sorted by gram."""
    source, table, mark = (str(tmp_path / x) for x in ("in", "table", "mark"))
    log = changes(spark, sf_dir)
    for i in range(2):
        log.where(F.col("seq") % 2 == i).coalesce(1).write.mode("append").parquet(source)
        cdc.follow(spark.readStream.schema(log.schema).parquet(source), table, mark).awaitTermination()
    version = cdc.compact(spark, table)
    state, _, _ = cdc.current(spark, table)
    want = index.postings(state.withColumnRenamed("frn", "file_id"))
    assert pairs(Versioned(spark, table).base("index", cdc.POSTING, version).select("gram", "frn")) == pairs(want)
    assert pairs(cdc.search(spark, table, "signup_1")) == with_grams({(r.frn, r.name) for r in state.collect()}, "signup_1")


def test_files_stay_bounded_while_a_reader_holds_an_old_version(spark, tmp_path):
    """Each merge keeps two versions, so a reader that began before the last merge ends well."""
    table, rows = str(tmp_path), journal(6, n=60, files=5)
    now, sizes = datetime(2024, 1, 1), []
    for number in range(12):
        cdc.append_changes(spark.createDataFrame(rows[number * 5 : number * 5 + 5], cdc.CHANGE).coalesce(1), table, number)
        held = cdc.current(spark, table)[0]
        now += timedelta(seconds=300)
        assert cdc.compact_if_due(spark, table, threshold_mb=0, now=now) == number + 1
        assert cdc.compact_if_due(spark, table, threshold_mb=0, now=now + timedelta(seconds=299)) is None
        assert {(r.frn, r.name) for r in held.collect()} == state_of(rows[: number * 5 + 5])
        sizes.append(sum(1 for p in Path(table).rglob("*.parquet")))
    assert max(sizes[6:]) <= max(sizes[2:6]) + 4
    assert [r.version for r in cdc.versions(spark, table).orderBy("version").collect()] == [11, 12]
    assert {(r.frn, r.name) for r in cdc.current(spark, table)[0].collect()} == state_of(rows)


def test_counters_of_a_stream(spark, sf_dir, tmp_path):
    source, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    log = clicks(spark, sf_dir)
    counted = Counters(spark, str(tmp_path / "counts"), log.schema, ["result_id", "plugin_id"], latest=("title",))
    assert counted.read().count() == 0
    for i in range(3):
        log.where(F.col("event_id") % 3 == i).coalesce(1).write.mode("append").parquet(source)
        counted.follow(spark.readStream.schema(log.schema).parquet(source), mark).awaitTermination()
        if i != 1:
            assert counted.compact() == (1 if i == 0 else 2)
    counted.append(log.where(F.col("event_id") % 3 == 1), 1)  # a batch that runs again, and is merged already
    want = usage.counters(log, "result_id", "plugin_id", latest=("title",))
    assert counted.read().columns == want.columns
    assert pairs(counted.read()) == pairs(want)


def test_bitmaps(spark):
    """AND, OR, counts and deltas against sets, with ids of several buckets, 0 and negative ones."""
    rng = random.Random(2)
    ids = [0, 1, -1, -32_768, -32_769, 32_767, 32_768, 32_769, 65_536, 65_537, 10**12] + [rng.randrange(-100_000, 100_000) for _ in range(200)]
    sets = {g: set(rng.sample(ids, 150)) for g in "abc"} | {"d": {5}}
    posts = spark.createDataFrame([(g, i) for g, s in sets.items() for i in s] * 2 + [("a", None)], "gram string, file_id long")
    maps = bitmaps.bitmap_postings(posts)
    found = lambda df: {r.file_id for r in bitmaps.file_ids(df).collect()}
    assert found(bitmaps.search_and(maps, ["a", "b", "c"])) == sets["a"] & sets["b"] & sets["c"]
    assert found(bitmaps.search_and(maps, ["a", "none"])) == set()
    assert found(bitmaps.search_or(maps, ["b", "d", "none"])) == sets["b"] | sets["d"]
    assert {(r.gram, r.file_id) for r in bitmaps.file_ids(maps, "gram").collect()} == {(g, i) for g, s in sets.items() for i in s}
    removed = {g: set(rng.sample(sorted(s), len(s) // 2)) | {7} for g, s in sets.items() if g != "d"} | {"d": {5}, "e": {1}}
    gone = bitmaps.bitmap_postings(spark.createDataFrame([(g, i) for g, s in removed.items() for i in s], "gram string, file_id long"))
    counts = {r.gram: r.n_files for r in bitmaps.posting_counts(maps, gone).collect()}
    assert counts == {g: len(s - removed[g]) for g, s in sets.items() if s - removed[g]}
    halves = [bitmaps.bitmap_postings(posts.where(F.pmod("file_id", F.lit(2)) == i)) for i in (0, 1)]
    assert {r.gram: r.n_files for r in bitmaps.posting_counts(bitmaps.with_delta(*halves)).collect()} == {g: len(s) for g, s in sets.items()}


def is_like(text, pattern):
    """text ILIKE %pattern% in plain Python."""
    text, pattern = text.lower(), f"%{pattern.lower()}%"
    at = {0}
    for c in pattern:
        if c == "%":
            at = set(range(min(at), len(text) + 1)) if at else at
        else:
            at = {i + 1 for i in at if i < len(text) and c in ("_", text[i])}
    return len(text) in at


def test_patterns_among_texts(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abAB%_\\é.") for _ in range(rng.randrange(7)))
    texts, patterns = sorted({word() for _ in range(90)}), sorted({word() for _ in range(90)})
    got = containment.matches(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(p,) for p in patterns], "pattern string"), bound=3)
    assert pairs(got) == {(t, p) for t in texts for p in patterns if p.strip("%_") and is_like(t, p)}
    counts = {q: rng.randrange(1, 1000) for q in patterns}
    want = {t: counts.get(t, max((n for q, n in counts.items() if is_like(q, t) or is_like(t, q)), default=0)) for t in texts}
    wanted, known = spark.createDataFrame([(t,) for t in [*texts, None]], "text string"), spark.createDataFrame(list(counts.items()), "query string, count long")
    assert {r.text: r.usage for r in usage.exact_or_fuzzy(wanted, known).collect()} == want | {None: 0}


def test_lookups_have_no_nested_loop(spark):
    """100,000 texts against as many queries."""
    texts = spark.range(100_000).select(F.concat(F.lit("text "), F.hex("id")).alias("text"))
    known = spark.range(100_000).select(F.concat(F.lit("a text "), F.hex(F.col("id") * 2)).alias("query"), F.col("id").alias("count"))
    found = usage.exact_or_fuzzy(texts, known)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = dict(map(tuple, found.collect()))
    best = {}
    for i in range(100_000):
        name = f"{2 * i:X}"
        for k in range(1, len(name) + 1):  # a text is in a query if it is its beginning
            best[name[:k]] = max(best.get(name[:k], 0), i)
    assert got == {f"text {i:X}": best.get(f"{i:X}", 0) for i in range(100_000)}
