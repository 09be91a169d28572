"""Which sources of a language differ, and by which terms: all pairs of sources by a systolic rotation.

Terms are counted for each (lang, source) before anything is shuffled.  The kept terms of a language (in MIN_DOCS
documents at least) are cut into slices by hash, and its sources into players, PLAYERS bins at most.  The vectors of one
player in one slice stay in their partition.  In each round of a round-robin tournament every player meets one other:
the compressed vectors of one of the two travel to the other's partition, where both directions are summed for all
pairs of their sources.  In a round of its own a player compares its sources among themselves, and each source's
vector in a slice ranks its terms in a heap against the language's own shares; the heaps' heads are merged.

Shares are whole numbers, so sums do not hang on their order.  What neither of two sources has adds alike for every
such term, so vectors hold the terms that occur and nothing else.

Null text, lang and source read as ''.  A group without terms, or of a language without kept terms, meets the others
like any.  Repeated rows are documents of their own.  Very long texts are counted whole.  Values that tie are ranked by
item.  Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trovex.llm.common import BATCH_ROWS, bounded, longs, lower_ascii, slices, small, stored, strings

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
#: Documents of its language that a kept term is in; parts of one in a share; terms that are told of a group.
MIN_DOCS, SCALE, TOLD = 3, 1_000_000_000, 200
#: Counts (24 bytes each) and different words that a task holds before it hands them on.
HELD, WORDS = 1_500_000, 500_000
#: Counts of one slice of a language, about; players of a language at most.
SLICE_ROWS, PLAYERS = 65_536, 8


class Terms(dict):
    """Word -> number of its term, for the words that this worker has met."""

    def __init__(self) -> None:
        super().__init__()
        self.numbers: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        self[word] = number = self.numbers.setdefault(lower_ascii(word), len(self.numbers))
        return number


def added_up(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys, and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.concatenate([[True], keys[1:] != keys[:-1]]).nonzero()[0] if len(keys) else np.empty(0, np.int64)
    return keys[first], *(np.add.reduceat(v[order], first) if len(first) else v for v in values)


def term_counts(docs: DataFrame) -> DataFrame:
    """Stored (lang, source, term, count, docs); the term '' stands for a group and has no count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, groups = Terms(), {}
        held: list[tuple[np.ndarray, ...]] = []  # keys (group and term), counts, documents

        def told(keys: np.ndarray, n: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
            names = pa.array([*terms.numbers, ""], pa.string())
            at, term = keys >> 32, keys & 0xFFFFFFFF
            own = np.arange(len(groups))
            at, term = np.concatenate([at, own]), np.concatenate([term, np.full(len(own), len(names) - 1)])
            n, d = (np.concatenate([x, np.zeros(len(own), np.int64)]) for x in (n, d))
            lang, source = (pa.array([g[k] for g in groups], pa.string()).take(pa.array(at)) for k in (0, 1))
            return pa.record_batch([lang, source, names.take(pa.array(term)), longs(n), longs(d)], ["lang", "source", "term", "count", "docs"])

        def joined() -> tuple[np.ndarray, ...]:
            return added_up(*map(np.concatenate, zip(*held, strict=True))) if held else (np.empty(0, np.int64),) * 3

        for batch in slices(batches, BATCH_ROWS):
            found = [TERM.findall(t) for t in strings(batch.column(2))]
            group = np.array([groups.setdefault(g, len(groups)) for g in zip(strings(batch.column(0)), strings(batch.column(1)), strict=True)], np.int64)
            sizes = [len(x) for x in found]
            flat = np.fromiter(map(terms.__getitem__, chain.from_iterable(found)), np.int64, sum(sizes))
            each, n = np.unique(np.repeat(np.arange(len(found)), sizes) << 32 | flat, return_counts=True)  # terms of one document
            held.append(added_up(group[each >> 32] << 32 | each & 0xFFFFFFFF, n, np.ones(len(n), np.int64)))
            if sum(len(h[0]) for h in held) > 2 * HELD or len(terms) > WORDS:
                held = [joined()]
                if len(held[0][0]) > HELD or len(terms) > WORDS:
                    yield told(*held.pop())
                    terms, groups = Terms(), {}
        yield told(*joined())

    bounded(docs.sparkSession)
    rows = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, count long, docs long")
    return stored(rows.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs")), "term-counts")


def share(count: Column | str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exactly."""
    return F.lit(1).cast("long") + F.expr(f"({SCALE}BD * CAST({count} + 1 AS DECIMAL(19, 0))) DIV CAST({total} + {terms} AS DECIMAL(19, 0))")


def measured(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored tables: counts of kept terms (lang, slice, player, source, place, tid, p, q, term); players (lang, player, players, slices, sources, blank); langs."""
    counts = term_counts(docs)
    kept = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("d"), F.sum("count").alias("total"))
    kept = stored(kept.where(F.col("d") >= MIN_DOCS).select("lang", "term", "total"), "kept-terms")
    rows = stored(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "count", "total"), "kept-counts")
    langs = counts.where("term = ''").groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    langs = langs.join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("n_lang")), "lang", "left")
    langs = langs.join(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")), "lang", "left").na.fill(0)
    langs = langs.select("lang", "v", "n_lang", F.least(F.col("sources"), F.lit(PLAYERS)).cast("int").alias("players"), F.ceil((F.col("rows") + 1) / SLICE_ROWS).cast("long").alias("slices"))
    langs = stored(langs, "langs")
    groups = counts.where("term = ''").select("lang", "source").join(rows.groupBy("lang", "source").agg(F.sum("count").alias("n")), ["lang", "source"], "left").na.fill(0, ["n"])
    groups = groups.join(small(langs), "lang").withColumn("at", F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1)
    blank = F.when(F.col("v") > 0, share("0L", "n", "greatest(v, 1)"))
    groups = groups.withColumns({"player": F.pmod("at", "players"), "place": F.floor(F.col("at") / F.col("players")).cast("int"), "blank": blank})
    groups = stored(groups.select("lang", "source", "n", "player", "place", "blank"), "groups")
    listed = groups.groupBy("lang", "player").agg(F.sort_array(F.collect_list(F.struct("place", "source", F.coalesce("blank", F.lit(1)).alias("blank")))).alias("s"))  # sources of a player
    players = listed.join(small(langs), "lang").select("lang", "player", "players", "slices", F.col("s.source").alias("sources"), F.col("s.blank").alias("blank"))
    sliced = kept.join(small(langs), "lang").withColumn("slice", F.pmod(F.xxhash64("term"), "slices"))
    sliced = sliced.select("lang", "term", "slice", "v", "n_lang", (F.row_number().over(W.partitionBy("lang", "slice").orderBy("term")) - 1).alias("tid"))
    of = small(groups.select("lang", "source", "n", "player", "place"))
    vectors = rows.join(sliced, ["lang", "term"]).join(of, ["lang", "source"])
    vectors = vectors.select("lang", "slice", "player", "source", "place", "tid", share("count", "n", "v").alias("p"), share("total", "n_lang", "v").alias("q"), "term")
    return vectors, stored(players, "players"), langs


def divergence(p: np.ndarray | int, q: np.ndarray | int) -> np.ndarray:
    return (p - q) * (p - q) // q


def residents(vectors: DataFrame, players: DataFrame) -> DataFrame:
    """Stored (lang, slice, player, vectors, source, term, value): a row with the compressed vectors of each player and slice, and rows of its heaps' heads."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.filter(table.column("term").is_valid()).sort_by([("place", "ascending"), ("tid", "ascending")])
        place, tid, p, q = (table.column(c).to_numpy() for c in ("place", "tid", "p", "q"))
        f = divergence(p, q)
        wanted = np.flatnonzero(p > q)
        terms = table.column("term").take(pa.array(wanted)).to_pylist()
        rows = [(int(place[i]), -int(f[i]), t.encode(), t) for i, t in zip(wanted.tolist(), terms, strict=True)]
        sources = dict(zip(place.tolist(), table.column("source").to_pylist(), strict=True))
        by_place: dict[int, list[tuple]] = {}
        for r in rows:
            by_place.setdefault(r[0], []).append(r)
        heads = [x for own in by_place.values() for x in heapq.nsmallest(TOLD, own)]
        packed = zlib.compress(b"".join(x.astype(np.uint32).tobytes() for x in (place, tid, p)), 1)
        n = 1 + len(heads)
        lang, part, player = (x.as_py() for x in key)
        columns = [pa.array([lang] * n, pa.string()), longs([part] * n), longs([player] * n), pa.array([packed, *[None] * len(heads)], pa.binary())]
        columns += [pa.array([None, *(sources[x[0]] for x in heads)], pa.string()), pa.array([None, *(x[3] for x in heads)], pa.string()), pa.array([None, *(-x[1] for x in heads)], pa.int64())]
        return pa.table(columns, ["lang", "slice", "player", "vectors", "source", "term", "value"])

    marks = players.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"), "player")
    rows = vectors.unionByName(marks, allowMissingColumns=True)  # so that a player without terms in a slice is there
    return stored(rows.groupBy("lang", "slice", "player").applyInArrow(run, "lang string, slice long, player long, vectors binary, source string, term string, value long"), "residents")


def tournament(players: int) -> list[list[tuple[int, int]]]:
    """The rounds of a round-robin tournament as pairs (host, guest): one player keeps its seat, the others move on by one."""
    seats: list[int | None] = [*range(players), *([None] if players % 2 else [])]
    rounds = []
    for r in range(len(seats) - 1):
        pairs = [(seats[i], seats[-1 - i]) for i in range(len(seats) // 2)]
        rounds.append([(a, b) if (r + a + b) % 2 else (b, a) for a, b in pairs if a is not None and b is not None])
        seats = [seats[0], seats[-1], *seats[1:-1]]
    return rounds


def unpacked(packed: bytes, count: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(tid, p) of each source of a player."""
    place, tid, p = np.frombuffer(zlib.decompress(packed), np.uint32).reshape(3, -1).astype(np.int64)
    cut = np.searchsorted(place, np.arange(count + 1))
    return [(tid[a:b], p[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def met(hosts: list[tuple], guests: list[tuple], own: bool) -> Iterator[tuple[str, str, int, int, int]]:
    """(source, other, sum, terms that either has, what any other term adds) in both directions for the pairs (name, blank, tid, p) of two players."""
    width = 1 + max((int(x[2][-1]) for x in [*hosts, *guests] if len(x[2])), default=0)
    has = np.zeros(width, bool)
    for i, (a, blank_a, tid_a, p_a) in enumerate(hosts):
        whole = np.full(width, blank_a)
        whole[tid_a] = p_a
        for b, blank_b, tid_b, p_b in guests[i + 1 :] if own else guests:
            p = whole[tid_b]
            has[tid_b] = True
            rest = p_a[~has[tid_a]]
            has[tid_b] = False
            n = len(tid_b) + len(rest)
            yield a, b, int(divergence(p, p_b).sum() + divergence(rest, blank_b).sum()), n, divergence(blank_a, blank_b)
            yield b, a, int(divergence(p_b, p).sum() + divergence(blank_b, rest).sum()), n, divergence(blank_b, blank_a)


def meetings(hosts: DataFrame, guests: DataFrame | None) -> DataFrame:
    """(lang, source, item, sum, n, other) of what hosts and their guests, or hosts by themselves, give."""

    alone = guests is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            sides = []
            for k in ("",) if alone else ("", "guest_"):
                found = unpacked(row[f"{k}vectors"], len(row[f"{k}sources"]))
                sides.append([(s, b, *v) for s, b, v in zip(row[f"{k}sources"], row[f"{k}blank"], found, strict=True)])
            rows = list(met(sides[0], sides[-1], alone))
            a, b, total, n, other = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.record_batch([pa.array([row["lang"]] * len(a), pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), longs(list(total)), longs(list(n)), longs(list(other))], ["lang", "source", "item", "sum", "n", "other"])

    rows = hosts.select("lang", "slice", "player", "vectors", "sources", "blank")
    if guests is not None:
        rows = rows.join(guests, ["lang", "slice", "player"])
    return rows.mapInArrow(run, "lang string, source string, item string, sum long, n long, other long")


def divergences(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): every other source of the language, and the terms that a group has more of than it."""
    spark = docs.sparkSession
    vectors, players, langs = measured(docs)
    found = residents(vectors, players)
    seated = found.where("vectors is not null").select("lang", "slice", "player", "vectors").join(small(players.select("lang", "player", "players", "sources", "blank"), 1000), ["lang", "player"])
    seated = seated.repartition("lang", "slice", "player")
    sums = [meetings(seated, None)]
    plan = [(n, r, host, guest) for n in range(2, PLAYERS + 1) for r, pairs in enumerate(tournament(n)) for host, guest in pairs]
    for r in range(max(p[1] for p in plan) + 1):
        seats = spark.createDataFrame([(n, host, guest) for n, at, host, guest in plan if at == r], "players int, host long, guest long").coalesce(1)
        moved = seated.withColumnRenamed("player", "guest").join(F.broadcast(seats), ["players", "guest"])
        moved = moved.select("lang", "slice", F.col("host").alias("player"), *(F.col(c).alias(f"guest_{c}") for c in ("vectors", "sources", "blank")))
        sums.append(meetings(seated, moved))
    total = sums[0]
    for s in sums[1:]:
        total = total.union(s)
    total = total.groupBy("lang", "source", "item").agg(F.sum("sum").alias("sum"), F.sum("n").alias("n"), F.max("other").alias("other"))
    pairs = total.join(small(langs.select("lang", "v")), "lang").select("lang", "source", "item", (F.col("sum") + (F.col("v") - F.col("n")) * F.col("other")).alias("value"))
    terms = found.where("vectors is null").select("lang", "source", F.col("term").alias("item"), "value")
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = [x.withColumn("part", F.lit(name)).withColumn("rank", rank) for name, x in (("pair", pairs), ("term", terms))]
    return ranked[0].union(ranked[1].where(F.col("rank") <= TOLD)).select("lang", "source", "part", "item", "value", "rank")


#: The same for DuckDB, with every kept term for every group.
SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
terms AS (SELECT id, lang, source, translate(unnest(words), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM texts),
kept AS (SELECT lang, term, count(*) AS total FROM terms GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
groups AS (SELECT DISTINCT lang, source FROM texts),
counts AS (SELECT lang, source, term, count(*) AS c FROM terms GROUP BY ALL),
whole AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, k.total FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
shares AS (
  SELECT lang, source, term, c,
    1 + (1000000000::HUGEINT * (c + 1)) // (sum(c) OVER of_group + count(*) OVER of_group)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (total + 1)) // (sum(total) OVER of_group + count(*) OVER of_group)::HUGEINT AS q
  FROM whole WINDOW of_group AS (PARTITION BY lang, source)),
met AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(m.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN met m ON m.lang = a.lang AND m.source = a.source AND m.item = b.source),
heads AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM shares WHERE c > 0 AND p > q),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM heads))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
