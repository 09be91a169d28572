"""Usage statistics as aggregates of event logs: counters, top lists, retention, suggestions.

A counter that is raised on each use is a count over the log, its last use the log's greatest time; nothing is updated
in place.  Lists are top-k by count and last use, with the key as the last tie break.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trovex.functions.times import time_band
from trovex.operators import containment
from trovex.sources.shared import stored


def counters(log: DataFrame, *keys: str, latest: tuple[str, ...] = (), ts: str = "ts") -> DataFrame:
    """keys, count, last_used, created_at, and the latest value of other columns."""
    order = F.struct(ts, "event_id")
    return log.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"),
        F.max(ts).alias("last_used"),
        F.min(ts).alias("created_at"),
        *[F.max_by(c, order).alias(c) for c in latest],
    )


def top(counts: DataFrame, k: int, *keys: str) -> DataFrame:
    return counts.orderBy(F.desc("count"), F.desc("last_used"), *keys).limit(k)


def retained(counts: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """Rows last used within so many days."""
    return counts.where(F.col("last_used") >= now - F.make_dt_interval(F.lit(days)))


def alike(a: str, b: str) -> Column:
    """Whether column a is like %b%, or b like %a%, whatever the case."""
    plain = lambda c: r"replace({c}, '\\', '\\\\')".format(c=c)
    return F.expr(f"{a} ILIKE concat('%', {plain(b)}, '%') OR {b} ILIKE concat('%', {plain(a)}, '%')")


def fuzzy_max(counts: DataFrame, text: str) -> DataFrame:
    """One row: the greatest count of queries that are like text, or that text is like, 0 without one.

    % and _ in either are wild, as in LIKE; a backslash is itself.
    """
    named = counts.withColumn("_text", F.lit(text))
    return named.where(alike("query", "_text")).agg(F.coalesce(F.max("count"), F.lit(0)).cast("long").alias("usage"))


def exact_or_fuzzy(wanted: DataFrame, counts: DataFrame, bound: int = 10_000) -> DataFrame:
    """(text, usage): the count of the query that equals text, else the greatest count of a query alike, 0 without one.

    Texts without an equal are looked up by grams in both directions: as patterns among the queries, and the queries as
    patterns among them.  Null texts have usage 0.  bound: grams that are broadcast at most.
    """
    asked = wanted.select("text").distinct()
    exact = stored(asked.join(counts.select(F.col("query").alias("text"), F.col("count").alias("usage")), "text", "left"), "asked")
    rest = exact.where("usage is null").select("text")
    texts = rest.where("text is not null")
    known = stored(counts.where("query is not null").groupBy("query").agg(F.max("count").alias("count")), "queries")
    inside = containment.matches(known.select(F.col("query").alias("text")), texts.select(F.col("text").alias("pattern")), bound)
    around = containment.matches(texts, known.select(F.col("query").alias("pattern")), bound)
    found = inside.select(F.col("pattern").alias("text"), F.col("text").alias("query")).union(around.select("text", F.col("pattern").alias("query")))
    best = found.join(known, "query").select("text", F.col("count").alias("value"))
    lengths = known.select(F.length(F.lower("query")).alias("at"), F.col("count").alias("value"))
    wild = containment.best_by_length(lengths, containment.blanks(texts.withColumn("pattern", F.col("text")), "text"), longer=True)
    wild_queries = containment.blanks(known.select(F.col("query").alias("pattern"), F.col("count").alias("value")), "value")
    by_wild = containment.best_by_length(wild_queries, texts.select(F.length(F.lower("text")).alias("at"), "text"), longer=False)
    best = best.union(wild.select("text", "value")).union(by_wild.select("text", "value")).groupBy("text").agg(F.max("value").alias("usage"))
    rest = rest.join(best, "text", "left").select("text", F.coalesce("usage", F.lit(0)).alias("usage"))
    return exact.where("usage is not null").unionByName(rest)


def most_recent_list(log: DataFrame, k: int = 20) -> DataFrame:
    """(result_id, plugin_id, title, execution_count, last_executed) of what was run last; the title is the first one seen."""
    order = F.struct("ts", "event_id")
    rows = log.groupBy("result_id", "plugin_id").agg(F.min_by("title", order).alias("title"), F.count(F.lit(1)).alias("execution_count"), F.max("ts").alias("last_executed"))
    return rows.orderBy(F.desc("last_executed"), "result_id", "plugin_id").limit(k)


def placed(rows: DataFrame, *order: Column) -> DataFrame:
    """Adds place, from 0, to a short list (what a top-k or a limit left): its one window is as long as the list."""
    return rows.withColumn("place", F.row_number().over(W.orderBy(*order)).cast("long") - 1)


def frequent(counts: DataFrame, k: int = 10) -> DataFrame:
    """Suggestions by count: 100, 95, 90, ..."""
    rows = placed(top(counts, k, "result_id", "plugin_id"), F.desc("count"), F.desc("last_used"), F.col("result_id"), F.col("plugin_id"))
    return rows.select("result_id", "title", (100.0 - 5.0 * F.col("place")).alias("score"), F.lit(0).alias("source"), "place")


def recent(counts: DataFrame, k: int = 5) -> DataFrame:
    """The same list, shorter, at a flat 60."""
    rows = placed(top(counts, k, "result_id", "plugin_id"), F.desc("count"), F.desc("last_used"), F.col("result_id"), F.col("plugin_id"))
    return rows.select("result_id", "title", F.lit(60.0).alias("score"), F.lit(2).alias("source"), "place")


def by_hour(points: DataFrame, hour: Column) -> DataFrame:
    """points with result_id and score of the hour's suggestion; hours without one are left out."""
    return points.withColumn("_band", time_band(hour)).where("_band is not null").select("*", "_band.result_id", "_band.score").drop("_band")


def best_of_each(suggestions: DataFrame) -> DataFrame:
    """One row for each result_id: the highest score; at a tie the earlier source, then the earlier place."""
    first = F.struct((-F.col("score")).alias("s"), "source", "place")
    return suggestions.groupBy("result_id").agg(F.min_by(F.struct("title", "score", "source"), first).alias("b")).select("result_id", "b.title", "b.score", "b.source")
