"""Queries of usage statistics, suggestions and histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovex.functions import text as T
from trovex.functions import times
from trovex.operators import logs, ranking, usage
from trovex.operators.plugins import Plugins
from trovex.plans.registry import Plans
from trovex.plans.searching import RECENCY, fuzzy_sql
from trovex.sources.entities import BROWSING, CLICKS, HISTORY, NOW_SQL, SEARCHES, browsing, clicks, now, search_history, searches, table, with_
from trovex.sources.shared import scratch
from trovex.streaming.counters import Counters

PLANS = Plans()


@PLANS.query(with_(SEARCHES) + "SELECT query, count(*) AS count, max(ts) AS last_used, min(ts) AS created_at FROM searches GROUP BY query")
def upsert_query_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.counters(searches(spark, sf_dir), "query")


CLICK_COUNTS = """click_counts AS (SELECT result_id, plugin_id, count(*) AS count, max(ts) AS last_used, min(ts) AS created_at, arg_max(title, (ts, event_id)) AS title FROM clicks GROUP BY result_id, plugin_id)"""


@PLANS.query(with_(CLICKS, CLICK_COUNTS) + "SELECT * FROM click_counts")
def upsert_click_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.counters(clicks(spark, sf_dir), "result_id", "plugin_id", latest=("title",))


@PLANS.query(with_(CLICKS, CLICK_COUNTS) + "SELECT * FROM click_counts")
def stream_click_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counters from micro-batches: the log in three, the second one twice, and a merge in between."""
    log = clicks(spark, sf_dir)
    counted = Counters(spark, scratch(spark, "counters"), log.schema, ["result_id", "plugin_id"], latest=("title",))
    for number in (0, 1, 1, 2):
        counted.append(log.where(F.pmod("event_id", F.lit(3)) == number), number)
        if number == 0:
            counted.compact()
    return counted.read()


@PLANS.query(with_(CLICKS) + "SELECT plugin_id, count(*) AS count, max(ts) AS last_used, min(ts) AS created_at FROM clicks GROUP BY plugin_id")
def upsert_plugin_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.counters(clicks(spark, sf_dir), "plugin_id")


@PLANS.query(with_(SEARCHES) + "SELECT query, count(*) AS count, max(ts) AS last_used FROM searches GROUP BY query ORDER BY count DESC, last_used DESC, query LIMIT 20")
def top_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.top(upsert_query_counts(spark, sf_dir), 20, "query").select("query", "count", "last_used")


@PLANS.query(with_(CLICKS, CLICK_COUNTS) + "SELECT result_id, plugin_id, title, count, last_used FROM click_counts ORDER BY count DESC, last_used DESC, result_id, plugin_id LIMIT 20")
def top_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.top(upsert_click_counts(spark, sf_dir), 20, "result_id", "plugin_id").select("result_id", "plugin_id", "title", "count", "last_used")


@PLANS.query(with_(SEARCHES) + f"SELECT query, count(*) AS count, max(ts) AS last_used FROM searches GROUP BY query HAVING max(ts) >= {NOW_SQL} - INTERVAL 5 DAY")
def retain_90d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retention by age; the tables span a month, so the query keeps five days."""
    return usage.retained(upsert_query_counts(spark, sf_dir), now(), days=5).select("query", "count", "last_used")


@PLANS.query(with_(CLICKS) + "SELECT result_id, plugin_id, arg_min(title, (ts, event_id)) AS title, count(*) AS execution_count, max(ts) AS last_executed FROM clicks GROUP BY 1, 2 ORDER BY last_executed DESC, result_id, plugin_id LIMIT 20")
def mru_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.most_recent_list(clicks(spark, sf_dir))


FILES_BY_KIND = "kinds AS (SELECT split_part(p_type, ' ', 1) AS kind, count(*) AS n FROM part GROUP BY 1)"
COUNTS = "counts AS (SELECT query, count(*) AS count FROM searches GROUP BY query)"


@PLANS.query(with_(SEARCHES, COUNTS) + "SELECT CAST(coalesce(max(count), 0) AS BIGINT) AS usage FROM counts WHERE query ILIKE '%click-1%' OR 'click-1' ILIKE '%' || query || '%'")
def fuzzy_usage_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.fuzzy_max(usage.counters(searches(spark, sf_dir), "query"), "click-1")


class Words:
    """A plugin in Python: the parts of a query between hyphens."""

    def eval(self, query: str):
        for i, part in enumerate(query.split("-")):
            yield f"word-{i}", part, float(len(part))


@PLANS.query(with_(SEARCHES, FILES_BY_KIND) + """SELECT query, 'kinds' AS plugin_id, kind AS id, kind || ' files' AS title, CAST(n AS DOUBLE) AS score FROM (SELECT DISTINCT query FROM searches) JOIN kinds ON starts_with(lower(query), substr(lower(kind), 1, 1))
  UNION ALL SELECT query, 'echo', md5(query), 'Search for ' || query, 50 FROM (SELECT DISTINCT query FROM searches)
  UNION ALL SELECT query, 'words', 'word-' || (i - 1), string_split(query, '-')[i], length(string_split(query, '-')[i]) FROM (SELECT query, unnest(range(1, len(string_split(query, '-')) + 1)) AS i FROM (SELECT DISTINCT query FROM searches))""")
def plugin_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three plugins, of SQL over a table, of SQL alone and in Python, for all searches in one plan."""
    kinds = table(spark, sf_dir, "part").groupBy(F.substring_index("p_type", " ", 1).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    kinds.createOrReplaceTempView("plugin_kinds")
    found = Plugins(spark)
    found.register_sql("kinds", "SELECT kind, concat(kind, ' files'), double(n) FROM plugin_kinds WHERE startswith(lower(query), substr(lower(kind), 1, 1))")
    found.register_sql("echo", "SELECT md5(query), concat('Search for ', query), 50D")
    found.register_class("words", Words)
    return found.answers(searches(spark, sf_dir))


WANTED = "wanted AS (SELECT DISTINCT CASE WHEN n_nationkey % 2 = 0 THEN 'click-' || n_nationkey ELSE 'k-' || n_nationkey END AS text FROM nation)"


@PLANS.query(with_(SEARCHES, COUNTS, WANTED) + """SELECT text, CAST(coalesce((SELECT count FROM counts WHERE query = text),
  (SELECT max(count) FROM counts WHERE query ILIKE '%' || text || '%' OR text ILIKE '%' || query || '%'), 0) AS BIGINT) AS usage FROM wanted""")
def usage_exact_or_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("n_nationkey").cast("string")
    wanted = table(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("click-"), number)).otherwise(F.concat(F.lit("k-"), number)).alias("text"))
    return usage.exact_or_fuzzy(wanted, usage.counters(searches(spark, sf_dir), "query"))


LIST = "listed AS (SELECT *, row_number() OVER (ORDER BY count DESC, last_used DESC, result_id, plugin_id) - 1 AS place FROM click_counts ORDER BY place LIMIT 10)"


@PLANS.query(with_(CLICKS, CLICK_COUNTS, LIST) + "SELECT result_id, title, CAST(100 - 5 * place AS DOUBLE) AS score FROM listed")
def suggest_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.frequent(upsert_click_counts(spark, sf_dir)).select("result_id", "title", "score")


@PLANS.query(with_(CLICKS, CLICK_COUNTS, LIST) + "SELECT result_id, title, CAST(60 AS DOUBLE) AS score FROM listed WHERE place < 5")
def suggest_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.recent(upsert_click_counts(spark, sf_dir)).select("result_id", "title", "score")


@PLANS.query(with_(CLICKS, CLICK_COUNTS, LIST) + """SELECT result_id, title, score, source FROM (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY score DESC, source, place) AS k FROM (
  SELECT result_id, title, CAST(100 - 5 * place AS DOUBLE) AS score, 0 AS source, place FROM listed UNION ALL SELECT result_id, title, 60, 2, place FROM listed WHERE place < 5)) WHERE k = 1""")
def suggest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = upsert_click_counts(spark, sf_dir)
    return usage.best_of_each(usage.frequent(counts).unionByName(usage.recent(counts)))


@PLANS.query("""SELECT event_id, CASE WHEN h BETWEEN 6 AND 9 THEN 'morning_routine' WHEN h BETWEEN 12 AND 14 THEN 'lunch_break' ELSE 'evening_routine' END AS result_id,
  CAST(CASE WHEN h BETWEEN 6 AND 9 THEN 80 WHEN h BETWEEN 12 AND 14 THEN 70 ELSE 75 END AS DOUBLE) AS score
  FROM (SELECT event_id, hour(ts) AS h FROM events) WHERE h BETWEEN 6 AND 9 OR h BETWEEN 12 AND 14 OR h BETWEEN 18 AND 23""")
def time_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.by_hour(table(spark, sf_dir, "events").select("event_id", "ts"), F.hour("ts")).select("event_id", "result_id", "score")


@PLANS.query(with_(CLICKS) + "SELECT plugin_id, count(*) AS count, round(least(100.0, log10(count(*) + 1.0) * 50.0), 6) AS score FROM clicks GROUP BY plugin_id UNION ALL SELECT result_id, count(*), round(least(100.0, log10(count(*) + 1.0) * 50.0), 6) FROM clicks GROUP BY result_id")
def frequency_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = clicks(spark, sf_dir)
    of = lambda key: log.groupBy(F.col(key).alias("plugin_id")).agg(F.count(F.lit(1)).alias("count"))
    return of("plugin_id").union(of("result_id")).withColumn("score", F.round(ranking.frequency_score(F.col("count")), 6))


@PLANS.query("SELECT event_id, CAST(" + RECENCY.format(t="ts", now=NOW_SQL) + " AS DOUBLE) AS score FROM events")
def recency_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", times.recency_score(F.col("ts"), now()).alias("score"))


@PLANS.query(f"""SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || ' min ago' WHEN s < 86400 THEN (s // 3600) || ' hours ago'
  WHEN s < 604800 THEN (s // 86400) || ' days ago' ELSE strftime(ts, '%Y-%m-%d %H:%M') END AS label
  FROM (SELECT event_id, ts, CAST(epoch({NOW_SQL}) - epoch(date_trunc('second', ts)) AS BIGINT) AS s FROM events)""")
def relative_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", times.relative_time(F.col("ts"), now()).alias("label"))


RELEVANCE = f"""relevance AS (SELECT query, frequency * 10.0 + CASE WHEN h < 1 THEN 100.0 WHEN h < 24 THEN 50.0 / h WHEN h < 168 THEN 20.0 / (h / 24.0) ELSE 5.0 / (h / 168.0) END
  + CASE WHEN x IS NULL THEN 0.0 WHEN x < 24 THEN 50.0 WHEN x < 168 THEN 20.0 / (x / 24.0) ELSE 5.0 END AS relevance, frequency FROM (
  SELECT query, CAST(frequency AS DOUBLE) AS frequency, (epoch({NOW_SQL}) - epoch(date_trunc('second', timestamp))) / CAST(3600 AS DOUBLE) AS h,
  (epoch({NOW_SQL}) - epoch(date_trunc('second', last_executed))) / CAST(3600 AS DOUBLE) AS x FROM search_history))"""


def relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = search_history(spark, sf_dir)
    return h.withColumn("relevance", times.history_relevance(F.col("frequency"), F.col("timestamp"), F.col("last_executed"), now()))


@PLANS.query(with_(HISTORY, RELEVANCE) + "SELECT query, round(relevance, 6) AS relevance FROM relevance ORDER BY relevance.relevance DESC, query LIMIT 100")
def history_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relevant(spark, sf_dir).orderBy(F.desc("relevance"), "query").limit(100).select("query", F.round("relevance", 6).alias("relevance"))


@PLANS.query(with_(HISTORY, RELEVANCE) + "SELECT query, round(relevance, 6) AS relevance FROM relevance WHERE starts_with(lower(query), 'pur') ORDER BY relevance.relevance DESC, query LIMIT 10")
def suggest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relevant(spark, sf_dir).where(F.startswith(F.lower("query"), F.lit("pur")))
    return rows.orderBy(F.desc("relevance"), "query").limit(10).select("query", F.round("relevance", 6).alias("relevance"))


@PLANS.query("""WITH RECURSIVE log AS (SELECT user_id, event_type || '-' || (props->>'$.k') AS query, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
  walk AS (SELECT user_id, k, [{'q': query, 'n': CAST(1 AS BIGINT)}] AS items FROM log WHERE k = 1 UNION ALL
    SELECT l.user_id, l.k, CASE WHEN list_contains(list_transform(w.items, lambda x: x.q), l.query) THEN list_transform(w.items, lambda x: {'q': x.q, 'n': x.n + CAST(x.q = l.query AS BIGINT)})
      ELSE list_prepend({'q': l.query, 'n': CAST(1 AS BIGINT)}, w.items)[:20] END FROM walk w JOIN log l ON l.user_id = w.user_id AND l.k = w.k + 1),
  ends AS (SELECT user_id, unnest(items) AS item, generate_subscripts(items, 1) AS i FROM (SELECT user_id, arg_max(items, k) AS items FROM walk GROUP BY user_id))
  SELECT user_id, item.q AS query, item.n AS frequency, CAST(i - 1 AS INT) AS place FROM ends""")
def history_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's history of 20, where a search that comes again stays where it is."""
    log = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.concat("event_type", F.lit("-"), F.get_json_object("props", "$.k")).alias("query"))
    return logs.bounded_history(log, "user_id", ["ts", "event_id"], "query")


@PLANS.query(with_(CLICKS) + """SELECT result_id, plugin_id, 100 - (row_number() OVER (ORDER BY last DESC, result_id, plugin_id) - 1) AS score FROM
  (SELECT result_id, plugin_id, max(ts) AS last FROM clicks WHERE plugin_id NOT IN ('error') GROUP BY 1, 2 ORDER BY last DESC, result_id, plugin_id LIMIT 20)""")
def history_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = clicks(spark, sf_dir).where(~F.col("plugin_id").isin("error"))
    rows = usage.placed(usage.most_recent_list(log), F.desc("last_executed"), F.col("result_id"), F.col("plugin_id"))
    return rows.select("result_id", "plugin_id", (100 - F.col("place")).alias("score"))


@PLANS.query("SELECT event_id, event_type FROM events WHERE event_type NOT IN (SELECT 'error' UNION ALL SELECT 'signup')")
def disabled_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    disabled = spark.createDataFrame([("error",), ("signup",)], "event_type string")
    return table(spark, sf_dir, "events").join(F.broadcast(disabled), "event_type", "left_anti").select("event_id", "event_type")


@PLANS.query(with_(BROWSING) + "SELECT title, url, visit_count, last_visit FROM browsing WHERE visit_count > 0 ORDER BY last_visit DESC, url LIMIT 500")
def history_scan_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browsing(spark, sf_dir).where("visit_count > 0").orderBy(F.desc("last_visit"), "url").limit(500).select("title", "url", "visit_count", "last_visit")


@PLANS.query(with_(BROWSING) + """SELECT browser, url, visit_count FROM (SELECT 'one' AS browser, url, visit_count FROM browsing UNION ALL SELECT 'two', url, visit_count + page_id % 3 FROM browsing WHERE page_id % 2 = 0)
  ORDER BY visit_count DESC, url, browser LIMIT 1000""")
def history_union_top1000(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = browsing(spark, sf_dir)
    one = b.select(F.lit("one").alias("browser"), "url", "visit_count")
    two = b.where("page_id % 2 = 0").select(F.lit("two").alias("browser"), "url", (F.col("visit_count") + F.col("page_id") % 3).alias("visit_count"))
    return one.unionByName(two).orderBy(F.desc("visit_count"), "url", "browser").limit(1000)


@PLANS.query(with_(BROWSING) + f"""SELECT page_id, title, CAST(r['score'] AS BIGINT) AS score FROM (SELECT page_id, title, {fuzzy_sql('title', 'page1')} AS r FROM (SELECT * FROM browsing ORDER BY page_id LIMIT 100))
  WHERE r['at'] > 5 AND r['score'] > 30 ORDER BY score DESC, page_id LIMIT 20""")
def bookmark_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred bookmarks, of these the ones that score above 30, of these the first 20."""
    first = browsing(spark, sf_dir).orderBy("page_id").limit(100)
    rows = first.select("page_id", "title", T.fuzzy_score(F.col("title"), F.lit("page1")).cast("long").alias("score"))
    return rows.where("score > 30").orderBy(F.desc("score"), "page_id").limit(20)


@PLANS.query(with_(SEARCHES) + """SELECT event_id, user_id, query FROM (SELECT s.event_id, e.user_id, s.query, s.ts, lead(s.ts) OVER (PARTITION BY e.user_id ORDER BY s.ts, s.event_id) AS after
  FROM searches s JOIN events e ON s.event_id = e.event_id) WHERE after IS NULL OR after - ts > INTERVAL 6 HOUR""")
def debounce_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.concat("event_type", F.lit("-"), F.get_json_object("props", "$.k")).alias("query"))
    return logs.settled(log, "user_id", ["ts", "event_id"], 6 * 3600, F.date_trunc("hour", "ts")).select("event_id", "user_id", "query")


@PLANS.query(with_(SEARCHES) + "SELECT event_id, query FROM searches WHERE query NOT IN (SELECT query FROM searches GROUP BY query HAVING count(*) >= 10)")
def delete_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log without the queries that came ten times or more."""
    log = searches(spark, sf_dir)
    many = log.groupBy("query").agg(F.count(F.lit(1)).alias("n")).where("n >= 10").select("query")
    return logs.without(log, many).select("event_id", "query")
