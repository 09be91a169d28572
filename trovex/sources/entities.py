"""The engine's entities, as adapters over the driver's tables, each with the same relation in SQL.

Each function takes (spark, sf_dir) and returns a DataFrame; the SQL constant beside it is a common table expression of
the same columns.  NOW stands for the current time, so that results do not depend on the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOW_TEXT = "2024-01-31 00:00:00"
NOW_SQL = f"TIMESTAMP '{NOW_TEXT}'"
EXTENSIONS = ["exe", "lnk", "bat", "txt", "md"]


def now() -> Column:
    return F.lit(NOW_TEXT).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, drive, name, path, size): a file for each part."""
    p = table(spark, sf_dir, "part")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("p_partkey") % 5 + 1).cast("int"))
    rows = p.select(
        F.col("p_partkey").alias("file_id"),
        F.substring(F.lit("CDE"), (F.col("p_partkey") % 3 + 1).cast("int"), F.lit(1)).alias("drive"),
        F.concat("p_name", F.lit("."), ext).alias("name"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("kind"),
        F.col("p_size").cast("long").alias("size"),
    )
    return rows.select("file_id", "drive", "name", F.concat("drive", F.lit(":\\"), "brand", F.lit("\\"), "kind", F.lit("\\"), "name").alias("path"), "size")


FILES = r"""files AS (SELECT *, drive || ':\' || brand || '\' || kind || '\' || name AS path FROM (
  SELECT p_partkey AS file_id, substr('CDE', CAST(p_partkey % 3 AS INT) + 1, 1) AS drive, p_brand AS brand, p_type AS kind,
         p_name || '.' || ['exe','lnk','bat','txt','md'][CAST(p_partkey % 5 AS INT) + 1] AS name, CAST(p_size AS BIGINT) AS size FROM part))"""


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, query, ts): the log of searches."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.concat("event_type", F.lit("-"), F.get_json_object("props", "$.k")).alias("query"), "ts")


SEARCHES = "searches AS (SELECT event_id, event_type || '-' || (props->>'$.k') AS query, ts FROM events)"


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, result_id, plugin_id, title, ts): the log of chosen results."""
    e = table(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    return e.select("event_id", user.alias("result_id"), F.col("event_type").alias("plugin_id"), F.concat("event_type", F.lit(" "), user).alias("title"), "ts")


CLICKS = "clicks AS (SELECT event_id, CAST(user_id AS VARCHAR) AS result_id, event_type AS plugin_id, event_type || ' ' || user_id AS title, ts FROM events)"


def search_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query, frequency, timestamp, last_executed): one row for each user and kind of event."""
    e = table(spark, sf_dir, "events")
    bought = F.max(F.when(F.col("value") > 100, F.col("ts")))
    rows = e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("frequency"), F.max("ts").alias("timestamp"), bought.alias("last_executed"))
    return rows.select(F.concat("event_type", F.lit(" "), F.col("user_id").cast("string")).alias("query"), "frequency", "timestamp", "last_executed")


HISTORY = """search_history AS (SELECT event_type || ' ' || user_id AS query, count(*) AS frequency, max(ts) AS timestamp,
  max(CASE WHEN value > 100 THEN ts END) AS last_executed FROM events GROUP BY user_id, event_type)"""


def clipboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, content_type, content, plain_text, tags, ts, favorite): plain_text is null for every fifth row, tags for every third."""
    c = table(spark, sf_dir, "conversations")
    number = F.col("conv_id") * 1000 + F.col("turn")
    return c.select(
        number.alias("id"),
        F.col("role").alias("content_type"),
        F.col("text").alias("content"),
        F.when(number % 5 != 0, F.col("text")).alias("plain_text"),
        F.when(number % 3 != 0, F.concat(F.col("role"), F.lit(","), F.lit("turn"), F.col("turn").cast("string"))).alias("tags"),
        (F.col("conv_id") * 60 + F.col("turn")).alias("ts"),
        F.when(number % 7 == 0, 1).otherwise(0).cast("long").alias("favorite"),
    )


CLIPBOARD = """clipboard AS (SELECT conv_id * 1000 + turn AS id, role AS content_type, text AS content,
  CASE WHEN (conv_id * 1000 + turn) % 5 <> 0 THEN text END AS plain_text,
  CASE WHEN (conv_id * 1000 + turn) % 3 <> 0 THEN role || ',turn' || turn END AS tags, conv_id * 60 + turn AS ts,
  CASE WHEN (conv_id * 1000 + turn) % 7 = 0 THEN CAST(1 AS BIGINT) ELSE 0 END AS favorite FROM conversations)"""


def browsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, title, url, visit_count, last_visit): pages with the events of their number."""
    pages, e = table(spark, sf_dir, "pages"), table(spark, sf_dir, "events")
    n = max(1, pages.count())
    visits = e.groupBy((F.col("event_id") % n).alias("page_id")).agg(F.count(F.lit(1)).alias("visit_count"), F.max("ts").alias("last_visit"))
    rows = pages.select("page_id", "url").join(visits, "page_id", "left")
    title = F.concat(F.lit("Page "), F.col("page_id").cast("string"), F.lit(" of "), F.substring_index(F.regexp_replace("url", "^https?://", ""), "/", 1))
    return rows.select("page_id", title.alias("title"), "url", F.coalesce("visit_count", F.lit(0)).alias("visit_count"), "last_visit")


BROWSING = """browsing AS (SELECT p.page_id, 'Page ' || p.page_id || ' of ' || split_part(regexp_replace(url, '^https?://', ''), '/', 1) AS title, url,
  coalesce(visit_count, 0) AS visit_count, last_visit
  FROM pages p LEFT JOIN (SELECT event_id % (SELECT count(*) FROM pages) AS page_id, count(*) AS visit_count, max(ts) AS last_visit FROM events GROUP BY 1) v ON p.page_id = v.page_id)"""

# The kind of audit entry that each type of event stands for.
KINDS = {"view": "PermissionCheck", "click": "FileAccess", "signup": "NetworkAccess", "purchase": "ProgramExecution", "error": "Violation"}


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ts, kind, plugin_id, permission, allowed, severity)."""
    e = table(spark, sf_dir, "events")
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), F.col("event_type"))
    allowed = F.col("value") < 100
    return e.select(
        "event_id",
        "ts",
        kind.alias("kind"),
        F.concat(F.lit("com.example.p"), (F.col("user_id") % 20).cast("string")).alias("plugin_id"),
        F.concat(F.lit("filesystem:read:/data/"), F.get_json_object("props", "$.k")).alias("permission"),
        allowed.alias("allowed"),
        F.when(allowed, "Info").otherwise("Warning").alias("severity"),
    )


AUDIT = """audit AS (SELECT event_id, ts,
  CASE event_type WHEN 'view' THEN 'PermissionCheck' WHEN 'click' THEN 'FileAccess' WHEN 'signup' THEN 'NetworkAccess' WHEN 'purchase' THEN 'ProgramExecution' WHEN 'error' THEN 'Violation' END AS kind,
  'com.example.p' || (user_id % 20) AS plugin_id, 'filesystem:read:/data/' || (props->>'$.k') AS permission, value < 100 AS allowed,
  CASE WHEN value < 100 THEN 'Info' ELSE 'Warning' END AS severity FROM events)"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, frn, reason, name, ts): a journal of changes, reason a bit mask."""
    e = table(spark, sf_dir, "events")
    reason = F.when(F.col("event_type") == "signup", 0x100).when(F.col("event_type") == "error", 0x200).when(F.col("event_type") == "purchase", 0x1000).otherwise(0)
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("frn"), reason.alias("reason"), F.concat("event_type", F.lit("_"), F.get_json_object("props", "$.k"), F.lit(".txt")).alias("name"), "ts")


CHANGES = """changes AS (SELECT event_id AS seq, user_id AS frn,
  CASE event_type WHEN 'signup' THEN 256 WHEN 'error' THEN 512 WHEN 'purchase' THEN 4096 ELSE 0 END AS reason,
  event_type || '_' || (props->>'$.k') || '.txt' AS name, ts FROM events)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frn, parent_frn, name): regions are roots, nations and customers follow."""
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    roots = r.select((F.col("r_regionkey") + 1).cast("long").alias("frn"), F.lit(0).cast("long").alias("parent_frn"), F.col("r_name").alias("name"))
    middle = n.select((F.col("n_nationkey") + 1000).cast("long"), (F.col("n_regionkey") + 1).cast("long"), "n_name")
    leaves = c.select(F.col("c_custkey") + 1_000_000, (F.col("c_nationkey") + 1000).cast("long"), "c_name")
    return roots.union(middle).union(leaves)


EDGES = """edges AS (SELECT CAST(r_regionkey + 1 AS BIGINT) AS frn, CAST(0 AS BIGINT) AS parent_frn, r_name AS name FROM region
  UNION ALL SELECT n_nationkey + 1000, n_regionkey + 1, n_name FROM nation
  UNION ALL SELECT c_custkey + 1000000, c_nationkey + 1000, c_name FROM customer)"""


def inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of literals."""
    return spark.createDataFrame(rows, schema)


def values(name: str, columns: str, rows: list[tuple]) -> str:
    """The same literals as a common table expression."""

    def literal(x: object) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, (list, tuple)):
            return "[" + ", ".join(map(literal, x)) + "]"
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + ")"
