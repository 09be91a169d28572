"""Queries of the clipboard, the audit log, permissions, the change stream, workflows and the plugin catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovex.functions import text as T
from trovex.operators import logs, rules, workflows
from trovex.plans.registry import Plans
from trovex.sources.entities import AUDIT, CHANGES, CLIPBOARD, audit, changes, clipboard, inline, table, values, with_
from trovex.streaming.cdc import latest_state

PLANS = Plans()


@PLANS.query(with_(CLIPBOARD) + "SELECT id, content_type FROM clipboard WHERE content ILIKE '%un%' OR plain_text ILIKE '%un%' OR tags ILIKE '%un%'")
def search_like_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.like_any(clipboard(spark, sf_dir), "un", "content", "plain_text", "tags").select("id", "content_type")


@PLANS.query(with_(CLIPBOARD) + "SELECT id, content_type, ts FROM clipboard WHERE content_type = 'user' AND favorite = 0 ORDER BY ts DESC, id DESC LIMIT 50 OFFSET 20")
def history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clipboard(spark, sf_dir).where((F.col("content_type") == "user") & (F.col("favorite") == 0))
    return logs.page(rows, [F.desc("ts"), F.desc("id")], 20, 50).select("id", "content_type", "ts")


@PLANS.query(with_(CLIPBOARD) + "SELECT id, content_type FROM (SELECT * FROM clipboard ORDER BY ts DESC, id DESC LIMIT 100) WHERE content_type = 'user'")
def limit_then_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest hundred, and of these the user's."""
    return logs.newest(clipboard(spark, sf_dir), 100, [F.desc("ts"), F.desc("id")]).where("content_type = 'user'").select("id", "content_type")


@PLANS.query(with_(CLIPBOARD) + "SELECT id, ts FROM clipboard WHERE id IN (SELECT id FROM clipboard ORDER BY ts DESC, id DESC LIMIT 100)")
def retain_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.newest(clipboard(spark, sf_dir), 100, [F.desc("ts"), F.desc("id")]).select("id", "ts")


@PLANS.query(with_(CLIPBOARD) + "SELECT count(*) AS total, CAST(count_if(favorite = 1) AS BIGINT) AS favorites, CAST(count_if(content_type = 'user') AS BIGINT) AS texts, CAST(count_if(content_type = 'assistant') AS BIGINT) AS answers FROM clipboard")
def clip_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.clipboard_counts(clipboard(spark, sf_dir))


@PLANS.query(with_(CLIPBOARD) + "SELECT id, 1 - favorite AS favorite FROM clipboard")
def toggle_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clipboard(spark, sf_dir).select("id", logs.toggled(F.col("favorite")).alias("favorite"))


TAGS = "list_filter(list_transform(string_split(coalesce(tags, ''), ','), lambda t: trim(t)), lambda t: t <> '')"


@PLANS.query(with_(CLIPBOARD) + f"SELECT id, array_to_string(CASE WHEN list_contains({TAGS}, 'turn1') THEN {TAGS} ELSE list_append({TAGS}, 'turn1') END, ',') AS tags FROM clipboard")
def add_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clipboard(spark, sf_dir).select("id", logs.with_tag(F.col("tags"), "turn1").alias("tags"))


@PLANS.query(with_(CLIPBOARD) + f"SELECT tag, count(*) AS n FROM (SELECT unnest({TAGS}) AS tag FROM clipboard) GROUP BY tag")
def tags_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clipboard(spark, sf_dir).select(F.explode(logs.tags_of(F.col("tags"))).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@PLANS.query("""SELECT event_id, user_id, event_type FROM (SELECT event_id, user_id, event_type, lag(event_type) OVER w AS before, row_number() OVER w AS k
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE k = 1 OR before IS DISTINCT FROM event_type""")
def dedup_consecutive(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return logs.consecutive_dropped(e, "user_id", ["ts", "event_id"], "event_type", F.date_trunc("hour", "ts")).select("event_id", "user_id", "event_type")


@PLANS.query("""WITH RECURSIVE log AS (SELECT event_id, user_id, ts, event_type || '-' || (CAST(props->>'$.k' AS INT) % 5) AS content, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
  walk AS (SELECT *, true AS fresh, [content] AS last FROM log WHERE k = 1 UNION ALL
    SELECT l.*, NOT list_contains(w.last, l.content), CASE WHEN list_contains(w.last, l.content) THEN w.last ELSE list_append(w.last, l.content)[-10:] END FROM walk w JOIN log l ON l.user_id = w.user_id AND l.k = w.k + 1)
  SELECT event_id, user_id, ts, content FROM walk WHERE fresh""")
def dedup_last10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events without those like one of the last ten accepted."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.concat("event_type", F.lit("-"), (F.get_json_object("props", "$.k").cast("int") % 5).cast("string")).alias("content"))
    return logs.last_n_dedup(e, "user_id", ["ts", "event_id"], "content")


@PLANS.query(with_(CLIPBOARD) + "SELECT id, CASE WHEN length(content) <= 80 THEN content ELSE substr(content, 1, 80) || '...' END AS preview FROM clipboard")
def preview_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clipboard(spark, sf_dir).select("id", T.truncated(F.col("content"), 80).alias("preview"))


@PLANS.query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS whole, count(*) AS turns FROM conversations GROUP BY conv_id")
def conversation_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.struct("turn", F.concat("role", F.lit(": "), "text").alias("line"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("lines"), F.count(F.lit(1)).alias("turns"))
    return rows.select("conv_id", F.array_join("lines.line", "\n").alias("whole"), "turns")


@PLANS.query("SELECT conv_id, CASE WHEN length(t) <= 50 THEN t ELSE substr(t, 1, 50) || '...' END AS preview FROM (SELECT conv_id, arg_max(text, turn) AS t FROM conversations GROUP BY conv_id)")
def conversation_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max_by("text", "turn").alias("t"))
    return last.select("conv_id", T.truncated(F.col("t"), 50).alias("preview"))


@PLANS.query("""SELECT min(page_id) AS page_id, count(*) AS n, md5(length(url) || '|' || length(html) || '|' || substr(html, 1, 1000)) AS hash FROM pages GROUP BY 3""")
def sampled_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = logs.sampled_hash(F.length("url"), F.length("html"), F.col("html")).alias("hash")
    return table(spark, sf_dir, "pages").groupBy(key).agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("n")).select("page_id", "n", "hash")


# ---- audit and permissions ---------------------------------------------------------------------------------------


@PLANS.query(with_(AUDIT) + "SELECT event_id, ts, plugin_id FROM audit WHERE kind = 'Violation'")
def audit_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark, sf_dir).where("kind = 'Violation'").select("event_id", "ts", "plugin_id")


@PLANS.query(with_(AUDIT) + "SELECT event_id, kind, allowed, severity FROM audit WHERE plugin_id = 'com.example.p7'")
def audit_by_plugin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark, sf_dir).where("plugin_id = 'com.example.p7'").select("event_id", "kind", "allowed", "severity")


@PLANS.query(with_(AUDIT) + """SELECT count(*) AS total, CAST(count_if(kind = 'PermissionCheck') AS BIGINT) AS permission_checks, CAST(count_if(kind = 'PermissionCheck' AND NOT allowed) AS BIGINT) AS permission_denied,
  CAST(count_if(kind = 'FileAccess') AS BIGINT) AS file_accesses, CAST(count_if(kind = 'FileAccess' AND NOT allowed) AS BIGINT) AS file_denied, CAST(count_if(kind = 'NetworkAccess') AS BIGINT) AS network_accesses, CAST(count_if(kind = 'Violation') AS BIGINT) AS violations FROM audit""")
def audit_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.audit_counts(audit(spark, sf_dir))


@PLANS.query(with_(AUDIT) + """SELECT '[' || string_agg('{"event_id":' || event_id || ',"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || '","kind":"' || kind || '","plugin_id":"' || plugin_id || '","permission":"' || permission
  || '","allowed":' || allowed || ',"severity":"' || severity || '"}', ',' ORDER BY event_id) || ']' AS json FROM (SELECT * FROM audit ORDER BY ts DESC, event_id DESC LIMIT 1000)""")
def audit_export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest thousand entries as one JSON array."""
    return logs.exported_json(audit(spark, sf_dir), 1000, [F.desc("ts"), F.desc("event_id")])


GRANT_ROWS = [(f"com.example.p{i}", kind, arg) for i in range(0, 20, 2) for kind, arg in (("read", f"/data/{i % 10}"), ("network", "*" if i % 4 == 0 else "api.example.com"), ("clipboard", "read"))]
GRANTS = values("grants", "plugin_id, kind, arg", GRANT_ROWS)
REQUESTS = """requests AS (SELECT event_id AS request_id, 'com.example.p' || (user_id % 20) AS plugin_id,
  CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'write' WHEN 'signup' THEN 'network' ELSE 'clipboard' END AS kind,
  CASE event_type WHEN 'view' THEN '/data/' || (user_id % 10) || '/f' WHEN 'click' THEN '/data/' || (event_id % 10) WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'api.example.com' ELSE 'evil.com' END
    ELSE CASE WHEN event_id % 2 = 0 THEN 'read' ELSE 'write' END END AS arg FROM events)"""


@PLANS.query(with_(GRANTS, REQUESTS) + """SELECT request_id, EXISTS (SELECT 1 FROM grants g WHERE g.plugin_id = r.plugin_id AND CASE
  WHEN r.kind IN ('read', 'write') THEN g.kind IN ('read', 'write') AND (r.arg = g.arg OR starts_with(r.arg, g.arg || '/'))
  WHEN r.kind = 'network' THEN g.kind = 'network' AND (g.arg = '*' OR g.arg = r.arg) ELSE g.kind = r.kind AND g.arg = r.arg END) AS allowed FROM requests r""")
def permission_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    of = lambda view, click, signup, other: F.when(F.col("event_type") == "view", view).when(F.col("event_type") == "click", click).when(F.col("event_type") == "signup", signup).otherwise(other)
    number = lambda c: (F.col(c) % 10).cast("string")
    even = F.col("event_id") % 2 == 0
    requests = e.select(
        F.col("event_id").alias("request_id"),
        F.concat(F.lit("com.example.p"), (F.col("user_id") % 20).cast("string")).alias("plugin_id"),
        of(F.lit("read"), F.lit("write"), F.lit("network"), F.lit("clipboard")).alias("kind"),
        of(F.concat(F.lit("/data/"), number("user_id"), F.lit("/f")), F.concat(F.lit("/data/"), number("event_id")), F.when(even, "api.example.com").otherwise("evil.com"), F.when(even, "read").otherwise("write")).alias("arg"),
    )
    return rules.allowed(requests, inline(spark, GRANT_ROWS, "plugin_id string, kind string, arg string")).select("request_id", "allowed")


ID_ROWS = [("com.example.my-plugin",), ("com.github.user.plugin",), ("invalid",), ("com.",), ("",), ("a..b",), ("a.b.",)]
PERMISSION_ROWS = ["network:api.example.com", "filesystem:read:~/Documents", "clipboard:read", "invalid:permission", "system:info", "", "database:write"]


@PLANS.query(with_(values("ids", "id, permission", [(i[0], p) for i, p in zip(ID_ROWS, PERMISSION_ROWS, strict=True)])) + """SELECT id, len(string_split(id, '.')) >= 3 AND len(list_filter(string_split(id, '.'), lambda p: p = '')) = 0 AS valid, permission,
  starts_with(permission, 'network:') OR starts_with(permission, 'filesystem:read:') OR starts_with(permission, 'filesystem:write:') OR permission ^@ 'clipboard:read' OR permission ^@ 'clipboard:write'
  OR permission ^@ 'system:info' OR permission ^@ 'system:execute' OR permission ^@ 'database:read' OR permission ^@ 'database:write' AS valid_permission FROM ids""")
def validate_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inline(spark, [(i[0], p) for i, p in zip(ID_ROWS, PERMISSION_ROWS, strict=True)], "id string, permission string")
    return rows.select("id", rules.valid_id(F.col("id")).alias("valid"), "permission", rules.valid_permission(F.col("permission")).alias("valid_permission"))


# ---- changes -----------------------------------------------------------------------------------------------------


@PLANS.query(with_(CHANGES) + "SELECT seq, (reason & 256) <> 0 AS created, (reason & 512) <> 0 AS deleted, (reason & 4096) <> 0 AS renamed FROM changes WHERE (reason & 4864) <> 0")
def reason_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    on = lambda mask: F.col("reason").bitwiseAND(F.lit(mask)) != 0
    return changes(spark, sf_dir).where(on(0x1300)).select("seq", on(0x100).alias("created"), on(0x200).alias("deleted"), on(0x1000).alias("renamed"))


@PLANS.query(with_(CHANGES) + "SELECT frn, name, seq FROM (SELECT *, row_number() OVER (PARTITION BY frn ORDER BY seq DESC) AS k FROM changes WHERE (reason & 4864) <> 0) WHERE k = 1 AND (reason & 512) = 0")
def cdc_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_state(changes(spark, sf_dir))


# ---- workflows, keywords, the catalogue --------------------------------------------------------------------------

CONDITION = {
    "type": "Or",
    "conditions": [
        {"type": "And", "conditions": [{"type": "VariableEquals", "name": "type", "value": "click"}, {"type": "Not", "condition": {"type": "VariableContains", "name": "k", "substring": "7"}}]},
        {"type": "VariableEquals", "name": "k", "value": "42"},
        {"type": "TimeRange", "start": "22:30", "end": "04:15"},
    ],
}


WORKFLOW = [
    {"id": "name", "action": {"type": "SetVariable", "name": "label", "value": "${type}-${k}"}},
    {"id": "sort", "action": {
        "type": "If", "condition": {"type": "VariableEquals", "name": "type", "value": "purchase"},
        "then_steps": [{"id": "tell", "action": {"type": "ShowNotification", "title": "Sold", "message": "${label} for ${value}"}}],
        "else_steps": [{"id": "mark", "action": {"type": "SetVariable", "name": "label", "value": "other ${label}"}}],
    }},
    {"id": "dots", "action": {
        "type": "Loop", "count": 5, "condition": {"type": "Not", "condition": {"type": "VariableContains", "name": "dots", "substring": "..."}},
        "steps": [{"id": "dot", "action": {"type": "SetVariable", "name": "dots", "value": "${dots}."}}],
    }},
    {"id": "ask", "condition": {"type": "VariableEquals", "name": "type", "value": "error"}, "action": {"type": "PluginQuery", "plugin_id": "p", "query": "q"}, "on_error": {"type": "Fallback", "steps": [
        {"id": "save", "action": {"type": "CopyToClipboard", "content": "${label}${dots}"}}]}},
    {"id": "odd", "condition": {"type": "VariableContains", "name": "k", "substring": "9"}, "action": {"type": "HttpRequest", "method": "PATCH", "url": "x"}},
    {"id": "end", "action": {"type": "SetVariable", "name": "done", "value": "yes"}},
]


@PLANS.query("""SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'purchase-' || k ELSE 'other ' || event_type || '-' || k END AS label, repeat('.', greatest(length(dots), 3)) AS dots,
  NOT contains(k, '9') AS done, CASE WHEN contains(k, '9') THEN 'odd: unsupported method PATCH' END AS error,
  CASE event_type WHEN 'purchase' THEN 'tell: purchase-' || k || ' for ' || v WHEN 'error' THEN 'save: other error-' || k || repeat('.', greatest(length(dots), 3)) END AS effect
  FROM (SELECT event_id, event_type, props->>'$.k' AS k, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS v, repeat('.', CAST(event_id % 5 AS INT)) AS dots FROM events)""")
def workflow_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workflow on every event, with its variables, its effect and the error that ends it."""
    e = table(spark, sf_dir, "events")
    columns = {"type": F.col("event_type"), "k": F.get_json_object("props", "$.k"), "value": F.floor("value").cast("string"), "dots": F.repeat(F.lit("."), (F.col("event_id") % 5).cast("int"))}
    variables = F.create_map(*[x for name, c in columns.items() for x in (F.lit(name), c)])
    run = workflows.executed(e, WORKFLOW, variables)
    effect = F.try_element_at(F.transform("run.effects", lambda x: F.concat(x["step"], F.lit(": "), F.coalesce(x["detail"]["message"], x["detail"]["content"]))), F.lit(1))
    end = F.col("run")["variables"]
    return run.select("event_id", end["label"].alias("label"), end["dots"].alias("dots"), F.coalesce(end["done"] == "yes", F.lit(False)).alias("done"), F.col("run.error").alias("error"), effect.alias("effect"))


@PLANS.query("SELECT event_id, (event_type = 'click' AND NOT contains(props->>'$.k', '7')) OR (props->>'$.k') = '42' OR strftime(ts, '%H:%M') >= '22:30' OR strftime(ts, '%H:%M') <= '04:15' AS holds FROM events")
def workflow_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    variables = F.create_map(F.lit("type"), F.col("event_type"), F.lit("k"), F.get_json_object("props", "$.k"), F.lit("now"), F.date_format("ts", "HH:mm"))
    return table(spark, sf_dir, "events").select("event_id", rules.condition(CONDITION, variables).alias("holds"))


@PLANS.query("SELECT p_partkey AS id, contains('ring', w) OR contains(w, 'ring') OR contains('gear', w) OR contains(w, 'gear') AS matches FROM (SELECT p_partkey, split_part(p_name, ' ', 2) AS w FROM part)")
def keyword_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(F.lit("Ring"), F.lit("gear"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), rules.keyword_any(words, F.element_at(F.split("p_name", " "), 2)).alias("matches"))


TYPED = ["set", "Config", "my settings page", "x", "", "pref", "tting", "nothing", "设", "打开配置"]


@PLANS.query(with_(values("typed", "query", [(x,) for x in TYPED])) + """SELECT query, score FROM (SELECT query, CAST(CASE WHEN query = '' THEN NULL
  WHEN len(list_filter(['settings', 'setting', 'config', 'preferences', '设置', '配置'], lambda k: starts_with(k, lower(query)))) > 0 THEN 100
  WHEN len(list_filter(['settings', 'setting', 'config', 'preferences', '设置', '配置'], lambda k: contains(k, lower(query)) OR contains(lower(query), k))) > 0 THEN 80 END AS BIGINT) AS score FROM typed) WHERE score IS NOT NULL""")
def keyword_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inline(spark, [(x,) for x in TYPED], "query string")
    return rows.select("query", rules.keyword_score(F.col("query")).alias("score")).where("score is not null")


ROUTED = ["bm rust", "his today", "ps chrome", "kill chrome", "git repo", "trans hello", "rust", "tr hello world", "unknown word", "project one", "json {}", "sha256 x", "翻译 hello", "? query"]


@PLANS.query(with_(values("typed", "query", [(x,) for x in ROUTED])) + """SELECT query, coalesce(source, 'all') AS source, CASE WHEN source IS NULL THEN query ELSE trim(substr(query, instr(query, ' ') + 1)) END AS rest FROM (
  SELECT query, CASE WHEN instr(query, ' ') > 0 THEN CASE split_part(query, ' ', 1) WHEN 'bm' THEN 'bookmarks' WHEN 'his' THEN 'history' WHEN 'ps' THEN 'process' WHEN 'kill' THEN 'process' WHEN 'git' THEN 'git' WHEN 'project' THEN 'git' WHEN '翻译' THEN 'translator' WHEN '?' THEN 'web'
    WHEN 'json' THEN 'devtools' WHEN 'base64' THEN 'devtools' WHEN 'md5' THEN 'devtools' WHEN 'hash' THEN 'devtools' WHEN 'sha256' THEN 'devtools' WHEN 'url' THEN 'devtools'
    WHEN 'trans' THEN 'translator' WHEN 'tr' THEN 'translator' END END AS source FROM typed)""")
def trigger_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.routed(inline(spark, [(x,) for x in ROUTED], "query string")).select("query", "source", "rest")


CATALOGUE = "catalogue AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_type AS description, CAST(p_size AS BIGINT) AS downloads, p_retailprice AS rating, CAST(p_size % 4 AS VARCHAR) AS version FROM part)"


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.col("p_size").cast("long").alias("downloads"), F.col("p_retailprice").alias("rating"), (F.col("p_size") % 4).cast("string").alias("version"))


@PLANS.query(with_(CATALOGUE) + "SELECT id, name, downloads FROM catalogue WHERE contains(lower(name), 'red') OR contains(lower(description), 'red') ORDER BY downloads DESC, id LIMIT 20 OFFSET 20")
def catalog_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.catalogue_page(catalogue(spark, sf_dir), "Red", "downloads", 1, 20).select("id", "name", "downloads")


INSTALLED = "installed AS (SELECT CAST(p_partkey AS VARCHAR) AS id, CAST(p_partkey % 4 AS VARCHAR) AS version FROM part WHERE p_partkey % 3 = 0)"


def installed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").where("p_partkey % 3 = 0")
    return p.select(F.col("p_partkey").cast("string").alias("id"), (F.col("p_partkey") % 4).cast("string").alias("version"))


@PLANS.query(with_(CATALOGUE, INSTALLED) + "SELECT i.id, i.version, c.version AS latest FROM installed i JOIN catalogue c ON i.id = c.id WHERE i.version <> c.version")
def updates_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.updates(installed(spark, sf_dir), catalogue(spark, sf_dir))


@PLANS.query(with_(INSTALLED) + "SELECT id, needed FROM (SELECT id, CAST(CAST(id AS BIGINT) + 1 + CAST(id AS BIGINT) % 3 AS VARCHAR) AS needed FROM (SELECT CAST(p_partkey AS VARCHAR) AS id FROM part)) WHERE needed NOT IN (SELECT id FROM installed)")
def missing_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("p_partkey")
    needs = table(spark, sf_dir, "part").select(number.cast("string").alias("id"), (number + 1 + number % 3).cast("string").alias("needed"))
    return rules.missing(needs, installed(spark, sf_dir))
