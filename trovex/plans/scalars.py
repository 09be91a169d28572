"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovex.functions import codecs, numbers
from trovex.functions import text as T
from trovex.operators.rules import substituted
from trovex.plans.registry import Plans
from trovex.sources.entities import inline, table, values, with_

PLANS = Plans()


@PLANS.query("SELECT event_id, md5(props) AS hash FROM events")
def hash_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.md5("props").alias("hash"))


@PLANS.query("SELECT event_id, sha256(props) AS hash FROM events")
def hash_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.sha2("props", 256).alias("hash"))


@PLANS.query("SELECT conv_id, turn, to_base64(encode(text)) AS encoded, text AS decoded FROM conversations")
def base64_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", codecs.to_base64(F.col("text")).alias("encoded"))
    return c.select("conv_id", "turn", "encoded", codecs.from_base64(F.col("encoded")).alias("decoded"))


@PLANS.query("SELECT page_id, url_encode(url || ' a+b*~é') AS encoded, url || ' a+b*~é' AS decoded, url_decode(url) AS plain FROM pages")
def url_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.concat("url", F.lit(" a+b*~é"))
    rows = table(spark, sf_dir, "pages").select("page_id", "url", codecs.url_encoded(own).alias("encoded"))
    return rows.select("page_id", "encoded", codecs.url_decoded(F.col("encoded")).alias("decoded"), codecs.url_decoded(F.col("url")).alias("plain"))


@PLANS.query("""SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped FROM pages""")
def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.html_escaped(F.col("html")).alias("escaped"))


@PLANS.query("SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, 'ok' AS status, CAST(json(props) AS VARCHAR) AS minified FROM events UNION ALL SELECT -1, NULL, 'error', NULL")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "props").union(inline(spark, [(-1, "{broken")], "event_id long, props string"))
    return rows.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), codecs.json_status(F.col("props")).alias("status"), codecs.json_minified(F.col("props")).alias("minified"))


@PLANS.query("SELECT event_id, replace(CAST(json_pretty(props) AS VARCHAR), '    ', '  ') AS pretty FROM events UNION ALL SELECT -1, NULL")
def json_pretty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "props").union(inline(spark, [(-1, "{broken")], "event_id long, props string"))
    return rows.select("event_id", codecs.json_pretty(F.col("props")).alias("pretty"))


UUID4 = "[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}"


@PLANS.query(f"SELECT count(*) AS n, count(DISTINCT id) AS n_distinct, bool_and(regexp_full_match(id, '{UUID4}')) AS sound FROM (SELECT CAST(uuid() AS VARCHAR) AS id FROM events)")
def uuid_v4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random identifiers have no fixed value: how many there are, how many differ, and whether all have the form."""
    ids = table(spark, sf_dir, "events").select(F.uuid().alias("id"))
    return ids.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_distinct"), F.bool_and(F.rlike("id", F.lit(f"^{UUID4}$"))).alias("sound"))


SUMS = ["1+2*3", "10/4", "7", "2*3/4-1", "(1+2)*3", "-5+3", "1/0", "abc", "(4)", "1.5 + 2.25", ""]


LITERALLY = [7.0, 2.5, 7.0, 0.5, None, None, None, None, None, 3.75, None]
EXACTLY = [7.0, 2.5, 7.0, 0.5, 9.0, -2.0, None, None, 4.0, 3.75, None]


@PLANS.query(with_(values("sums", "text, literal, exact", list(zip(SUMS, LITERALLY, EXACTLY, strict=True)))) + """SELECT text, CAST(literal AS DOUBLE) AS literal, CAST(exact AS DOUBLE) AS exact FROM sums
  UNION ALL SELECT k || '*' || CAST(value AS VARCHAR) || '-' || user_id, CAST(k AS DOUBLE) * value - user_id, CAST(k AS DOUBLE) * value - user_id FROM (SELECT props->>'$.k' AS k, value, user_id FROM events)""")
def calc_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The literal rules, by built-in functions, and the usual ones with brackets and signs, which take a parser's step for each row."""
    rows = inline(spark, [(x,) for x in SUMS], "text string")
    e = table(spark, sf_dir, "events").select(F.concat(F.get_json_object("props", "$.k"), F.lit("*"), F.col("value").cast("string"), F.lit("-"), F.col("user_id").cast("string")).alias("text"))
    both = rows.union(e)
    one = numbers.calculated(both).withColumnRenamed("value", "literal")
    return numbers.calculated(one, literal=False).withColumnRenamed("value", "exact")


PLAIN = r"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE regexp_replace(regexp_replace(printf('%.6f', {x}), '0+$', ''), '\.$', '') END"
CONVERTER = r"""CASE WHEN abs({x}) < 0.001 OR abs({x}) > 1000000 THEN regexp_replace(regexp_replace(printf('%.6e', {x}), 'e([+-])0*([0-9])', 'e\1\2'), 'e\+', 'e')
  WHEN {x} = floor({x}) THEN printf('%.0f', {x}) ELSE regexp_replace(regexp_replace(printf('%.4f', {x}), '0+$', ''), '\.$', '') END"""


@PLANS.query(f"SELECT event_id, {PLAIN.format(x='value')} AS plain, {CONVERTER.format(x='v')} AS converted FROM (SELECT event_id, value, CASE event_id % 3 WHEN 0 THEN value * 1e5 WHEN 1 THEN value / 1e5 ELSE value END AS v FROM events)")
def format_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    value, part = F.col("value"), F.col("event_id") % 3
    scaled = F.when(part == 0, value * 1e5).when(part == 1, value / 1e5).otherwise(value)
    return table(spark, sf_dir, "events").select("event_id", numbers.plain_number(value).alias("plain"), numbers.converter_number(scaled).alias("converted"))


BASES = ["0xFF", "0X1a", "0b1011", "0o777", "0x7fffffffffffffff", "0x8000000000000000", "0b2", "0o8", "12", "0x", "0x0"]


@PLANS.query(with_(values("bases", "text, value", list(zip(BASES, [255, 26, 11, 511, 9223372036854775807, None, None, None, None, None, 0], strict=True)))) + """SELECT text, CAST(value AS VARCHAR) AS decimal,
  '0x' || upper(to_hex(CAST(value AS BIGINT))) AS hexadecimal, '0b' || to_binary(CAST(value AS BIGINT)) AS binary FROM bases""")
def base_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inline(spark, [(x,) for x in BASES], "text string").withColumn("value", numbers.base_value(F.col("text")))
    return rows.select("text", numbers.based(F.col("value")).alias("b")).select("text", "b.decimal", "b.hexadecimal", "b.binary")


UNIT_SQL = values("units", "from_unit, to_unit, factor, shift", numbers.UNITS)
INLINE_SQL = values("units", "from_unit, to_unit, factor, shift", numbers.INLINE)
PAIR_SQL = "pairs AS (SELECT DISTINCT (p_size % 7) || '.5 ' || from_unit || ' to ' || to_unit AS text, CAST(p_size % 7 AS DOUBLE) + 0.5 AS value, from_unit, to_unit, CAST(factor AS DOUBLE) AS factor, CAST(shift AS DOUBLE) AS shift FROM part, units)"


@PLANS.query(with_(UNIT_SQL, PAIR_SQL) + "SELECT text, value, from_unit, to_unit, round(value * factor + shift, 6) AS result FROM pairs")
def unit_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "part").select((F.col("p_size") % 7).cast("string").alias("n")).distinct()
    names = F.array(*[F.lit(f".5 {a} to {b}") for a, b, _, _ in numbers.UNITS])
    texts = sizes.select("n", F.explode(names).alias("unit")).select(F.concat("n", "unit").alias("text")).distinct()
    return numbers.conversions(texts).select("text", "value", "from_unit", "to_unit", F.round("result", 6).alias("result"))


@PLANS.query(with_(INLINE_SQL) + "SELECT DISTINCT (p_size % 7) || from_unit AS text, to_unit, round(CAST(p_size % 7 AS DOUBLE) * CAST(factor AS DOUBLE) + CAST(shift AS DOUBLE), 6) AS result FROM part, units")
def unit_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "part").select((F.col("p_size") % 7).cast("string").alias("n")).distinct()
    names = F.array(*map(F.lit, dict.fromkeys(x[0] for x in numbers.INLINE)))
    texts = sizes.select("n", F.explode(names).alias("unit")).select(F.concat("n", "unit").alias("text")).distinct()
    return numbers.inline_conversions(texts).select("text", "to_unit", F.round("result", 6).alias("result"))


# The dictionary's entries.
DICTIONARY = [("hello", "你好"), ("world", "世界"), ("computer", "计算机"), ("program", "程序"), ("code", "代码"), ("plugin", "插件"), ("search", "搜索"), ("file", "文件"), ("folder", "文件夹"), ("error", "错误"), ("success", "成功")]


@PLANS.query(with_(values("dictionary", "word, translation", DICTIONARY)) + "SELECT event_id, event_type, translation FROM events JOIN dictionary ON lower(event_type) = word")
def dictionary_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.broadcast(inline(spark, DICTIONARY, "word string, translation string"))  # as many rows as DICTIONARY has
    e = table(spark, sf_dir, "events")
    return e.join(words, F.lower("event_type") == F.col("word")).select("event_id", "event_type", "translation")


@PLANS.query("SELECT doc_id, regexp_matches(text, '[一-鿿]') AS chinese FROM documents UNION ALL SELECT -1, true")
def detect_cjk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").union(inline(spark, [(-1, "a中b")], "doc_id long, text string"))
    return rows.select("doc_id", F.rlike("text", F.lit("[一-鿿]")).alias("chinese"))


INPUTS = ["1+2", "0xFF", "0b101", "0o17", "5km", "3.5 GB", "hello", "10 km to miles", "(1)", "0xZZ"]


@PLANS.query(with_(values("inputs", "text", [(x,) for x in INPUTS])) + r"""SELECT text, CASE WHEN regexp_full_match(text, '0[xX][0-9a-fA-F]+') THEN 'hexadecimal' WHEN regexp_full_match(text, '0[bB][01]+') THEN 'binary'
  WHEN regexp_full_match(text, '0[oO][0-7]+') THEN 'octal' WHEN regexp_full_match(text, '[0-9.]+\s*[a-zA-Z]+') THEN 'unit' WHEN regexp_full_match(text, '[0-9+\-*/().\s]+') THEN 'sum' ELSE 'none' END AS kind FROM inputs""")
def regex_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    is_ = lambda p: F.rlike(text, F.lit(p))
    kind = F.when(is_("^0[xX][0-9a-fA-F]+$"), "hexadecimal").when(is_("^0[bB][01]+$"), "binary").when(is_("^0[oO][0-7]+$"), "octal").when(is_(r"^[\d.]+\s*[a-zA-Z]+$"), "unit").when(is_(r"^[\d+\-*/().\s]+$"), "sum").otherwise("none")
    return inline(spark, [(x,) for x in INPUTS], "text string").select("text", kind.alias("kind"))


# Keyword, name and address of search engines, in order.
ENGINES = [
    (0, "g", "Google", "https://www.google.com/search?q={query}"), (1, "b", "Bing", "https://www.bing.com/search?q={query}"), (2, "bd", "Baidu", "https://www.baidu.com/s?wd={query}"),
    (3, "gh", "GitHub", "https://github.com/search?q={query}"), (4, "so", "Stack Overflow", "https://stackoverflow.com/search?q={query}"), (5, "yt", "YouTube", "https://www.youtube.com/results?search_query={query}"),
    (6, "wiki", "Wikipedia", "https://en.wikipedia.org/wiki/Special:Search?search={query}"), (7, "tb", "淘宝", "https://s.taobao.com/search?q={query}"), (8, "zh", "知乎", "https://www.zhihu.com/search?q={query}"),
]


@PLANS.query(with_(values("engines", "place, keyword, name, template", ENGINES)) + "SELECT place, 90 - place AS score, replace(template, '{query}', url_encode('rust lang')) AS url FROM engines")
def engine_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inline(spark, ENGINES, "place int, keyword string, name string, template string")
    url = F.replace("template", F.lit("{query}"), codecs.url_encoded(F.lit("rust lang")))
    return rows.select("place", (90 - F.col("place")).alias("score"), url.alias("url"))


@PLANS.query("SELECT event_id, 'https://example.com/' || event_type || '?k=' || (props->>'$.k') || '&u=${missing}' AS url FROM events")
def template_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    variables = F.create_map(F.lit("type"), F.col("event_type"), F.lit("k"), F.get_json_object("props", "$.k"), F.lit("missing"), F.lit(None).cast("string"))
    return e.select("event_id", substituted(F.lit("https://example.com/${type}?k=${k}&u=${missing}"), variables, ["type", "k", "missing"]).alias("url"))
