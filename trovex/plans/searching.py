"""Queries of the index, of files, and of the ranked search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trovex.functions import text as T
from trovex.operators import bitmaps, hierarchy, index, logs, ranking, rules, usage
from trovex.plans.registry import Plans
from trovex.sources.entities import BROWSING, CHANGES, CLICKS, EDGES, FILES, NOW_SQL, browsing, changes, clicks, edges, files, now, table, with_
from trovex.sources.shared import scratch
from trovex.streaming import cdc

PLANS = Plans()
QUERY = "small"
GRAMS = "gram_rows AS (SELECT DISTINCT file_id, substr(lower(name), CAST(i AS INT), 3) AS gram FROM (SELECT file_id, name, unnest(range(1, length(name) - 1)) AS i FROM files WHERE length(name) >= 3))"


def split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The files of the base and of the delta."""
    f = files(spark, sf_dir)
    return f.where("file_id % 10 < 8"), f.where("file_id % 10 >= 8")


@PLANS.query(with_(FILES) + "SELECT file_id, path FROM files WHERE file_id IN (SELECT o_custkey FROM orders)")
def path_lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file_id"))
    return index.lookup(files(spark, sf_dir), wanted).select("file_id", "path")


@PLANS.query(with_(FILES, GRAMS) + "SELECT file_id, gram FROM gram_rows")
def trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("file_id", F.explode(T.trigrams(F.col("name"))).alias("gram"))


@PLANS.query(with_(FILES, GRAMS) + "SELECT gram, count(*) AS n_files, min(file_id) AS first_id, max(file_id) AS last_id FROM gram_rows GROUP BY gram")
def gram_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = index.postings(files(spark, sf_dir))
    return posts.groupBy("gram").agg(F.count(F.lit(1)).alias("n_files"), F.min("file_id").alias("first_id"), F.max("file_id").alias("last_id"))


@PLANS.query(with_(FILES, GRAMS) + "SELECT gram, count(*) AS n_files FROM gram_rows GROUP BY gram")
def gram_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.posting_counts(index.postings(files(spark, sf_dir)))


AND_SQL = """hits AS (SELECT file_id FROM {rows} WHERE gram IN ('sma', 'mal', 'all') GROUP BY file_id HAVING count(DISTINCT gram) = 3)"""


@PLANS.query(with_(FILES, GRAMS, AND_SQL.format(rows="gram_rows")) + "SELECT f.file_id, name FROM files f JOIN hits h ON f.file_id = h.file_id")
def trigram_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search without an index reads the names once; stored_index_search has an index, bitmap_and one of bitmaps."""
    return index.scan_and(files(spark, sf_dir), QUERY).select("file_id", "name")


@PLANS.query(with_(FILES, GRAMS, AND_SQL.format(rows="gram_rows")) + "SELECT f.file_id, name FROM files f JOIN hits h ON f.file_id = h.file_id WHERE contains(lower(name), 'small')")
def stored_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the index once, sorted by gram, and searches what is stored: only row groups with the query's grams are read."""
    f, path = files(spark, sf_dir), scratch(spark, "index")
    index.write_index(index.postings(f), path)
    return index.search_exact(f, index.read_index(spark, path), QUERY).select("file_id", "name")


ICON_SQL = r"""CASE WHEN e IN ('txt', 'md', 'log') THEN '📄' WHEN e = 'pdf' THEN '📕' WHEN e IN ('doc', 'docx') THEN '📘' WHEN e IN ('xls', 'xlsx', 'ppt', 'pptx') THEN '📊'
  WHEN e IN ('zip', 'rar', '7z') THEN '📦' WHEN e IN ('jpg', 'jpeg', 'png', 'gif', 'bmp') THEN '🖼️' WHEN e IN ('mp3', 'wav', 'flac') THEN '🎵' WHEN e IN ('mp4', 'avi', 'mkv') THEN '🎬'
  WHEN e IN ('exe', 'msi') THEN '⚙️' WHEN e IN ('js', 'ts', 'py', 'rs', 'go', 'java') THEN '💻' ELSE '📄' END"""


@PLANS.query(with_(FILES) + rf"SELECT file_id, {ICON_SQL} AS icon FROM (SELECT file_id, regexp_extract(lower(name), '\.([^.]+)$', 1) AS e FROM files)")
def icon_by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("file_id", rules.icon(F.col("name")).alias("icon"))


@PLANS.query(with_(FILES) + "SELECT file_id, name FROM (SELECT file_id, name, path FROM files ORDER BY path, file_id LIMIT 20) ORDER BY lower(name), file_id")
def take20_then_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty by path, in the order of their titles."""
    return files(spark, sf_dir).orderBy("path", "file_id").limit(20).orderBy(F.lower("name"), "file_id").select("file_id", "name")


@PLANS.query(with_(FILES) + """SELECT drive, size_mb, estimated_files, count(*) OVER () AS drives, CAST(sum(estimated_files) OVER () AS BIGINT) AS total_files FROM (
  SELECT drive, CAST(sum(size * 1000) // 1048576 AS BIGINT) AS size_mb, CAST(sum(size * 1000) // 100 AS BIGINT) AS estimated_files FROM files GROUP BY drive)""")
def status_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.drive_status(files(spark, sf_dir).select("drive", (F.col("size") * 1000).alias("bytes")))


@PLANS.query(with_(FILES, GRAMS, AND_SQL.format(rows="gram_rows")) + "SELECT file_id FROM hits WHERE file_id % 10 < 8 OR file_id % 20 <> 9")
def trigram_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, delta = split(spark, sf_dir)
    removed = files(spark, sf_dir).where("file_id % 20 = 9").select("file_id")
    posts = index.with_delta(index.postings(base), index.postings(delta).join(removed, "file_id", "left_anti"))
    return index.search_and(posts, QUERY)


@PLANS.query(with_(FILES, GRAMS) + "SELECT gram, count(*) AS n_files FROM gram_rows WHERE file_id % 20 <> 3 GROUP BY gram")
def delta_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, delta = split(spark, sf_dir)
    removed = files(spark, sf_dir).where("file_id % 20 = 3").select("file_id")
    return index.posting_counts(index.with_delta(index.postings(base), index.postings(delta), removed))


@PLANS.query(with_(FILES, GRAMS, AND_SQL.format(rows="gram_rows")) + "SELECT file_id FROM hits")
def bitmap_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = bitmaps.bitmap_postings(index.postings(files(spark, sf_dir)))
    return bitmaps.file_ids(bitmaps.search_and(maps, index.query_grams(QUERY)))


@PLANS.query(with_(FILES, GRAMS) + "SELECT DISTINCT file_id FROM gram_rows WHERE gram IN ('bol', 'olt', 'nut')")
def bitmap_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = bitmaps.bitmap_postings(index.postings(files(spark, sf_dir)))
    return bitmaps.file_ids(bitmaps.search_or(maps, ["bol", "olt", "nut"]))


@PLANS.query(with_(FILES, GRAMS) + "SELECT gram, count(*) AS n_files FROM gram_rows WHERE file_id % 20 <> 3 GROUP BY gram")
def bitmap_delta_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """delta_merge on bitmaps: base and delta are joined bucket by bucket, and the removed files are bitmaps, too."""
    base, delta = (bitmaps.bitmap_postings(index.postings(x)) for x in split(spark, sf_dir))
    removed = bitmaps.bitmap_postings(index.postings(files(spark, sf_dir).where("file_id % 20 = 3")))
    return bitmaps.posting_counts(bitmaps.with_delta(base, delta), removed)


@PLANS.query(with_(CHANGES) + """SELECT frn, name FROM (SELECT *, row_number() OVER (PARTITION BY frn ORDER BY seq DESC) AS k FROM changes WHERE (reason & 4864) <> 0)
  WHERE k = 1 AND (reason & 512) = 0 AND contains(lower(name), 'up_') AND contains(lower(name), 'p_1')""")
def journal_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The journal in four micro-batches, with a merge after the second, searched by what base index and later postings hold."""
    journal, at = changes(spark, sf_dir), scratch(spark, "journal")
    last = journal.agg(F.max("seq")).first()[0] or 0
    for number in range(4):
        cdc.append_changes(journal.where((F.col("seq") * 4 / (last + 1)).cast("int") == number), at, number)
        if number == 1:
            cdc.compact(spark, at)
    return cdc.search(spark, at, "UP_1")


@PLANS.query(with_(FILES) + "SELECT file_id, name FROM files WHERE contains(lower(name), 'bolt')")
def filter_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).where(T.contains(F.col("name"), "BOLT")).select("file_id", "name")


@PLANS.query(with_(FILES) + r"SELECT file_id, path FROM files WHERE ends_with(lower(path), 'bolt.txt')")
def suffix_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).where(F.endswith(F.lower("path"), F.lit("bolt.txt"))).select("file_id", "path")


@PLANS.query(with_(FILES) + r"SELECT file_id, path FROM files WHERE NOT (contains(path, 'PROMO') OR contains(path, '$'))")
def ignore_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).where(~rules.ignored(F.col("path"), ["PROMO", "$"])).select("file_id", "path")


@PLANS.query(with_(FILES) + r"""SELECT file_id, CAST(CASE WHEN regexp_matches(path, '\.exe$') THEN 100 WHEN regexp_matches(path, '\.lnk$') THEN 90
  WHEN regexp_matches(path, '\.(bat|cmd)$') THEN 80 WHEN contains(path, 'Program Files') OR contains(path, 'Windows') THEN 70 ELSE 50 END AS BIGINT) AS priority FROM files""")
def path_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("file_id", rules.path_priority(F.col("path")).alias("priority"))


@PLANS.query(with_(FILES) + r"""SELECT file_id, CASE regexp_extract(lower(path), '\.([^.\\/]+)$', 1) WHEN 'txt' THEN 'text' WHEN 'log' THEN 'text' WHEN 'csv' THEN 'text'
  WHEN 'md' THEN 'markdown' WHEN 'markdown' THEN 'markdown' WHEN 'json' THEN 'json' WHEN 'png' THEN 'image' WHEN 'py' THEN 'code' ELSE 'binary' END AS file_type FROM files""")
def file_type_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("file_id", rules.file_type(F.col("path")).alias("file_type"))


@PLANS.query(with_(FILES) + r"SELECT file_id, name AS base_name FROM files")
def basename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("file_id", T.basename(F.col("path")).alias("base_name"))


@PLANS.query(with_(FILES) + r"SELECT DISTINCT regexp_extract(path, '^(.*)\\[^\\]*$', 1) AS parent FROM files")
def distinct_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select(T.parent(F.col("path")).alias("parent")).distinct()


@PLANS.query(with_(FILES) + "SELECT lower(substr(name, 1, 1)) AS first_char, count(*) AS n_files, min(file_id) AS first_id FROM files GROUP BY 1")
def first_char_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).groupBy(F.lower(F.substring("name", 1, 1)).alias("first_char")).agg(F.count(F.lit(1)).alias("n_files"), F.min("file_id").alias("first_id"))


POSITION = "CAST(CASE WHEN instr(lower(name), 'bolt') = 1 THEN 100 WHEN instr(lower(name), 'bolt') > 1 THEN 80 - strlen(substr(lower(name), 1, instr(lower(name), 'bolt') - 1)) END AS BIGINT)"


@PLANS.query(with_(FILES) + f"SELECT file_id, name, {POSITION} AS score FROM files WHERE contains(lower(name), 'bolt')")
def position_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("file_id", "name", T.position_score(F.col("name"), F.lit("bolt")).alias("score")).where("score is not null")


@PLANS.query(with_(FILES) + f"SELECT * FROM (SELECT file_id, name, {POSITION} AS score FROM files WHERE contains(lower(name), 'bolt') ORDER BY file_id LIMIT 50) ORDER BY score DESC, file_id")
def first50_then_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 matches in the order of the scan, then by score: not the best 50."""
    return position_score(spark, sf_dir).orderBy("file_id").limit(50).orderBy(F.desc("score"), "file_id")


@PLANS.query(with_(FILES) + """SELECT drive, file_id, name FROM (SELECT drive, file_id, name, row_number() OVER (PARTITION BY drive ORDER BY file_id) AS k
  FROM files WHERE contains(lower(name), 'e')) WHERE k <= 20 ORDER BY drive, file_id LIMIT 50""")
def per_drive_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 a drive and 50 in all; each task cuts its drives to 20 before the shuffle, so no drive's matches meet in one task."""
    hits = files(spark, sf_dir).where(T.contains(F.col("name"), "e")).select("drive", "file_id", "name")
    ranked = hits.withColumn("k", F.row_number().over(W.partitionBy("drive").orderBy("file_id")))
    return ranked.where("k <= 20").drop("k").orderBy("drive", "file_id").limit(50)


FUZZY = """list_reduce(list_prepend({{'c': '', 'at': 1, 'near': false, 'score': 0, 'first': true}}, list_transform(string_split(lower({t}), ''), lambda c: {{'c': c, 'at': 1, 'near': false, 'score': 0, 'first': true}})),
  lambda s, x: CASE WHEN s['at'] <= {n} AND substr('{q}', s['at'], 1) = x['c']
    THEN {{'c': '', 'at': s['at'] + 1, 'near': true, 'score': s['score'] + 16 + CASE WHEN s['near'] THEN 8 ELSE 0 END + CASE WHEN s['first'] THEN 24 ELSE 0 END, 'first': false}}
    ELSE {{'c': '', 'at': s['at'], 'near': false, 'score': s['score'], 'first': false}} END)"""


def fuzzy_sql(t: str, q: str) -> str:
    return FUZZY.format(t=t, q=q, n=len(q))


@PLANS.query(with_(FILES) + f"SELECT file_id, name, CAST(r['score'] AS BIGINT) AS score FROM (SELECT file_id, name, {fuzzy_sql('name', 'sbt')} AS r FROM files WHERE length(name) > 0) WHERE r['at'] > 3 ORDER BY score DESC, file_id LIMIT 10")
def app_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = files(spark, sf_dir).where(T.subsequence(F.col("name"), "sbt"))
    return hits.select("file_id", "name", T.fuzzy_score(F.col("name"), F.lit("sbt")).cast("long").alias("score")).orderBy(F.desc("score"), "file_id").limit(10)


BEST = "CASE WHEN r['at'] > {n} THEN r['score'] ELSE 0 END"


@PLANS.query(with_(FILES) + f"""SELECT file_id, name, CAST(score AS BIGINT) AS score FROM (SELECT file_id, name, greatest(a, b) AS score FROM (
  SELECT file_id, name, (SELECT {BEST.format(n=4)} FROM (SELECT {fuzzy_sql('name', 'bolt')} AS r)) AS a, (SELECT {BEST.format(n=4)} FROM (SELECT {fuzzy_sql('path', 'bolt')} AS r)) AS b FROM files))
  WHERE score > 20 ORDER BY score DESC, file_id LIMIT 20""")
def score_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as processes: the better match score of name and path; of those above 20 the first twenty."""
    score = F.greatest(*[T.fuzzy_score(F.col(c), F.lit("bolt")) for c in ("name", "path")]).cast("long")
    return files(spark, sf_dir).select("file_id", "name", score.alias("score")).where("score > 20").orderBy(F.desc("score"), "file_id").limit(20)


@PLANS.query(with_(FILES) + "SELECT file_id, regexp_matches(lower(name), 's.*b.*t') AS matches FROM files")
def subsequence_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("file_id", T.subsequence(F.col("name"), "sbt").alias("matches"))


INITIALS = "array_to_string(list_transform(list_filter(regexp_split_to_array(lower({t}), '\\s+'), lambda w: w <> ''), lambda w: substr(w, 1, 1)), '')"


def initials_sql(t: str, q: str) -> str:
    i = INITIALS.format(t=t)
    return f"(len(list_filter(regexp_split_to_array(lower({t}), '\\s+'), lambda w: w <> '')) >= {len(q.encode())} AND starts_with({i}, '{q}'))"


@PLANS.query(with_(FILES) + f"SELECT file_id, {INITIALS.format(t='name')} AS initials, {initials_sql('name', 'sb')} AS matches FROM files")
def initials_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("file_id", T.initials(F.col("name")).alias("initials"), T.initials_match(F.col("name"), F.lit("sb")).alias("matches"))


def continuity_sql(t: str, q: str) -> str:
    return f"""(list_reduce(list_prepend({{'c': '', 'at': 1, 'run': 0, 'best': 0}}, list_transform(string_split(lower({t}), ''), lambda c: {{'c': c, 'at': 1, 'run': 0, 'best': 0}})),
  lambda s, x: CASE WHEN s['at'] <= {len(q)} AND substr('{q}', s['at'], 1) = x['c']
    THEN {{'c': '', 'at': s['at'] + 1, 'run': s['run'] + 1, 'best': greatest(s['best'], s['run'] + 1)}}
    ELSE {{'c': '', 'at': s['at'], 'run': 0, 'best': s['best']}} END)['best'] / {float(len(q.encode()))})"""


@PLANS.query(with_(FILES) + f"SELECT file_id, round({continuity_sql('name', 'smbolt')}, 6) AS continuity FROM files")
def continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("file_id", F.round(T.continuity(F.col("name"), F.lit("smbolt")), 6).alias("continuity"))


@PLANS.query(with_(FILES) + """SELECT file_id, CAST(CASE WHEN lower(name) = 'red' THEN 1000 WHEN starts_with(lower(name), 'red') THEN 800 WHEN contains(lower(name), 'red') THEN 600
  WHEN starts_with(brand, 'red') THEN 500 WHEN starts_with(lower(kind), 'red') THEN 400 WHEN contains(brand, 'red') THEN 300 WHEN contains(lower(kind), 'red') THEN 200 ELSE 0 END AS BIGINT) AS tier FROM files""")
def match_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transcriptions are columns of the table: here the folders of a path."""
    f = files(spark, sf_dir)
    folders = F.split("path", r"\\")
    return f.select("file_id", T.match_tier(F.col("name"), folders[1], F.lower(folders[2]), F.lit("red")).alias("tier"))


@PLANS.query(with_(FILES) + """SELECT file_id, substr(name, 1, instr(lower(name), 'bolt') - 1) AS before, substr(name, instr(lower(name), 'bolt'), 4) AS match,
  substr(name, instr(lower(name), 'bolt') + 4) AS after FROM files WHERE contains(lower(name), 'bolt')""")
def highlight_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).select("file_id", T.highlight(F.col("name"), F.lit("Bolt")).alias("span")).where("span is not null")
    return rows.select("file_id", "span.before", "span.match", "span.after")


@PLANS.query("WITH RECURSIVE " + EDGES + r""", walk(frn, path, depth) AS (SELECT frn, name, 1 FROM edges WHERE parent_frn = 0
  UNION ALL SELECT e.frn, w.path || '\' || e.name, depth + 1 FROM edges e JOIN walk w ON e.parent_frn = w.frn WHERE depth < 50) SELECT frn, path, depth FROM walk""")
def path_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.paths(edges(spark, sf_dir))


TREE = """trees AS (SELECT page_id, '{"type":"folder","name":"F' || (page_id % 10) || '","children":[{"type":"url","name":"Page ' || page_id || '","url":"' || url || '"},'
  || '{"type":"folder","name":"Sub","children":[{"type":"url","name":"Copy ' || page_id || '","url":"' || url || '"}]}]}' AS tree FROM pages)"""


@PLANS.query("WITH RECURSIVE " + TREE + """, walk(page_id, n, folder) AS (SELECT page_id, CAST(tree AS JSON), '' FROM trees
  UNION ALL SELECT page_id, unnest(CAST(n->'$.children' AS JSON[])), CASE WHEN folder = '' THEN n->>'$.name' ELSE folder || '/' || (n->>'$.name') END FROM walk WHERE json_exists(n, '$.children'))
  SELECT page_id, n->>'$.name' AS title, n->>'$.url' AS url, folder FROM walk WHERE json_exists(n, '$.url')""")
def tree_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, number = table(spark, sf_dir, "pages"), F.col("page_id").cast("string")
    leaf = lambda word: F.concat(F.lit('{"type":"url","name":"' + word + " "), number, F.lit('","url":"'), "url", F.lit('"}'))
    tree = F.concat(F.lit('{"type":"folder","name":"F'), (F.col("page_id") % 10).cast("string"), F.lit('","children":['), leaf("Page"), F.lit(',{"type":"folder","name":"Sub","children":['), leaf("Copy"), F.lit("]}]}"))
    return hierarchy.flattened(p.select("page_id", tree.alias("tree")), "page_id", "tree")


# ---- the ranked search -------------------------------------------------------------------------------------------

RANKED = "in"


def sources(spark: SparkSession, sf_dir: str) -> ranking.Sources:
    """Files, visited pages and users, as sources of one search."""

    def of_files(query: str) -> DataFrame:
        f = files(spark, sf_dir).where(T.contains(F.col("name"), query))
        return f.select(F.col("file_id").cast("string").alias("id"), F.col("name").alias("title"), F.col("path").alias("subtitle"), rules.path_priority(F.col("path")).alias("score"), F.lit("file-search").alias("plugin_id"))

    def of_pages(query: str) -> DataFrame:
        p = browsing(spark, sf_dir).where(T.contains(F.col("url"), query))
        return p.select(F.col("page_id").cast("string").alias("id"), "title", F.col("url").alias("subtitle"), F.floor(F.col("visit_count") / 10).cast("long").alias("score"), F.lit("browser-history").alias("plugin_id"))

    def of_customers(query: str) -> DataFrame:
        c = table(spark, sf_dir, "customer").where(T.contains(F.col("c_mktsegment"), query))
        return c.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("subtitle"), F.lit(10).cast("long").alias("score"), F.lit("app-search").alias("plugin_id"))

    out = ranking.Sources()
    out.register("file-search", of_files)
    out.register("browser-history", of_pages)
    out.register("app-search", of_customers)
    return out


UNION = f"""results AS (
  SELECT CAST(file_id AS VARCHAR) AS id, name AS title, path AS subtitle, CAST(CASE WHEN ends_with(path, '.exe') THEN 100 WHEN ends_with(path, '.lnk') THEN 90 WHEN ends_with(path, '.bat') THEN 80 ELSE 50 END AS BIGINT) AS score, 'file-search' AS plugin_id
  FROM files WHERE contains(lower(name), '{RANKED}')
  UNION ALL SELECT CAST(page_id AS VARCHAR), title, url, visit_count // 10, 'browser-history' FROM browsing WHERE contains(lower(url), '{RANKED}')
  UNION ALL SELECT CAST(c_custkey AS VARCHAR), c_name, c_mktsegment, 10, 'app-search' FROM customer WHERE contains(lower(c_mktsegment), '{RANKED}'))"""
USAGE = """usage AS (SELECT result_id AS id, count, last_used FROM (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY last_used DESC, plugin_id DESC) AS k
  FROM (SELECT result_id, plugin_id, count(*) AS count, max(ts) AS last_used FROM clicks GROUP BY ALL)) WHERE k = 1)"""
RUNS = "runs AS (SELECT result_id AS id FROM (SELECT result_id, plugin_id, max(ts) AS last FROM clicks GROUP BY ALL ORDER BY last DESC, result_id, plugin_id LIMIT 50) GROUP BY 1)"
JOINED = """joined AS (SELECT r.*, coalesce(u.count, 0) AS count, CASE WHEN m.id IS NOT NULL THEN u.last_used END AS last_used, m.id IS NOT NULL AS is_run
  FROM results r LEFT JOIN usage u ON r.id = u.id LEFT JOIN runs m ON r.id = m.id)"""
SEARCH = (FILES, BROWSING, CLICKS, UNION, USAGE, RUNS, JOINED)


@PLANS.query(with_(FILES, BROWSING, UNION) + "SELECT id, title, subtitle, score, plugin_id FROM results")
def federated_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources(spark, sf_dir).search(RANKED)


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One aggregate of the log by (result_id, plugin_id) gives the counters and, by their last uses, the last runs."""
    counts = usage.counters(clicks(spark, sf_dir), "result_id", "plugin_id")
    runs = counts.orderBy(F.desc("last_used"), "result_id", "plugin_id").limit(50).select(F.col("result_id").alias("id"))
    return ranking.with_usage(sources(spark, sf_dir).search(RANKED), ranking.by_id(counts), runs)


@PLANS.query(with_(*SEARCH) + "SELECT id, plugin_id, count FROM joined")
def rank_join_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(spark, sf_dir).select("id", "plugin_id", "count")


@PLANS.query(with_(*SEARCH) + "SELECT id, plugin_id, is_run FROM joined")
def rank_mru_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(spark, sf_dir).select("id", "plugin_id", "is_run")


@PLANS.query(with_(*SEARCH) + "SELECT id, plugin_id, last_used FROM joined WHERE last_used IS NOT NULL")
def rank_last_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(spark, sf_dir).where("last_used is not null").select("id", "plugin_id", "last_used")


TEXT_SCORE = f"""least(100.0, CASE WHEN lower(title) = '{RANKED}' THEN 100 WHEN starts_with(lower(title), '{RANKED}') THEN 80 WHEN contains(lower(title), '{RANKED}') THEN 60 ELSE 0 END
  + CASE WHEN contains(lower(subtitle), '{RANKED}') THEN 20 ELSE 0 END + CASE WHEN {initials_sql('title', RANKED)} THEN 40 ELSE 0 END
  + {continuity_sql('title', RANKED)} * 30.0 + CAST(score AS DOUBLE) * CAST(0.1 AS DOUBLE))"""
RECENCY = """CASE WHEN {t} IS NULL THEN NULL WHEN {now} - {t} < INTERVAL 5 MINUTE THEN 100.0 WHEN {now} - {t} < INTERVAL 1 HOUR THEN 80.0 WHEN {now} - {t} < INTERVAL 24 HOUR THEN 60.0
  WHEN {now} - {t} < INTERVAL 168 HOUR THEN 40.0 WHEN {now} - {t} < INTERVAL 720 HOUR THEN 20.0 ELSE 10.0 END"""
KIND = """CASE WHEN plugin_id = 'file-search' THEN CASE WHEN ends_with(subtitle, '.exe') THEN 30.0 WHEN ends_with(subtitle, '.lnk') THEN 25.0 ELSE 15.0 END
  WHEN plugin_id = 'app-search' THEN 40.0 WHEN plugin_id = 'browser-history' THEN 10.0 ELSE 15.0 END"""


@PLANS.query(with_(*SEARCH) + f"""SELECT id, title, plugin_id, CAST(trunc(CAST({TEXT_SCORE} AS DOUBLE) + CAST(CASE WHEN count = 0 THEN 0.0 ELSE least(100.0, log10(count + 1.0) * 50.0) END AS DOUBLE) * 2.0
  + CAST(coalesce({RECENCY.format(t='last_used', now=NOW_SQL)}, 0.0) AS DOUBLE) * 1.5 + {KIND} * 0.5 + CASE WHEN is_run THEN 300.0 ELSE 0.0 END) AS BIGINT) AS rank_score
  FROM joined ORDER BY rank_score DESC, title, plugin_id, id LIMIT 100""")
def rank_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred results of a search; a top-k, so no task sorts them all."""
    rows = ranking.ranked(joined(spark, sf_dir), RANKED, now())
    return rows.orderBy(F.desc("rank_score"), "title", "plugin_id", "id").limit(100).select("id", "title", "plugin_id", "rank_score")
