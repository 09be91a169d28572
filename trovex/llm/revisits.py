"""Not-modified revisits of a web crawl, resolved to the full response that they confirm.

A revisit joins as of its time to the latest earlier full response of its canonical URL.  Validators then decide: entity
tags by weak comparison where both have one, else Last-Modified, else the digest of the body; agreement resolves the
revisit, disagreement leaves it a mismatch, and where neither side names the same validator it is unchecked.  A revisit
without an earlier response is an orphan.  A resolved revisit has the headers of its response, with those that a
not-modified answer may update taken from the revisit.

Records are dealt to parts of about equal numbers by ranges of (ts, record_id), so a burst, or one moment with many
records, is cut as well.  Each URL's records are ordered in each part by themselves; what a part ends with is carried to
the later parts in a small table.  So a URL with a third of all records is many tasks.

Earlier means a smaller ts or, at the same ts, a smaller record_id.  Records without a url, ts or record_id resolve
with nothing.  Null headers count as none; names of headers are lower case.  Very long headers and urls are kept whole.
Repeated rows resolve alike.  Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trovex.llm.common import stored

#: Records of one part, about.
PART = 20_000
# What RFC 9110 has a 304 response send, as the response that it stands for would; and usual trackers.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
TRACKERS = r"^(utm_[a-z]+|gclid|fbclid|ref)(=|$)"


def canonical(url: Column) -> Column:
    """Without scheme, user, default port, leading www., fragment, trackers and last slash; host in lower case, parameters sorted."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"#.*$", "")
    site = F.regexp_replace(rest, r"[/?].*$", "")
    tail = F.substr(rest, F.length(site) + 1)
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(site), r"^[^@]*@", ""), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(tail, r"\?.*$", ""), r"/+$", "")
    query = F.when(F.instr(tail, "?") > 0, F.substr(tail, F.instr(tail, "?") + 1)).otherwise(F.lit(""))
    kept = F.array_join(F.sort_array(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.rlike(p, F.lit(TRACKERS)))), "&")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def weak(tag: Column) -> Column:
    return F.regexp_replace(tag, r"^W/", "")


def resolved(records: DataFrame) -> DataFrame:
    """(record_id, canonical_url, ts, refers_to, state, headers, digest) of every revisit.

    records: record_id, url, ts (long), kind ('response' or 'revisit'), headers (map), digest (of the body).
    """
    own = F.coalesce("headers", F.create_map().cast("map<string,string>"))
    rows = records.select("record_id", canonical(F.col("url")).alias("canonical_url"), F.col("ts").cast("long"), "kind", own.alias("headers"), "digest")
    parts = max(1, -(-rows.count() // PART))
    ranges = rows.repartitionByRange(parts, "ts", "record_id").withColumn("part", F.spark_partition_id().cast("long"))
    rows = stored(ranges, "records")  # a part is where a row was, so it is kept
    order = F.struct("ts", "record_id")
    full = F.when(F.col("kind") == "response", F.struct(F.col("ts").alias("full_ts"), F.col("record_id").alias("refers_to"), F.col("headers").alias("full_headers"), F.col("digest").alias("full_digest")))
    earlier = W.partitionBy("canonical_url", "part").orderBy("ts", "record_id").rowsBetween(W.unboundedPreceding, -1)
    near = rows.withColumn("near", F.last(full, ignorenulls=True).over(earlier)).where("kind = 'revisit'")
    ends = rows.where("kind = 'response' and ts is not null and record_id is not null").groupBy("canonical_url", "part").agg(F.max_by(full, order).alias("end"))
    needed = near.where("near is null").select("canonical_url", "part").distinct()
    before = W.partitionBy("canonical_url").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    both = needed.join(ends, ["canonical_url", "part"], "full_outer")
    carried = both.select("canonical_url", "part", F.last("end", ignorenulls=True).over(before).alias("far"))
    joined = near.join(carried, ["canonical_url", "part"], "left")
    sound = F.col("ts").isNotNull() & F.col("record_id").isNotNull() & F.col("canonical_url").isNotNull()
    joined = joined.withColumn("full", F.when(sound, F.coalesce("near", "far"))).select("record_id", "canonical_url", "ts", "headers", "digest", "full.*")
    a, b = F.col("headers"), F.col("full_headers")
    checks = F.coalesce(weak(a["etag"]) == weak(b["etag"]), a["last-modified"] == b["last-modified"], F.col("digest") == F.col("full_digest"))
    state = F.when(F.col("refers_to").isNull(), "orphan").when(checks.isNull(), "unchecked").when(checks, "resolved").otherwise("mismatch")
    updates = F.map_filter(a, lambda k, _: k.isin(PERMITTED))
    kept = F.map_filter(b, lambda k, _: ~F.map_contains_key(updates, k))
    merged = F.when(F.col("state") == "resolved", F.map_concat(kept, updates)).otherwise(a)
    joined = joined.withColumn("state", state)
    return joined.select("record_id", "canonical_url", "ts", "refers_to", "state", merged.alias("headers"), F.when(F.col("state") == "resolved", F.col("full_digest")).otherwise(F.col("digest")).alias("digest"))


def captures(pages: DataFrame) -> DataFrame:
    """Crawl records of a table of pages: each page is a full response, visited again a million ticks later.

    The second visit names the page by another form of its URL and brings the same tag in weak form, or only the time of
    last change (every fourth), or a new tag (every fourth), which no response confirms.
    """
    first, tag, form = F.col("page_id") * 10, F.md5(F.coalesce("html", F.lit(""))), F.pmod(F.col("page_id"), F.lit(4))
    again = first + 1_000_000
    text = lambda c: c.cast("string")
    same = F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), text(F.octet_length(F.coalesce("html", F.lit("")))), F.lit("cache-control"), F.lit("max-age=60"), F.lit("etag"), F.concat(F.lit('"'), tag, F.lit('"')), F.lit("last-modified"), text(first), F.lit("date"), text(first))
    common = F.create_map(F.lit("cache-control"), F.lit("max-age=3600"), F.lit("date"), text(again), F.lit("content-length"), F.lit("0"))
    proof = (
        F.when(form == 2, F.create_map(F.lit("last-modified"), text(first)))
        .when(form == 3, F.create_map(F.lit("etag"), F.lit('"new"')))
        .otherwise(F.create_map(F.lit("etag"), F.concat(F.lit('W/"'), tag, F.lit('"'))))
    )
    response = F.struct((F.col("page_id") * 2).alias("record_id"), F.col("url"), first.alias("ts"), F.lit("response").alias("kind"), same.alias("headers"), tag.alias("digest"))
    revisit = F.struct((F.col("page_id") * 2 + 1).alias("record_id"), F.concat("url", F.lit("#again")).alias("url"), again.alias("ts"), F.lit("revisit").alias("kind"), F.map_concat(common, proof).alias("headers"), F.lit(None).cast("string").alias("digest"))
    return pages.select(F.explode(F.array(response, revisit)).alias("r")).select("r.*")


def digests(rows: DataFrame) -> DataFrame:
    """resolved() with the headers as columns."""
    h = F.col("headers")
    return rows.select("record_id", "canonical_url", "ts", "refers_to", "state", "digest", *[h[name].alias(name.replace("-", "_")) for name in ("cache-control", "content-length", "content-type", "date", "etag", "last-modified")])


SQL = r"""
WITH records AS (
  SELECT page_id * 2 AS record_id, url, page_id * 10 AS ts, 'response' AS kind, md5(coalesce(html, '')) AS digest,
         'max-age=60' AS cache_control, CAST(strlen(coalesce(html, '')) AS VARCHAR) AS content_length, 'text/html' AS content_type,
         CAST(page_id * 10 AS VARCHAR) AS date, '"' || md5(coalesce(html, '')) || '"' AS etag, CAST(page_id * 10 AS VARCHAR) AS last_modified
  FROM pages
  UNION ALL
  SELECT page_id * 2 + 1, url || '#again', page_id * 10 + 1000000, 'revisit', NULL,
         'max-age=3600', '0', NULL, CAST(page_id * 10 + 1000000 AS VARCHAR),
         CASE page_id % 4 WHEN 2 THEN NULL WHEN 3 THEN '"new"' ELSE 'W/"' || md5(coalesce(html, '')) || '"' END,
         CASE page_id % 4 WHEN 2 THEN CAST(page_id * 10 AS VARCHAR) END
  FROM pages
), cut AS (
  SELECT *, regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS rest FROM records
), split AS (
  SELECT *, regexp_replace(rest, '[/?].*$', '') AS site FROM cut
), parts AS (
  SELECT *, substr(rest, length(site) + 1) AS tail FROM split
), named AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(site), '^[^@]*@', ''), ':(80|443)$', ''), '^www\.', '')
         || regexp_replace(regexp_replace(tail, '\?.*$', ''), '/+$', '')
         || coalesce('?' || nullif(array_to_string(list_sort(list_filter(
              string_split(CASE WHEN instr(tail, '?') > 0 THEN substr(tail, instr(tail, '?') + 1) ELSE '' END, '&'),
              lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|gclid|fbclid|ref)(=|$)'))), '&'), ''), '') AS canonical_url
  FROM parts
), ranked AS (
  SELECT r.record_id, r.canonical_url, r.ts, r.cache_control AS rc, r.content_length AS rl, r.date AS rd, r.etag AS re, r.last_modified AS rm,
         f.record_id AS refers_to, f.digest AS fdigest, f.content_length AS fl, f.content_type AS ft, f.etag AS fe, f.last_modified AS fm,
         row_number() OVER (PARTITION BY r.record_id ORDER BY f.ts DESC, f.record_id DESC) AS k
  FROM named r LEFT JOIN named f ON f.kind = 'response' AND f.canonical_url = r.canonical_url AND (f.ts, f.record_id) < (r.ts, r.record_id)
  WHERE r.kind = 'revisit'
), stated AS (
  SELECT *, CASE WHEN refers_to IS NULL THEN 'orphan'
                 WHEN coalesce(regexp_replace(re, '^W/', '') = regexp_replace(fe, '^W/', ''), rm = fm) THEN 'resolved' ELSE 'mismatch' END AS state
  FROM ranked WHERE k = 1
)
SELECT record_id, canonical_url, ts, refers_to, state, CASE WHEN state = 'resolved' THEN fdigest END AS digest, rc AS cache_control,
       CASE WHEN state = 'resolved' THEN fl ELSE rl END AS content_length, CASE WHEN state = 'resolved' THEN ft END AS content_type, rd AS date,
       CASE WHEN state = 'resolved' THEN coalesce(re, fe) ELSE re END AS etag,
       CASE WHEN state = 'resolved' THEN coalesce(rm, fm) ELSE rm END AS last_modified
FROM stated
"""
