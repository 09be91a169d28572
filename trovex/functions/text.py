"""Text functions on columns: grams, prefixes, scores of a match.  All stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def lower(c: Column | str) -> Column:
    return F.lower(c)


def contains(text: Column, query: Column | str) -> Column:
    """Whether text contains query, whatever the case."""
    q = F.lit(query) if isinstance(query, str) else query
    return F.contains(F.lower(text), F.lower(q))


def trigrams(text: Column) -> Column:
    """The distinct lower-case 3-character windows; a name shorter than three bytes is its own gram; other short names have none."""
    t = F.lower(text)
    windows = F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda i: F.substring(t, i, F.lit(3)))
    none = F.array().cast("array<string>")
    return F.when(F.octet_length(t) < 3, F.when(F.length(t) > 0, F.array(t)).otherwise(none)).when(F.length(t) < 3, none).otherwise(F.array_distinct(windows))


def basename(path: Column) -> Column:
    """What follows the last backslash."""
    return F.substring_index(path, "\\", -1)


def parent(path: Column) -> Column:
    """What stands before the last backslash; empty without one."""
    return F.regexp_extract(path, r"^(.*)\\[^\\]*$", 1)


def extension(path: Column) -> Column:
    """What follows the last dot of the name, in lower case; empty without one."""
    return F.lower(F.regexp_extract(path, r"\.([^.\\/]+)$", 1))


def initials(text: Column) -> Column:
    """The first character of each word, in lower case."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")


def initials_match(text: Column, query: Column) -> Column:
    """Whether the words' initials begin with query, and there are as many words as query has bytes."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    return (F.size(words) >= F.octet_length(query)) & F.startswith(initials(text), F.lower(query))


def continuity(text: Column, query: Column) -> Column:
    """The longest run of query's characters met in order while walking text once, over query's bytes.

    The place in query only moves forward; a character of text that is not the next one ends the run.
    """
    t, q = F.lower(text), F.lower(query)
    zero = F.struct(F.lit(1).alias("at"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, c: Column) -> Column:
        hit = (s["at"] <= F.length(q)) & (F.substring(q, s["at"], F.lit(1)) == c)
        run = F.when(hit, s["run"] + 1).otherwise(0)
        return F.struct((s["at"] + hit.cast("int")).alias("at"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    walked = F.aggregate(F.split(t, ""), zero, step, lambda s: s["best"])
    return F.when(F.length(q) == 0, 0.0).otherwise(walked / F.octet_length(q))


def position_score(name: Column, query: Column) -> Column:
    """100 at the start, else 80 less the bytes before the match; null without a match."""
    n, q = F.lower(name), F.lower(query)
    at = F.position(q, n)
    before = F.octet_length(F.substring(n, F.lit(1), at - 1))
    return F.when(at == 1, 100).when(at > 1, 80 - before).cast("long")


def subsequence(text: Column, query: str) -> Column:
    """Whether query's characters stand in text in this order, whatever the case."""
    return F.rlike(text, F.lit("(?is)" + ".*".join(re.escape(c) for c in query)))


def fuzzy_score(text: Column, query: Column) -> Column:
    """A score of a subsequence match, 0 without one: 16 a character, 8 for each that follows its neighbour, 24 at the start.

    The characters are matched to their first places in order.
    """
    t, q = F.lower(text), F.lower(query)
    zero = F.struct(F.lit(1).alias("at"), F.lit(False).alias("near"), F.lit(0).alias("score"), F.lit(True).alias("first"))

    def step(s: Column, c: Column) -> Column:
        hit = (s["at"] <= F.length(q)) & (F.substring(q, s["at"], F.lit(1)) == c)
        gain = F.when(hit, F.lit(16) + F.when(s["near"], 8).otherwise(0) + F.when(s["first"], 24).otherwise(0)).otherwise(0)
        return F.struct((s["at"] + hit.cast("int")).alias("at"), hit.alias("near"), (s["score"] + gain).alias("score"), F.lit(False).alias("first"))

    return F.aggregate(F.split(t, ""), zero, step, lambda s: F.when((F.length(q) > 0) & (s["at"] > F.length(q)), s["score"]).otherwise(0))


def text_score(title: Column, subtitle: Column, query: Column, raw: Column) -> Column:
    """How well a result matches a query, 0 to 100."""
    t, s, q = F.lower(title), F.lower(subtitle), F.lower(query)
    place = F.when(t == q, 100.0).when(F.startswith(t, q), 80.0).when(F.contains(t, q), 60.0).otherwise(0.0)
    score = place + F.when(F.contains(s, q), 20.0).otherwise(0.0) + F.when(initials_match(t, q), 40.0).otherwise(0.0) + continuity(t, q) * 30.0 + raw * 0.1
    return F.when(F.length(query) == 0, 0.0).otherwise(F.least(score, F.lit(100.0)))


def match_tier(text: Column, full: Column, short: Column, query: Column) -> Column:
    """The tier of a match of a text, or of its transcription in full or by initials."""
    t, q = F.lower(text), F.lower(query)
    tiers = F.when(t == q, 1000).when(F.startswith(t, q), 800).when(F.contains(t, q), 600).when(F.startswith(full, q), 500).when(F.startswith(short, q), 400)
    tiers = tiers.when(F.contains(full, q), 300).when(F.contains(short, q), 200).otherwise(0)
    return F.when((F.length(query) == 0) | (F.length(text) == 0), 0).otherwise(tiers).cast("long")


def highlight(text: Column, query: Column) -> Column:
    """struct(before, match, after) of the first match; null without one."""
    at = F.position(F.lower(query), F.lower(text))
    n = F.length(query)
    parts = F.struct(F.substring(text, F.lit(1), at - 1).alias("before"), F.substring(text, at, n).alias("match"), F.substring(text, at + n, F.length(text)).alias("after"))
    return F.when((n > 0) & (at > 0), parts)


def truncated(text: Column, most: int) -> Column:
    """The first characters of a text, with three dots where it goes on.  Counted in characters, so none is cut in two."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most), F.lit("...")))


def html_escaped(text: Column) -> Column:
    out = text
    # The ampersand first, as the others bring one.
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def attachment_name(header: Column) -> Column:
    """The file name of a Content-Disposition header; null without one."""
    name = F.regexp_extract(header, r'filename="?([^";]+)"?', 1)
    return F.when(name != "", name)
