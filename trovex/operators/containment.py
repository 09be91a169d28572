"""Which texts are like %pattern%, for many texts and many patterns, by an inverted list of grams.

A pattern's literal runs (what stands between its wild cards) must occur in a text that matches, so one gram of the
longest run, the one that the fewest texts have, leads to the candidates, which are then compared as a whole.  Runs of
one or two characters use grams of their own length.  A pattern of wild cards alone matches by its length.  Texts and
patterns meet in equi-joins on grams only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trovex.sources.shared import stored

GRAM = 3


def grams(text: Column, n: int) -> Column:
    """The distinct runs of n characters."""
    runs = F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(F.length(text) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def literal(pattern: Column) -> Column:
    """The longest run of a lower-case pattern without wild cards."""
    runs = F.transform(F.split(pattern, "[%_]"), lambda r: F.struct(F.length(r).alias("n"), r.alias("r")))
    return F.array_max(runs)["r"]


def like(text: str, pattern: str) -> Column:
    """text ILIKE %pattern%, where a backslash is itself."""
    return F.expr(rf"{text} ILIKE concat('%', replace({pattern}, '\\', '\\\\'), '%')")


def matches(texts: DataFrame, patterns: DataFrame, bound: int = 10_000) -> DataFrame:
    """(text, pattern) of the texts (text) like patterns (pattern); both distinct.  Patterns without a literal run are left out.

    Only postings of grams that some pattern has are shuffled; the set of these grams is broadcast where it has at most
    bound, of three characters each.
    """
    runs = patterns.select("pattern", literal(F.lower("pattern")).alias("_run")).withColumn("_size", F.least(F.length("_run"), F.lit(GRAM)))
    runs = stored(runs.where("_size > 0"), "runs")
    parts = []
    for (n,) in runs.select("_size").distinct().orderBy("_size").collect():  # at most GRAM sizes
        posts = texts.select("text", F.explode(grams(F.lower("text"), n)).alias("_gram"))
        asked = runs.where(F.col("_size") == n).select("pattern", F.explode(grams(F.col("_run"), n)).alias("_gram"))
        wanted = stored(asked.select("_gram").distinct(), "grams")
        posts = posts.join(F.broadcast(wanted) if wanted.count() <= bound else wanted, "_gram", "left_semi")
        counts = posts.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
        asked = asked.join(counts, "_gram", "left").groupBy("pattern").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("g"))).alias("_least"))
        asked = asked.where("_least.n > 0").select("pattern", F.col("_least.g").alias("_gram"))
        parts.append(posts.join(asked, "_gram").where(like("text", "pattern")).select("text", "pattern"))
    return reduce(DataFrame.union, parts) if parts else texts.select("text", F.col("text").alias("pattern")).limit(0)


def blanks(patterns: DataFrame, *kept: str) -> DataFrame:
    """(least length of a match, kept columns) of the patterns of wild cards alone."""
    only = patterns.where(F.length(literal(F.lower("pattern"))) == 0)
    return only.select(F.length(F.regexp_replace("pattern", "[^_]", "")).alias("at"), *kept)


def best_by_length(values: DataFrame, asks: DataFrame, longer: bool) -> DataFrame:
    """asks (at, ...) with the greatest value of values (at, value) whose at is not less than theirs (longer), or not greater.

    Both are first reduced to lengths, of which there are as many as the longest text has characters.
    """
    step = W.orderBy(F.desc("at") if longer else F.asc("at")).rangeBetween(W.unboundedPreceding, 0)
    known = values.groupBy("at").agg(F.max("value").alias("value"))
    points = known.unionByName(asks.select("at").distinct(), allowMissingColumns=True).groupBy("at").agg(F.max("value").alias("value"))
    return asks.join(points.select("at", F.max("value").over(step).alias("value")), "at")
