"""A trigram index over names: postings, AND search, delta overlay, merge.

A posting is a row (gram, file_id); the index is a table of postings sorted by gram, so a search reads the row groups
of its grams only.  A delta is postings of added files and tombstones of removed ones; a renamed file is both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovex.functions.text import contains, trigrams


def postings(files: DataFrame, name: str = "name") -> DataFrame:
    """(gram, file_id), one row for each distinct gram of a file's name."""
    return files.select(F.explode(trigrams(F.col(name))).alias("gram"), "file_id")


def posting_counts(posts: DataFrame) -> DataFrame:
    """(gram, n_files): how many files have each gram."""
    return posts.groupBy("gram").agg(F.count(F.lit(1)).alias("n_files"))


def write_index(posts: DataFrame, path: str, partitions: int | None = None) -> None:
    """Writes postings in the order of their grams; the committer makes the files appear at once."""
    dealt = posts.repartitionByRange(partitions, "gram", "file_id") if partitions else posts.repartitionByRange("gram", "file_id")
    dealt.sortWithinPartitions("gram", "file_id").write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def query_grams(query: str) -> list[str]:
    """The grams that a search asks for, in the order of the query; the same rule as for names."""
    q = query.lower()
    if len(q.encode()) < 3:
        return [q] if q else []
    return list(dict.fromkeys(q[i : i + 3] for i in range(len(q) - 2)))


def search_and(posts: DataFrame, query: str) -> DataFrame:
    """(file_id) of the files that have every gram of query, in any order: a candidate set, not a substring match."""
    grams = query_grams(query)
    if not grams:
        return posts.select("file_id").limit(0)
    hits = posts.where(F.col("gram").isin(grams))  # a posting occurs once
    return hits.groupBy("file_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(grams)).select("file_id")


def scan_and(files: DataFrame, query: str, name: str = "name") -> DataFrame:
    """The files whose name has every gram of query, without an index: each name is looked at once, and nothing is shuffled."""
    text = F.lower(name)
    own = len(query.lower().encode()) < 3  # a name so short is its own gram
    test = F.lit(bool(query_grams(query)))
    for gram in query_grams(query):
        test = test & (text == gram if own else F.contains(text, F.lit(gram)))
    return files.where(test)


def search_exact(files: DataFrame, posts: DataFrame, query: str) -> DataFrame:
    """The files whose name contains query, looked up among the index's candidates.

    Names that are too short for grams are compared in full, as the index cannot tell them.
    """
    if len(query) < 3:
        return files.where(contains(F.col("name"), query))
    return files.join(search_and(posts, query), "file_id", "left_semi").where(contains(F.col("name"), query))


def with_delta(base: DataFrame, added: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """Postings of base and delta, without the removed file_ids; each once.

    What the delta has of a file takes the place of what the base has, so the two share no posting, and only the
    file_ids of the delta meet the base's postings.
    """
    gone = added.select("file_id").distinct()
    live = base.join(gone if removed is None else gone.union(removed.select("file_id")), "file_id", "left_anti")
    added = added if removed is None else added.join(removed.select("file_id"), "file_id", "left_anti")
    return live.select("gram", "file_id").union(added.select("gram", "file_id"))


def lookup(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """The files of wanted file_ids; ids without a file are left out."""
    return files.join(wanted.select("file_id").distinct(), "file_id")
