"""One search over several sources: their results in one union, ranked by match, use, recency, kind and last runs.

A result is a row (id, title, subtitle, score, plugin_id).  The whole search is one plan: sources are filtered where
they are read, usage joins on id, and scores are columns, so only the rows that a list keeps are sorted.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trovex.functions.text import text_score
from trovex.functions.times import recency_score
from trovex.sources.shared import stored

RESULT = ["id", "title", "subtitle", "score", "plugin_id"]
#: Rows of usage that may be broadcast; more are shuffled.
SMALL = 1_000_000


@dataclass(frozen=True)
class Weights:
    text: float = 1.0
    frequency: float = 2.0
    recency: float = 1.5
    kind: float = 0.5
    last_run: float = 3.0


# The score of a result's kind by its source, and of a file by its ending.
KIND_SCORES = {"app-search": 40.0, "git-projects": 35.0, "browser-bookmarks": 20.0, "browser-history": 10.0, "process-manager": 30.0}
FILE_SCORES = {".exe": 30.0, ".lnk": 25.0}
OTHER_SCORE = 15.0


@dataclass
class Sources:
    """Named sources of results: functions of a query that return a DataFrame with the columns RESULT."""

    known: dict[str, Callable[[str], DataFrame]] = field(default_factory=dict)

    def register(self, name: str, source: Callable[[str], DataFrame]) -> None:
        self.known[name] = source

    def search(self, query: str, disabled: tuple[str, ...] = (), failed: dict[str, Exception] | None = None) -> DataFrame:
        """The union of what the sources return, without disabled ones.

        A source that fails to plan ends the search, unless a dictionary failed is given: then the source is left out,
        and its error is in failed by its name.
        """
        parts = []
        for name, source in self.known.items():
            if name in disabled:
                continue
            try:
                parts.append(source(query).select(*RESULT))
            except Exception as error:  # noqa: BLE001  the caller decides
                if failed is None:
                    raise
                failed[name] = error
        if not parts:
            raise ValueError("no source can answer")
        return reduce(DataFrame.unionByName, parts)

    def gathered(self, spark: SparkSession, query: str, seconds: float, disabled: tuple[str, ...] = (), failed: dict[str, Exception] | None = None) -> DataFrame:
        """The union of what the sources return within a deadline, each run by itself and its rows written.

        The jobs of a source that is late are cancelled by its tag, and it is in failed by its name, like one that
        fails; the others answer.  Raises ValueError where none does.
        """
        failed = {} if failed is None else failed
        found: dict[str, DataFrame] = {}
        lock, closed = threading.Lock(), set()

        def answer(name: str, source: Callable[[str], DataFrame], tag: str) -> None:
            spark.sparkContext.addJobTag(tag)  # of this thread, as all jobs that it starts
            try:
                rows = stored(source(query).select(*RESULT), name)
                with lock:
                    if name not in closed:
                        found[name] = rows
            except Exception as error:  # noqa: BLE001  one source's failure is not the search's
                with lock:
                    if name not in closed:
                        failed[name] = error

        runs = {}
        for name, source in self.known.items():
            if name not in disabled:
                tag = f"{name}-{uuid.uuid4().hex}".replace(",", "_")
                runs[name] = tag, InheritableThread(target=answer, args=(name, source, tag), daemon=True)
                runs[name][1].start()
        end = time.monotonic() + seconds
        for name, (tag, thread) in runs.items():
            thread.join(max(0.0, end - time.monotonic()))
            with lock:
                late = name not in found and name not in failed
                closed.add(name)
            if late:
                spark.sparkContext.cancelJobsWithTag(tag)
                failed[name] = TimeoutError(f"{name} took more than {seconds} s")
        if not found:
            raise ValueError("no source can answer")
        return reduce(DataFrame.unionByName, [found[name] for name in runs if name in found])


def frequency_score(count: Column) -> Column:
    """0 to 100, by the logarithm of a count."""
    return F.when(count == 0, 0.0).otherwise(F.least(F.log10(count + 1.0) * 50.0, F.lit(100.0)))


def kind_score(plugin_id: Column, subtitle: Column) -> Column:
    out = F.when(plugin_id == "file-search", F.when(F.endswith(subtitle, F.lit(".exe")), FILE_SCORES[".exe"]).when(F.endswith(subtitle, F.lit(".lnk")), FILE_SCORES[".lnk"]).otherwise(OTHER_SCORE))
    for name, score in KIND_SCORES.items():
        out = out.when(plugin_id == name, score)
    return out.otherwise(OTHER_SCORE)


def by_id(usage: DataFrame) -> DataFrame:
    """Usage of (result_id, plugin_id) by result_id alone: the row last used, ties by plugin_id."""
    return usage.groupBy("result_id").agg(F.max_by(F.struct("count", "last_used"), F.struct("last_used", "plugin_id")).alias("u")).select(F.col("result_id").alias("id"), "u.count", "u.last_used")


def with_usage(results: DataFrame, usage: DataFrame, runs: DataFrame) -> DataFrame:
    """Adds count, last_used (null for ids outside runs) and is_run.

    usage: id, count, last_used; runs: the ids of the last runs, a top list.
    """
    marked = runs.select("id").distinct().withColumn("is_run", F.lit(True))
    rows = results.join(usage, "id", "left").join(F.broadcast(marked), "id", "left")  # a top list
    run = F.coalesce("is_run", F.lit(False))
    return rows.select(*[c for c in results.columns], F.coalesce("count", F.lit(0)).cast("long").alias("count"), F.when(run, F.col("last_used")).alias("last_used"), run.alias("is_run"))


def ranked(results: DataFrame, query: str, now: Column, weights: Weights = Weights()) -> DataFrame:
    """results of with_usage with rank_score, a whole number."""
    w, q = weights, F.lit(query)
    score = (
        text_score(F.col("title"), F.col("subtitle"), q, F.col("score")) * w.text
        + frequency_score(F.col("count")) * w.frequency
        + F.coalesce(recency_score(F.col("last_used"), now), F.lit(0.0)) * w.recency
        + kind_score(F.col("plugin_id"), F.col("subtitle")) * w.kind
        + F.when(F.col("is_run"), 100.0 * w.last_run).otherwise(0.0)
    )
    return results.withColumn("rank_score", score.cast("int").cast("long"))
