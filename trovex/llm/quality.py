"""Quality rules: base rules, and an isolation forest on the statistics of such rules.

Each tree of the forest splits a small sample at random statistics and values.  A document that few splits separate
from the sample is unlike it; its score is 2 ** (-mean path length / expected path length), as usual.  The trees split
the statistics as they are: characters a word, symbols a word, the share of letters, the share of short words.  They are
fitted on a bounded sample of labelled rows (TREES * SAMPLE rows at most, by the hash of their doc_id), good and bad
alike.  Labels decide the threshold alone: of all scores, the one with most bad rows above it, less COST times the good
ones, while at most FALSE_SHARE of the good ones lie above.  One labelled row in HELD, by the hash of its doc_id, takes
part in neither, so that held_out_shares() can tell what the verdicts are worth.  Statistics, scores and verdicts cover
all rows.

Null and empty texts have no words and fail the base rules.  Very long texts are measured whole.  Without labelled rows
of both kinds, or where no threshold tells them apart, only the base rules reject.  Labels that are null are ignored; a
doc_id with several labels has the least.  Ties of the scores share a verdict, as do repeated rows.  Empty tables give
empty results; other columns pass through filtered() and are ignored elsewhere.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovex.llm.common import BATCH_ROWS, WORD, bounded, drawn, longs, mapped, slices, stored, strings

TREES, SAMPLE, SEED, HELD = 128, 64, 7, 4
FALSE_SHARE, COST, BINS = 0.02, 5, 2000
#: Least words, and the largest share of repeated words in percent, of the base rules.
LEAST_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = "#*$%&|<>"
LETTERS = re.compile(r"[^\W\d_]+")
#: Code points of a short word, at most.
SHORT = 3
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_letters", "n_short"]
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def statistics(text: str) -> tuple[int, ...]:
    """The statistics of a text, in the order of STATISTICS."""
    words = WORD.findall(text)
    seen: set[str] = set()
    repeated = 0
    for line in text.split("\n"):
        if line in seen:
            repeated += 1
        elif WORD.search(line):
            seen.add(line)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    letters = sum(map(len, LETTERS.findall(text)))
    return len(words), int(sizes.sum()), sum(map(text.count, SYMBOLS)), repeated, repeat_words(words), letters, int((sizes <= SHORT).sum())


def repeat_words(words: list[str]) -> int:
    """Words within 3-word windows that stand twice or more in the text.

    Windows are compared by 64-bit hashes, which hold within one text; they need no table of words.
    """
    n = len(words)
    if n < 4:
        return 0
    w = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    key = (w[:-2] * FACTOR + w[1:-1]) * FACTOR + w[2:]
    order = np.sort(key)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return 0
    at = np.searchsorted(twice, key)
    hit = twice[np.minimum(at, len(twice) - 1)] == key
    inside = np.zeros(n, bool)
    inside[:-2] |= hit
    inside[1:-1] |= hit
    inside[2:] |= hit
    return int(inside.sum())


def base_failed(stats: np.ndarray) -> np.ndarray:
    n, repeat = stats[:, 0], stats[:, STATISTICS.index("n_repeat_words")]
    return (n < LEAST_WORDS) | (100 * repeat > MOST_REPEATED * n)


def features(stats: np.ndarray) -> np.ndarray:
    """The statistics that the trees split, as shares, so that long and short texts compare."""
    n, chars, symbols, _, _, letters, short = stats.astype(float).T
    words = np.maximum(n, 1)
    return np.stack([chars / words, symbols / words, letters / np.maximum(chars, 1), short / words], axis=1)


@dataclass
class Tree:
    feature: np.ndarray
    split: np.ndarray
    below: np.ndarray  # the left child; the right one follows it; at a leaf 0
    depth: np.ndarray  # at a leaf: path length with what its rows would add

    def paths(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while len(rows):
            node = at[rows]
            inner = self.below[node] > 0
            rows, node = rows[inner], node[inner]
            at[rows] = self.below[node] + (x[rows, self.feature[node]] >= self.split[node])
        return self.depth[at]


def added(n: int) -> float:
    """The expected path length in a tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grown(x: np.ndarray, rng: np.random.Generator) -> Tree:
    most = math.ceil(math.log2(max(2, len(x))))
    feature, split, below, depth = [0], [0.0], [0], [0.0]
    todo = [(0, x, 0)]
    while todo:
        node, rows, d = todo.pop()
        low, high = rows.min(0), rows.max(0)
        wide = np.flatnonzero(high > low)
        if d >= most or len(rows) < 2 or not len(wide):
            depth[node] = d + added(len(rows))
            continue
        f = int(rng.choice(wide))
        s = float(rng.uniform(low[f], high[f]))
        right = rows[:, f] >= s
        if right.all():
            s = float(high[f])
            right = rows[:, f] >= s
        feature[node], split[node], below[node] = f, s, len(below)
        for side in (~right, right):
            todo.append((len(below), rows[side], d + 1))
            feature.append(0)
            split.append(0.0)
            below.append(0)
            depth.append(0.0)
    return Tree(*map(np.array, (feature, split, below, depth)))


@dataclass
class Forest:
    """threshold: documents that score above it are rejected."""

    trees: list[Tree]
    size: int
    threshold: float = math.inf

    def scores(self, stats: np.ndarray) -> np.ndarray:
        if not self.trees:
            return np.zeros(len(stats))
        x = features(stats)
        mean = np.mean([t.paths(x) for t in self.trees], axis=0)
        return 2.0 ** (-mean / max(added(self.size), 1e-9))

    def kept(self, stats: np.ndarray) -> np.ndarray:
        return ~base_failed(stats) & (self.scores(stats) <= self.threshold)


def of_texts(texts: list[str]) -> np.ndarray:
    return np.array([statistics(x) for x in texts], np.int64).reshape(-1, len(STATISTICS))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every whole text."""

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        stats = of_texts(strings(batch.column(1)))
        return pa.record_batch([batch.column(0), *map(longs, stats.T)], ["doc_id", *STATISTICS])

    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), measure, "doc_id long, " + ", ".join(f"{c} long" for c in STATISTICS))


def stats_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([np.asarray(batch.column(c)) for c in STATISTICS], axis=1)


def labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """The stored statistics, quality and fold of labelled rows that pass the base rules; fold 0 is held out."""
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    rows = stats.join(known, "doc_id").where(F.expr(f"n_words >= {LEAST_WORDS} and 100 * n_repeat_words <= {MOST_REPEATED} * n_words"))
    return stored(rows.withColumn("fold", F.pmod(F.xxhash64(F.lit("held out"), "doc_id"), F.lit(HELD)).cast("int")), "labelled")


def threshold(counts: np.ndarray) -> float:
    """The score above which documents go, from the bad (row 0) and good (row 1) rows in each bin of scores."""
    above = counts[:, ::-1].cumsum(1)[:, ::-1]  # with a score in this bin or above
    bad, good = above / np.maximum(counts.sum(1, keepdims=True), 1)
    gain = np.where(good <= FALSE_SHARE, bad - COST * good, -1.0)
    best = int(gain.argmax())
    return float(np.nextafter(best / BINS, 0.0)) if gain[best] > 0 else math.inf


def fitted(rows: DataFrame) -> Forest:
    """The forest for the stored rows of labelled()."""
    rows = rows.where("fold <> 0")
    draw = drawn(rows, TREES * SAMPLE, F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").select(*STATISTICS)
    sample = features(np.array(draw.collect(), np.int64).reshape(-1, len(STATISTICS)))
    size, rng = min(SAMPLE, len(sample)), np.random.default_rng(SEED)
    if size < 2:
        return Forest([], 0)
    forest = Forest([grown(sample[rng.choice(len(sample), size, replace=False)], rng) for _ in range(TREES)], size)

    def binned(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = np.minimum((forest.scores(stats_of(batch)) * BINS).astype(np.int64), BINS - 1)
        return pa.record_batch([batch.column("quality"), longs(at)], ["quality", "bin"])

    counts = np.zeros((2, BINS))
    for quality, at, n in mapped(rows.select("quality", *STATISTICS), binned, "quality int, bin long").groupBy("quality", "bin").count().collect():  # 2 * BINS rows at most
        counts[quality, at] += n
    forest.threshold = threshold(counts)
    return forest


def held_out_shares(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(quality, n, kept): of the labelled rows that neither trees nor threshold saw and that pass the base rules, how many there are and what share is kept."""
    rows = labelled(stored(measured(docs), "statistics"), labels)
    forest = fitted(rows)

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column("quality"), pa.array(forest.kept(stats_of(batch)))], ["quality", "kept"])

    verdicts = mapped(rows.where("fold = 0").select("quality", *STATISTICS), judge, "quality int, kept boolean")
    return verdicts.groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("kept").cast("double")).alias("kept"))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document's statistics, score and verdict."""
    stats = stored(measured(docs), "statistics")
    forest = fitted(labelled(stats, labels))

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = stats_of(batch)
        score = forest.scores(x)
        failed = base_failed(x)
        own = [batch.column(c) for c in ["doc_id", *STATISTICS[:5]]]
        return pa.record_batch([*own, pa.array(failed), pa.array(~failed & (score <= forest.threshold)), pa.array(score)], ["doc_id", *STATISTICS[:5], "base_failed", "kept", "score"])

    return mapped(stats, judge, "doc_id long, " + ", ".join(f"{c} long" for c in STATISTICS[:5]) + ", base_failed boolean, kept boolean, score double")


def filtered(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns.

    Verdicts are computed anew where the texts are read, which costs less than to shuffle whole texts to their verdicts.
    """
    forest = fitted(labelled(stored(measured(docs), "statistics"), labels))
    bounded(docs.sparkSession)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BATCH_ROWS):
            yield batch.filter(pa.array(forest.kept(of_texts(strings(batch.column("text"))))))

    return docs.mapInArrow(keep, docs.schema)
