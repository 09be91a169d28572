"""Removal of repeated passages, found by a compressed FM-index for each shard of the corpus.

A window of WINDOW words is repeated if its words also begin earlier: in a document of a smaller doc_id, or earlier in
the same document.  The words of repeated windows go.

Texts are cut into segments, runs of windows with one anchor (segments.py); equal windows have equal anchors, so what
shares no anchor with anything never travels again.  Segments are dealt by anchor.  Of equal segments the earliest
stands for all, and every other one is repeated as a whole.  Where an anchor has several segments, those that stand for
others go to the shard of their anchor: the shard's words make one FM-index, and the segments are streamed through it,
backward from their last words, which tells for each window where it occurs first.

Equal segments of one batch are folded before anything is shuffled, so one passage in a third of all rows costs a row
a batch.  Anchors with many different segments in a bounded sample of documents (near copies) are heavy: their windows
are dealt one by one, by all of their words.  The sample decides how rows are dealt and nothing else.

Null texts have no words.  A null doc_id comes before all others.  Rows with one doc_id and one text are one document
and get equal results; rows with one doc_id and different texts are ordered by a hash of the text.  Texts of fewer than
WINDOW words keep all.  Very long texts are cut into segments like any other.  Empty tables give empty results; other
columns are ignored by removed() and kept by cleaned().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trovex.llm.common import BATCH_ROWS, WORD, bounded, longs, private, slices, stored, strings
from trovex.llm.fm_index import FmIndex
from trovex.llm.segments import Hashes, segments

#: Words of a window; words of an anchor.
WINDOW, ANCHOR = 20, 4
#: Documents of the sample that tells heavy anchors, about; segments that make an anchor heavy there; most heavy anchors.
SAMPLE, HEAVY, MOST_HEAVY = 8192, 64, 4096
#: Words of one shard, about, and fewest shards.
SHARD_WORDS, SHARDS = 1 << 20, 64
LEAST = -(1 << 63)
#: Bits of a segment's number of windows; segments that are joined to one at most, each of fewer windows than a window has words.
COUNT_BITS, MOST_JOINED = 16, 2048
SEGMENT = "doc long, hash long, at long, anchor long, content long, sure boolean"


def keyed(docs: DataFrame) -> DataFrame:
    """(doc, hash, text): what tells documents apart and orders them."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("doc"), F.xxhash64("text").alias("hash"), "text")


def found(texts: DataFrame, window: int, heavy: np.ndarray) -> DataFrame:
    """The segments of keyed texts; of equal ones in a batch the earliest, and the others as sure (repeated) ones.

    at holds the first word's place and, in its lowest bits, the number of windows.  Sure ones that follow each other are one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in slices(batches, BATCH_ROWS):
            words = [WORD.findall(t) for t in strings(batch.column(2))]
            ends = np.cumsum([len(w) for w in words], dtype=np.int64)
            owner, start, count, anchor, content = segments(hashes.of([w for x in words for w in x]), ends, window, ANCHOR, heavy)
            doc, text = (batch.column(i).to_numpy()[owner] for i in (0, 1))
            at = start << COUNT_BITS | count
            order = np.lexsort((at, text, doc, content, anchor))
            same = np.zeros(len(order), bool)
            a, c = anchor[order], content[order]
            same[1:] = (a[1:] == a[:-1]) & (c[1:] == c[:-1])
            head = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
            sure = np.zeros(len(order), bool)
            sure[order] = same
            earliest = np.empty(len(order), np.int64)
            earliest[order] = head
            again = (doc == doc[earliest]) & (text == text[earliest]) & (at == at[earliest])  # a repeated row
            keep = ~(sure & again)
            joined = sure & keep
            joined[1:] &= joined[:-1] & (owner[1:] == owner[:-1]) & (start[1:] == start[:-1] + count[:-1])
            joined[::MOST_JOINED] = False
            heads = (~joined).nonzero()[0]
            if len(heads):
                at = np.where(joined, 0, start << COUNT_BITS)
                at[heads] |= np.add.reduceat(count, heads)
            keep &= ~joined
            # a sure segment is compared with none; its place tells where it is dealt
            spread = (doc * 31 + text + at * 0x1F123BB5).view(np.uint64)
            anchor, content = (np.where(sure, spread, x).view(np.int64) for x in (anchor, content))
            columns = [longs(x[keep]) for x in (doc, text, at, anchor, content)]
            yield pa.record_batch([*columns, pa.array(sure[keep], pa.bool_())], ["doc", "hash", "at", "anchor", "content", "sure"])

    bounded(texts.sparkSession)
    return texts.mapInArrow(run, SEGMENT)


def heavy_anchors(texts: DataFrame, window: int) -> np.ndarray:
    """The anchors with the most different segments in the sample, sorted."""
    share = max(1, texts.count() // SAMPLE)
    sample = found(texts.where(F.pmod(F.xxhash64("doc", "hash"), F.lit(share)) == 0), window, np.empty(0, np.uint64)).where("not sure")
    counts = sample.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HEAVY)
    top = counts.orderBy(F.desc("n"), "anchor").limit(MOST_HEAVY).collect()
    return np.sort(np.array([r.anchor for r in top], np.int64).view(np.uint64))


def compared(texts: DataFrame, window: int) -> DataFrame:
    """(doc, hash, at, anchor, first, alone) of the segments whose anchor occurs twice: first of its equals; alone if its anchor has none but them."""
    rows = found(texts, window, heavy_anchors(texts, window))
    equal = W.partitionBy("anchor", "content").orderBy("doc", "hash", "at")
    of_anchor = W.partitionBy("anchor")
    rows = rows.select("*", F.row_number().over(equal).alias("place"), F.first(F.struct("doc", "hash", "at")).over(equal).alias("least"))
    rows = rows.withColumns({"n": F.count(F.lit(1)).over(of_anchor), "different": F.count_if(F.col("place") == 1).over(of_anchor)})
    first = (F.col("place") == 1) & ~F.col("sure")
    repeated_row = (F.col("place") > 1) & (F.struct("doc", "hash", "at") == F.col("least"))
    rows = rows.where((F.col("sure") | (F.col("n") > 1)) & ~repeated_row)
    return rows.select("doc", "hash", "at", F.when(first, F.col("anchor")).alias("anchor"), first.alias("first"), (F.col("different") == 1).alias("alone"))


def sent(texts: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(shard key anchor, doc, hash, start, words) of the wanted segments (doc, hash, at, anchor), once for repeated rows."""
    by_text = wanted.groupBy("doc", "hash").agg(F.collect_list(F.struct("at", "anchor")).alias("wanted"))  # segments of one text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in slices(batches, 200):
            doc, text, start, anchor, out = [], [], [], [], []
            for d, h, t, want in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if want is None or (d, h) == last:
                    continue
                last = (d, h)
                words = WORD.findall(t or "")
                for x in want:
                    at, n = x["at"] >> COUNT_BITS, x["at"] & ((1 << COUNT_BITS) - 1)
                    doc.append(d)
                    text.append(h)
                    start.append(at)
                    anchor.append(x["anchor"])
                    out.append(" ".join(words[at : at + n + window - 1]))
            yield pa.record_batch([longs(anchor), longs(doc), longs(text), longs(start), pa.array(out, pa.string())], ["anchor", "doc", "hash", "start", "words"])

    bounded(texts.sparkSession)
    return texts.join(by_text, ["doc", "hash"], "left").mapInArrow(run, "anchor long, doc long, hash long, start long, words string")


def searched(rows: DataFrame, window: int, shards: int) -> DataFrame:
    """(doc, hash, start, stop) of the words that repeated windows of the shards' segments cover."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc", "ascending"), ("hash", "ascending"), ("start", "ascending")])
        doc, text, start = (table.column(c).to_numpy() for c in ("doc", "hash", "start"))
        keep = np.concatenate([[True], (doc[1:] != doc[:-1]) | (text[1:] != text[:-1]) | (start[1:] != start[:-1])])  # repeated rows
        codes: dict[str, int] = {}
        parts, sizes = [], []
        for words in table.column("words").filter(pa.array(keep)).to_pylist():
            words = words.split(" ")
            parts.append(np.fromiter((codes.setdefault(w, len(codes) + 1) for w in words), np.int32, len(words)))
            parts.append(np.zeros(1, np.int32))
            sizes.append(len(words))
        doc, text, start, sizes = doc[keep], text[keep], start[keep], np.array(sizes)
        flat = np.concatenate(parts)
        ends = np.cumsum(sizes + 1) - 1
        hit = FmIndex(flat, len(codes) + 1, window).repeated(flat, ends - sizes, ends)
        begins = hit & ~np.concatenate([[False], hit[:-1]])
        stops = hit & ~np.concatenate([hit[1:], [False]])
        a, b = begins.nonzero()[0], stops.nonzero()[0]
        owner = np.searchsorted(ends, a)
        offset = start[owner] - (ends - sizes)[owner]
        return pa.table([longs(doc[owner]), longs(text[owner]), longs(a + offset), longs(b + offset + window)], ["doc", "hash", "start", "stop"])

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("anchor", F.lit("shard")), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(run, "doc long, hash long, start long, stop long")


def covered(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, hash, start, stop): runs of words of each document that repeated windows cover; runs may overlap."""
    texts = keyed(docs)
    rows = stored(compared(texts, window), "segments")
    start, count = F.shiftright("at", COUNT_BITS), F.col("at").bitwiseAND((1 << COUNT_BITS) - 1)
    whole = rows.where("not first").select("doc", "hash", start.alias("start"), (start + count + (window - 1)).alias("stop"))
    wanted = rows.where("first and not alone").select("doc", "hash", "at", "anchor")
    words = wanted.agg(F.sum(count + window).alias("n")).first().n or 0
    return whole.union(searched(sent(texts, wanted, window), window, max(SHARDS, -(-words // SHARD_WORDS))))


def kept_words(text: str | None, runs: list[dict] | None) -> tuple[int, list[str]]:
    """The number of words, and those that no run covers."""
    words = WORD.findall(text or "")
    if not runs:
        return len(words), words
    change = np.zeros(len(words) + 1, np.int64)
    for r in runs:
        change[r["start"]] += 1
        change[r["stop"]] -= 1
    keep = np.cumsum(change[:-1]) == 0
    return len(words), [words[i] for i in keep.nonzero()[0].tolist()]


def with_runs(docs: DataFrame, window: int, names: tuple[str, str]) -> DataFrame:
    """docs' columns doc and hash as names, text, and the runs that go."""
    runs = covered(docs, window).groupBy("doc", "hash").agg(F.collect_list(F.struct("start", "stop")).alias("runs"))  # runs of one text
    doc, text = names
    own = docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)), text: F.xxhash64("text")})
    on = (F.col(doc) == F.col("doc")) & (F.col(text) == F.col("hash"))
    return own.join(runs.select("doc", "hash", "runs"), on, "left")


def removed(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, gone, digest = [], [], []
        for text, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            total, words = kept_words(text, runs)
            n.append(total)
            gone.append(total - len(words))
            digest.append(hashlib.sha256(" ".join(words).encode("utf-8", "surrogatepass")).hexdigest())
        return pa.record_batch([batch.column(0), longs(n), longs(gone), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    bounded(docs.sparkSession)
    rows = with_runs(docs.select("doc_id", "text"), window, ("_doc", "_hash")).select(F.col("doc_id").cast("long"), "text", "runs")
    return rows.mapInArrow(lambda batches: map(run, slices(batches, 200)), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cleaned(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with repeated passages cut out of their texts, whose words are then joined by one space; other texts stay as they are."""

    @F.pandas_udf("string")
    def cut(text: pd.Series, runs: pd.Series) -> pd.Series:
        return pd.Series([t if r is None else " ".join(kept_words(t, list(r))[1]) for t, r in zip(text, runs, strict=True)], dtype=object)

    renamed = docs.select([F.col(f"`{c}`").alias(private(docs, f"_{c}") if c.lower() in ("doc", "hash", "runs") else c) for c in docs.columns])
    bounded(docs.sparkSession)
    rows = with_runs(renamed, window, (private(renamed, "_doc"), private(renamed, "_hash")))
    return rows.withColumn("text", cut("text", "runs")).select([F.col(f"`{r}`").alias(c) for c, r in zip(docs.columns, renamed.columns, strict=True)])


#: The same for DuckDB, with every window's words as a text.
SQL = r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
places AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS i, words FROM texts),
windows AS (SELECT doc_id, i, words[i] AS word, CASE WHEN i + 19 <= len(words) THEN array_to_string(words[i:i + 19], ' ') END AS win FROM places),
again AS (SELECT doc_id, i, word, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS repeated FROM windows),
gone AS (SELECT doc_id, i, word, bool_or(repeated) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM again),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS words FROM gone GROUP BY doc_id)
SELECT t.doc_id, len(t.words)::BIGINT AS n_words, coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.words, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k USING (doc_id)
"""
