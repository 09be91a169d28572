"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Targets: the sources share a total by their weights; no target passes MOST times its source's size, and what is over
goes to the others by weight.  Documents are dealt to shards by the hash of their doc_id and text.  In a shard, each source's
documents, in seeded order, make one stream, cut into blocks of equal length.  All blocks that are given out are
apportioned to the sources by the highest quotients of what they should give over 1, 3, 5, ..., so remainders do not
add up over the shards.  A source's blocks are apportioned to its groups of GROUP shards in the same way, by the blocks
that they hold, and a group's to its shards.  Each shard's quota of a source is met with whole passes over the stream
and, for the rest, with blocks drawn by seeded hashes.  A document gives the words that its chosen blocks cover.

Documents are cut at block edges, so a document may give a part of its words, and in a second pass another part.
Null texts and texts without words have size 0 and give nothing.  Very long texts give blocks like others, from several
places.  A null source is a source, the last one.  Ties of the quotients go to the earlier source, and
within a source by seeded hashes.  Repeated rows are
documents of their own, each with its other columns; which of them gives which words is not said.  Empty tables give
empty results; other columns are ignored by mixed() and pass through chosen_texts().
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trovex.llm.common import BATCH_ROWS, WORD, WORD_SQL, bounded, private, slices, stored

#: Words of one block, about; each stream has the nearest whole number of them.
BLOCK = 128
#: Documents of one shard, about; shards of one group.
SHARD, GROUP = 2000, 1024
MOST = 2.0


def hashed(*parts: F.Column | str) -> F.Column:
    """Eight hexadecimal digits of md5 as a number: SQL engines agree on it."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, text_hash, size): size in words."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), "source", F.xxhash64("text").alias("text_hash"), F.regexp_count(text, F.lit(WORD_SQL)).cast("long").alias("size"))


def targets(sizes: DataFrame, weights: list[float], share: float) -> DataFrame:
    """(source, source_size, target): one row for each source, so its windows see as many rows as there are sources.

    Where the sources are sorted by what they can give for their weight, those that reach their limit come first, and
    the first level that the next source can meet, which is the highest such, holds for all others.
    """
    by_name = W.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(float(x)) for x in weights])
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rows = rows.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    rows = rows.withColumn("most", MOST * F.col("source_size")).withColumn("reach", F.col("most") / F.col("weight"))
    everything = W.partitionBy()
    order = W.orderBy("reach", F.col("source").isNull(), "source")
    done, todo = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.currentRow, W.unboundedFollowing)
    rows = rows.withColumn("left", share * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(done), F.lit(0.0)))
    rows = rows.withColumn("level", F.col("left") / F.sum("weight").over(todo))
    rows = rows.withColumn("level", F.max(F.when(F.col("level") <= F.col("reach"), F.col("level"))).over(everything))
    return rows.select("source", "source_size", F.least("most", F.coalesce(F.col("level") * F.col("weight"), "most")).alias("target"))


def quotas(votes: list[float], seats: int, most: list[int]) -> list[int]:
    """Sainte-Laguë: seats go to the highest of votes / 1, votes / 3, ..., none beyond most; ties to the earlier."""
    seats = min(seats, sum(most))
    total = sum(votes)
    given = [min(m, int(v * seats / total)) if total else 0 for v, m in zip(votes, most, strict=True)]
    more = [(-votes[i] / (2 * given[i] + 1), i) for i in range(len(votes)) if given[i] < most[i]]
    less = [(votes[i] / (2 * given[i] - 1), -i) for i in range(len(votes)) if given[i]]
    heapq.heapify(more)
    heapq.heapify(less)
    count = sum(given)

    def step(i: int, by: int) -> None:
        nonlocal count
        given[i] += by
        count += by
        if given[i] < most[i]:
            heapq.heappush(more, (-votes[i] / (2 * given[i] + 1), i))
        if given[i]:
            heapq.heappush(less, (votes[i] / (2 * given[i] - 1), -i))

    def top(heap: list[tuple[float, int]], now) -> tuple[float, int] | None:
        while heap and heap[0][0] != now(abs(heap[0][1])):
            heapq.heappop(heap)  # it changed since
        return heap[0] if heap else None

    rise = lambda i: -votes[i] / (2 * given[i] + 1) if given[i] < most[i] else None
    fall = lambda i: votes[i] / (2 * given[i] - 1) if given[i] else None
    while True:
        high, low = top(more, rise), top(less, fall)
        if count < seats and high:
            step(high[1], 1)
        elif count > seats and low:
            step(-low[1], -1)
        elif high and low and (-high[0], -high[1]) > (low[0], low[1]):
            step(-low[1], -1)
        else:
            return given


def placed(sizes: DataFrame, seed: int) -> DataFrame:
    """Adds shard, start and end: the place of each document with words in the stream of its source and shard."""
    shards = max(1, -(-sizes.count() // SHARD))
    rows = sizes.where("size > 0").withColumn("shard", hashed("doc_id", "text_hash", F.lit(f"shard{seed}")) % shards)
    order = W.partitionBy("source", "shard").orderBy(hashed("doc_id", F.lit(f"order{seed}")), "doc_id", "text_hash").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("end", F.sum("size").over(order))
    return rows.withColumn("start", F.col("end") - F.col("size"))


def shared_out(rows: DataFrame, key: list[str], order: list[str], columns: str) -> DataFrame:
    """columns and quota of rows that share seats by votes, within each key; ties to the first in order, null last.

    seats: what all rows of a key share, a null for the sum of their votes; most: seats that a row takes at most.
    """
    names = [c.split()[0] for c in columns.split(", ")]

    def apportion(group: pd.DataFrame) -> pd.DataFrame:
        text = lambda c: c.map(lambda x: None if x is None else x.encode() if isinstance(x, str) else x)
        group = group.sort_values(order, na_position="last", ignore_index=True, key=text)
        votes, seats = group["votes"].tolist(), group["seats"].iat[0]
        return group[names].assign(quota=quotas(votes, round(sum(votes)) if pd.isna(seats) else int(seats), group["most"].tolist()))

    return rows.groupBy(*key).applyInPandas(apportion, f"{columns}, quota long")


def streams(place: DataFrame, goal: DataFrame, seed: int = 1) -> DataFrame:
    """(source, shard, length, blocks, quota) of each stream: the sources share all blocks, then their groups of shards, then the shards."""
    rows = place.groupBy("source", "shard").agg(F.max("end").alias("length"))
    rows = rows.withColumn("blocks", F.greatest(F.lit(1), F.round(F.col("length") / BLOCK)).cast("long")).withColumn("part", F.floor(F.col("shard") / GROUP))
    rows = stored(rows.withColumn("draw", hashed(F.coalesce("source", F.lit("")), "shard", F.lit(f"shards{seed}"))), "shards")
    most = (F.col("blocks") * int(MOST)).alias("most")
    same = F.col("s.source").eqNullSafe(F.col("g.source"))
    of_source = rows.groupBy("source").agg(F.sum("blocks").alias("blocks")).alias("s").join(goal.alias("g"), same)
    votes = (F.col("g.target") / F.col("g.source_size") * F.col("s.blocks")).alias("votes")
    of_source = of_source.select("s.source", "s.blocks", votes, most, F.lit(None).cast("long").alias("seats"), F.lit(0).alias("all"))
    of_source = shared_out(of_source, ["all"], ["source"], "source string")  # a row for each source
    of_part = rows.groupBy("source", "part").agg(F.sum("blocks").alias("blocks"), F.min("draw").alias("draw")).alias("s").join(of_source.alias("g"), same)
    of_part = of_part.select("s.source", "s.part", "s.draw", F.col("s.blocks").cast("double").alias("votes"), most, F.col("g.quota").alias("seats"))
    of_part = shared_out(of_part, ["source"], ["draw", "part"], "source string, part long")  # a row for each group of shards
    of_shard = rows.alias("s").join(of_part.alias("g"), same & (F.col("s.part") == F.col("g.part")))
    of_shard = of_shard.select("s.source", "s.part", "s.shard", "s.draw", "s.length", "s.blocks", F.col("s.blocks").cast("double").alias("votes"), most, F.col("g.quota").alias("seats"))
    return shared_out(of_shard, ["source", "part"], ["draw", "shard"], "source string, shard long, length long, blocks long")


def chosen(stream: DataFrame, seed: int) -> DataFrame:
    """(source, shard, block, low, high, times): the words of each block that is taken, and how many times."""
    rows = stream.where("quota > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rank = F.row_number().over(W.partitionBy("source", "shard").orderBy(hashed(F.coalesce("source", F.lit("")), "shard", "block", F.lit(f"block{seed}")), "block"))
    times = F.floor(F.col("quota") / F.col("blocks")) + (rank <= F.col("quota") % F.col("blocks")).cast("long")
    edge = lambda i: F.expr(f"({i}) * length div blocks")
    return rows.select("source", "shard", "block", edge("block").alias("low"), edge("block + 1").alias("high"), times.alias("times")).where("times > 0")


def spans(place: DataFrame, stream: DataFrame, picks: DataFrame) -> DataFrame:
    """place's columns with low, high and times: words low to high of the document are taken so many times."""
    same = lambda a, b: (F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))) & (F.col(f"{a}.shard") == F.col(f"{b}.shard"))
    rows = place.alias("p").join(stream.alias("s"), same("p", "s")).select("p.*", "s.length", "s.blocks")
    # the block that holds word w is the last i with i * length div blocks <= w
    of = lambda w: F.expr(f"(({w} + 1) * blocks - 1) div length")
    rows = rows.withColumn("block", F.explode(F.sequence(of("start"), of("end - 1")))).drop("length", "blocks")
    picks = picks.hint("merge")  # as many rows as blocks, however few streams they come from
    rows = rows.alias("d").join(picks.alias("c"), same("d", "c") & (F.col("d.block") == F.col("c.block")))
    low, high = F.greatest("c.low", "d.start") - F.col("d.start"), F.least("c.high", "d.end") - F.col("d.start")
    return rows.select("d.*", low.alias("low"), high.alias("high"), "c.times").where("low < high")


def plan(docs: DataFrame, weights: list[float], share: float, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored sizes, targets and spans."""
    sizes = stored(sized(docs), "sizes")
    goal = stored(targets(sizes, weights, share), "targets")
    place = stored(placed(sizes, seed), "places")
    stream = stored(streams(place, goal, seed), "streams")
    return sizes, goal, spans(place, stream, chosen(stream, seed))


def mixed(docs: DataFrame, weights: list[float] = (5.0, 2.0, 1.0), share: float = 1.5, seed: int = 1) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document."""
    sizes, goal, parts = plan(docs, list(weights), share, seed)
    key = ["doc_id", "source", "text_hash", "start"]
    took = parts.groupBy(*key).agg(F.sum((F.col("high") - F.col("low")) * F.col("times")).alias("took"))
    # equal rows are alike to the reader: number them on both sides
    took = took.withColumn("copy", F.row_number().over(W.partitionBy("doc_id", "source", "text_hash").orderBy("start")))
    rows = sizes.withColumn("copy", F.row_number().over(W.partitionBy("doc_id", "source", "text_hash").orderBy("size")))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}")) for c in ("doc_id", "source", "text_hash", "copy")]
    rows = rows.alias("r").join(took.alias("t"), same[0] & same[1] & same[2] & same[3], "left").select("r.doc_id", "r.source", "r.size", F.coalesce("t.took", F.lit(0)).alias("taken"))
    rows = rows.alias("r").join(goal.alias("g"), F.col("r.source").eqNullSafe(F.col("g.source")))
    return rows.select("r.doc_id", "r.size", "g.source_size", "g.target", F.col("r.taken").cast("long").alias("taken"))


def chosen_texts(docs: DataFrame, weights: list[float] = (5.0, 2.0, 1.0), share: float = 1.5, seed: int = 1) -> DataFrame:
    """The mix as documents with the columns of docs: one row for each pass over a document, with the words it takes."""
    sizes, _, parts = plan(docs, list(weights), share, seed)
    key = ["doc_id", "source", "text_hash"]
    one = parts.groupBy(*key, "start").agg(F.sort_array(F.collect_list(F.struct("low", "high", "times"))).alias("spans"))  # the blocks of one document
    bounded(docs.sparkSession)
    names, kinds = docs.columns, docs.schema
    mark, copy, taken_words = private(docs, "text_hash"), private(docs, "copy"), private(docs, "spans")
    own = docs.withColumn(mark, F.xxhash64("text"))
    if sizes.groupBy(*key).count().where("count > 1").isEmpty():
        own, one = own.withColumn(copy, F.lit(1)), one.withColumn("copy", F.lit(1))
    else:  # equal rows are numbered on both sides
        own = own.withColumn(copy, F.row_number().over(W.partitionBy("doc_id", "source", mark).orderBy(mark)))
        one = one.withColumn("copy", F.row_number().over(W.partitionBy(*key).orderBy("start")))
    wanted = stored(one, "spans")
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"w.{k}")) for c, k in zip(("doc_id", "source", mark, copy), (*key, "copy"), strict=True)]
    rows = own.alias("d").join(wanted.alias("w"), same[0] & same[1] & same[2] & same[3]).select(*[F.col(f"d.{c}") for c in names], F.col("w.spans").alias(taken_words))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BATCH_ROWS):
            at, texts = [], []
            for i, (text, taken) in enumerate(zip(batch.column("text").to_pylist(), batch.column(taken_words).to_pylist(), strict=True)):
                words = np.fromiter((x for m in WORD.finditer(text) for x in m.span()), np.int64).reshape(-1, 2)
                for k in range(max(x["times"] for x in taken)):
                    at.append(i)
                    texts.append(joined(text, words, [(x["low"], x["high"]) for x in taken if x["times"] > k]))
            out = batch.select(names).take(pa.array(at, pa.int64()))
            for name, values in (("text", texts), ("n_chars", list(map(len, texts)))):
                if name in names:
                    k = names.index(name)
                    out = out.set_column(k, out.schema.field(k), pa.array(values).cast(out.schema.field(k).type))
            yield out

    return rows.mapInArrow(cut, kinds)


def joined(text: str, words: np.ndarray, parts: list[tuple[int, int]]) -> str:
    """The text of runs of words, with the white space within each run; runs that meet are one."""
    runs: list[list[int]] = []
    for low, high in parts:
        if runs and runs[-1][1] == low:
            runs[-1][1] = high
        else:
            runs.append([low, high])
    if runs == [[0, len(words)]]:
        return text
    return "\n".join(text[words[a, 0] : words[b - 1, 1]] for a, b in runs)
