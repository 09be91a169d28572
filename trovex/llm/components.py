"""Connected components by repeated contraction, each round a stored table; spanning forests of one task's links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovex.llm.common import small, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the stored edges (a, b); label is the smallest node of its component.

    In each round every node moves to the least of itself and its neighbours, and the edges follow; what both ends
    share is gone.  Rounds take turns between the order of the nodes, which ends stars at once, and a random order,
    which halves chains.  Labels are then carried back through the rounds.
    """
    spark = edges.sparkSession
    current = edges.select("a", "b").where("a <> b")
    moves: list[DataFrame] = []
    while True:
        current = stored(current, "edges")
        if current.isEmpty():
            break
        by_rank = len(moves) % 2
        rank, own_rank = (F.xxhash64(c, F.lit(len(moves))) if by_rank else F.col(c) for c in ("to", "node"))
        both = current.select(F.col("a").alias("node"), F.col("b").alias("to")).union(current.select(F.col("b").alias("node"), F.col("a").alias("to")))
        nearest = both.withColumn("rank", rank).groupBy("node").agg(F.min(F.struct("rank", "to")).alias("least"))
        move = stored(nearest.select("node", F.when(F.col("least.rank") < own_rank, F.col("least.to")).otherwise(F.col("node")).alias("to")), "moves")
        moves.append(move)
        near = move.select(F.col("node").alias("a"), F.col("to").alias("near"))
        far = move.select(F.col("node").alias("b"), F.col("to").alias("far"))
        current = current.join(near, "a").join(far, "b").where("near <> far").select(F.least("near", "far").alias("a"), F.greatest("near", "far").alias("b")).distinct()
    if not moves:
        return spark.createDataFrame([], "node long, label long")
    labels = moves[-1].select("node", F.col("to").alias("label"))
    for move in reversed(moves[:-1]):
        later = labels.select(F.col("node").alias("to"), "label")
        labels = stored(move.join(later, "to", "left").select("node", F.coalesce("label", "to").alias("label")), "labels")
    least = labels.groupBy("label").agg(F.min("node").alias("least"))
    least = stored(least.select("label", F.least("label", "least").alias("least")), "least")  # by itself, so that Spark may split the join of a large component
    return stored(labels.join(small(least), "label").select("node", F.col("least").alias("label")), "components")


def forest(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (left, right) that join the same rows and columns as a boolean matrix of links."""
    rows, columns = links.any(1).nonzero()[0], links.any(0).nonzero()[0]
    small = links[np.ix_(rows, columns)]
    met, reached = np.zeros(len(rows), bool), np.zeros(len(columns), bool)
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for r in range(len(rows)):
        front = np.array([r]) if not met[r] else np.empty(0, np.int64)
        met[front] = True
        while len(front):
            to = small[front] & ~reached
            new = to.any(0).nonzero()[0]
            left.append(rows[front[to[:, new].argmax(0)]] if len(new) else new)
            right.append(columns[new])
            reached[new] = True
            back = small[:, new] & ~met[:, None]
            front = back.any(1).nonzero()[0]
            left.append(rows[front])
            right.append(columns[new[back[front].argmax(1)]] if len(front) else front)
            met[front] = True
    return np.concatenate(left), np.concatenate(right)
