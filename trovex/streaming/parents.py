"""Paths of changed files, resolved in the stream by a bounded cache of parents.

The state of a volume is a map frn -> (parent, name, last use), kept up by the changes themselves: creates and renames
put a node there, deletes remove it.  A change's path is walked up through the map; where a parent is not there, the
walk stops, and the path is completed from the table of paths.  At most MOST entries are kept: when there are more after
a micro-batch, those that were used longest ago go until half are left.  Entries also expire with a time to live.

Changes of one volume are taken in order, by one task, as the parents of one may be the children of another; volumes
run side by side.  Needs the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from trovex.streaming.cdc import DELETE

#: Entries of a volume at most; levels of a walk.
MOST, DEEPEST = 100_000, 50
CHANGE = "volume string, seq long, frn long, parent_frn long, name string, reason int"
RESOLVED = "volume string, seq long, frn long, tail string, missing long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Parents(StatefulProcessor):
    def __init__(self, root: int, most: int, ttl_seconds: int | None):
        self.root, self.most, self.ttl = root, most, ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = self.ttl * 1000 if self.ttl else None
        self.parents = handle.getMapState("parents", "frn long", "parent long, name string, used long", ttl)
        self.size = handle.getValueState("size", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        changes = pd.concat(list(rows)).sort_values("seq", kind="stable")  # one micro-batch of one volume
        met: dict[int, tuple[int, str, int] | None] = {}  # what this batch has read or changed; null: not there
        new, out = 0, []

        def entry(frn: int) -> tuple[int, str, int] | None:
            if frn not in met:
                met[frn] = tuple(self.parents.getValue((frn,))) if self.parents.containsKey((frn,)) else None
            return met[frn]

        for seq, frn, parent, name, reason in changes[["seq", "frn", "parent_frn", "name", "reason"]].itertuples(index=False, name=None):
            new += entry(frn) is None
            met[frn] = (parent, name, seq)
            parts, at = [], frn
            while at != self.root and len(parts) < DEEPEST and (node := entry(at)):
                met[at] = (node[0], node[1], seq)  # used now
                parts.append(node[1])
                at = node[0]
            out.append((key[0], seq, frn, "\\".join(reversed(parts)), None if at == self.root else at))
            if reason & DELETE:
                met[frn] = None
        for frn, node in met.items():
            if node:
                self.parents.updateValue((frn,), node)
            elif self.parents.containsKey((frn,)):
                self.parents.removeKey((frn,))
        held = (self.size.get()[0] if self.size.exists() else 0) + new  # no fewer than there are
        if held > self.most:
            last_uses = sorted((v[2], k[0]) for k, v in self.parents.iterator())
            for _, frn in last_uses[: len(last_uses) - self.most // 2] if len(last_uses) > self.most else []:
                self.parents.removeKey((frn,))
            held = min(len(last_uses), self.most // 2) if len(last_uses) > self.most else len(last_uses)
        self.size.update((held,))
        frame = pd.DataFrame(out, columns=["volume", "seq", "frn", "tail", "missing"])
        yield frame.astype({"missing": "Int64"})

    def close(self) -> None:
        pass


def resolved(changes: DataFrame, root: int = 0, most: int = MOST, ttl_seconds: int | None = None) -> DataFrame:
    """(volume, seq, frn, tail, missing) of a stream of changes: the path below missing, or the whole path where that is null."""
    mode = "processingTime" if ttl_seconds else "None"
    return changes.groupBy("volume").transformWithStateInPandas(Parents(root, most, ttl_seconds), RESOLVED, "append", mode)


def completed(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """(volume, seq, frn, path, complete) of resolved rows, with what paths (volume, frn, path) has of missing parents."""
    known = paths.select(F.col("volume").alias("_volume"), F.col("frn").alias("_frn"), F.col("path").alias("_above"))
    both = rows.join(known, (F.col("volume") == F.col("_volume")) & (F.col("missing") == F.col("_frn")), "left")
    path = F.when(F.col("_above").isNotNull(), F.concat_ws("\\", "_above", F.when(F.col("tail") != "", F.col("tail")))).otherwise(F.col("tail"))
    return both.select("volume", "seq", "frn", path.alias("path"), (F.col("missing").isNull() | F.col("_above").isNotNull()).alias("complete"))
