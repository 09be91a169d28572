"""Shards by a weighted hash tree: a key descends region, rack and shard by the best weighted draw among siblings.

At each node every child draws -ln(u) / weight, with u from the hash of key and child, and the least draw wins.  A
child's draw falls as its weight grows and depends on nothing else, so a change of weights moves keys only into
subtrees that gained and out of those that lost.  Where a new shard opens a region of its own, it alone gains.

Null doc_ids draw like one key.  Null texts count as empty, and very long ones by their bytes, which are hashed where they
are read.  Draws that tie go to the child whose name comes first, slots to the smaller checksum and size.  Repeated rows
get slots of their own.  Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovex.llm.common import numbered, unsigned_draw


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def even_tree(shards: int, per_rack: int = 4, racks: int = 2) -> list[Leaf]:
    """Shards of equal weight, racks of per_rack shards, regions of racks; number 24 opens region 3 by itself."""
    return [Leaf(f"region{s // (per_rack * racks)}", f"rack{s // per_rack}", s) for s in range(shards)]


def levels(leaves: list[Leaf]) -> tuple[list[dict[str, list[tuple[str, float]]]], dict[str, int]]:
    """Children with their weights by node, for each level below the root; shard by the name of its leaf."""
    out: list[dict[str, dict[str, float]]] = [{}, {}, {}]
    names = {}
    for x in leaves:
        path = ["", x.region, f"{x.region}/{x.rack}", f"{x.region}/{x.rack}/{x.shard}"]
        names[path[3]] = x.shard
        for k in range(3):
            children = out[k].setdefault(path[k], {})
            children[path[k + 1]] = children.get(path[k + 1], 0.0) + x.weight
    return [{node: sorted(c.items()) for node, c in level.items()} for level in out], names


def descend(key: Column, leaves: list[Leaf]) -> Column:
    """The shard of a key."""
    steps, names = levels(leaves)
    node: Column = F.lit("")
    for level in steps:
        children = F.create_map(*[x for n, c in level.items() for x in (F.lit(n), F.array(*[F.struct(F.lit(child).alias("name"), F.lit(w).alias("weight")) for child, w in c if w > 0]))])
        node = F.array_min(F.transform(children[node], lambda c: F.struct((-F.ln(unsigned_draw(key, c["name"])) / c["weight"]).alias("draw"), c["name"].alias("name"))))["name"]
    return F.create_map(*[x for n, s in names.items() for x in (F.lit(n), F.lit(s))])[node].cast("int")


def sharded(docs: DataFrame, leaves: list[Leaf], grown: list[Leaf]) -> DataFrame:
    """Each document's size, checksum, shard, slot in it, and the shard it has in the grown tree."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.col("doc_id")
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        descend(key, leaves).alias("shard"),
        descend(key, grown).alias("grown_shard"),
    )
    out = numbered(rows, ["shard"], [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "slot")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long"), "grown_shard")
