"""A Merkle manifest of documents: leaves by source, a tree for each source, a tree over the sources, and proofs.

Leaves are numbered within their source in order, by a range partitioning, so every tree's sizes are known before a
digest is made, and with them how many children each parent has: ARITY, or what is left at the end of a level.

Digests climb as events.  A parent that has met some of its children is partial, and keeps their digests by number; the
child that completes it makes its digest, which is then an event for its own parent.  Each task does so with the leaves
that it reads, which follow each other, so nearly all parents complete before anything is shuffled (the map side of a
combineByKey).  What is left of partial parents at a task's edges, the unresolved frontier, is dealt by the ancestor
LEVELS levels up, completes there, and the ancestors are the leaves of the next round.

Proofs take the reverse links from the top: a block below one ancestor gets that ancestor's path, and adds the
siblings of its own LEVELS levels.  A task holds one block of ARITY ** LEVELS nodes at a time.

Null columns have a mark of their own in the leaf, and a null source is the first group.  Null doc_ids come first in
their source and are never tampered with.  Rows with one doc_id are ordered by their leaves; fully equal rows are
leaves of their own.  Very long texts are hashed whole by built-in functions.  An empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trovex.llm.common import longs, small, stored

ARITY, LEVELS = 3, 5
BLOCK = ARITY**LEVELS
#: Rows of one range of an order, about, and fewest ranges.
RANGE_ROWS, RANGES = 50_000, 8
NODE = "tree long, n long, level int, idx long, digest string"


def digest_of(parts: str) -> str:
    return hashlib.sha256(parts.encode()).hexdigest()


def field(c: Column) -> Column:
    """A value with its length, or the mark of null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*columns: Column) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def depth_of(n: int) -> int:
    """Levels above the leaves."""
    depth = 0
    while n > 1:
        n, depth = -(-n // ARITY), depth + 1
    return depth


def width_of(n: int, level: int) -> int:
    """Nodes of a level of a tree of n leaves."""
    return -(-n // ARITY**level)


def numbered_in_order(df: DataFrame, *order: str) -> DataFrame:
    """Stored df with place: a gapless number from 0 in ascending order, nulls first, without a task that holds all rows.

    The rows are dealt by ranges of the order, which should tell rows apart; places follow from the ranges' sizes.
    """
    ranges = max(RANGES, -(-df.count() // RANGE_ROWS))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            yield batch.append_column("_within", longs(np.arange(at, at + batch.num_rows)))
            at += batch.num_rows

    dealt = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id())
    rows = stored(dealt.mapInArrow(run, f"{kinds}, _range int, _within long"), "ordered")
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # a row for each range
    return rows.join(F.broadcast(sizes), "_range").select(*df.columns, (F.col("_before") + F.col("_within")).alias("place"))


class Partial:
    """Parents that have met some of their children."""

    def __init__(self, top: int):
        self.top = top
        self.children: dict[tuple[int, int, int], dict[int, str]] = {}
        self.sizes: dict[int, int] = {}

    def met(self, tree: int, n: int, level: int, idx: int, digest: str) -> Iterator[tuple[int, int, int, int, str]]:
        """Takes a node; gives it back, or the ancestor it completes, once that stands at the top."""
        self.sizes[tree] = n
        while level < self.top and width_of(n, level) > 1:
            at = tree, level + 1, idx // ARITY
            own = self.children.setdefault(at, {})
            own[idx % ARITY] = digest
            if len(own) < min(ARITY, width_of(n, level) - ARITY * at[2]):
                return
            del self.children[at]
            digest = digest_of("".join(own[i] for i in sorted(own)))
            level, idx = level + 1, at[2]
        yield tree, n, level, idx, digest

    def unresolved(self) -> Iterator[tuple[int, int, int, int, str]]:
        for (tree, level, parent), own in self.children.items():
            for i, digest in own.items():
                yield tree, self.sizes[tree], level - 1, parent * ARITY + i, digest
        self.children.clear()


def combined(nodes: DataFrame, top: int) -> DataFrame:
    """The events of each partition's nodes up to a level: nodes at the top, and what stays unresolved."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        tree, n, level, idx, digest = zip(*rows, strict=True) if rows else ((),) * 5
        return pa.record_batch([longs(list(tree)), longs(list(n)), pa.array(level, pa.int32()), longs(list(idx)), pa.array(digest, pa.string())], ["tree", "n", "level", "idx", "digest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partial = Partial(top)
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            yield batch_of([x for row in rows for x in partial.met(*row)])
        yield batch_of(list(partial.unresolved()))

    return nodes.select("tree", "n", "level", "idx", "digest").mapInArrow(run, NODE)


def block(level: Column, idx: Column, top: int) -> Column:
    """The number at the top level of a node's ancestor."""
    power = F.lit(1).cast("long")
    for k in range(1, LEVELS + 1):
        power = F.when(level == top - k, F.lit(ARITY**k)).otherwise(power)
    return F.floor(idx / power)  # numbers stay below 2^53


def rounds_of(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of levels 0, LEVELS, 2 * LEVELS, ... of trees with leaves (tree, n, idx, digest), each a stored table, and the roots (tree, digest).

    A tree that ends between two of these levels has its root in the later table.
    """
    rounds = [leaves.select("tree", "n", F.lit(0).alias("level"), "idx", "digest")]
    deepest = depth_of(leaves.agg(F.max("n")).first()[0] or 0)
    for top in range(LEVELS, deepest + LEVELS, LEVELS):
        met = stored(combined(rounds[-1], top), "frontier")
        is_open = (F.col("level") < top) & (F.col("n") > F.pow(F.lit(float(ARITY)), "level"))  # not a root
        frontier = met.where(is_open).repartition("tree", block(F.col("level"), F.col("idx"), top))
        rounds.append(stored(met.where(~is_open).union(combined(frontier, top)), "nodes"))
    return rounds, rounds[-1].where("idx = 0").select("tree", "digest")


def levels_above(digests: list[str], steps: int) -> list[list[str]]:
    """A block's levels, from its lowest on; a lone child has a parent, too."""
    levels = [digests]
    for _ in range(steps):
        below = levels[-1]
        levels.append([digest_of("".join(below[i : i + ARITY])) for i in range(0, len(below), ARITY)])
    return levels


def own_path(levels: list[list[str]], i: int, steps: int) -> str:
    """For each step up: the place among the children, the number of siblings, and the siblings."""
    out = []
    for row in levels[:steps]:
        run, at = row[i // ARITY * ARITY : i // ARITY * ARITY + ARITY], i % ARITY
        out.append(f"{at}{len(run) - 1}{''.join(run[:at])}{''.join(run[at + 1 :])}")
        i //= ARITY
    return "".join(out)


def steps_of(path: str) -> Iterator[tuple[str, str]]:
    """(siblings to the left, siblings to the right) of each step of a path."""
    at = 0
    while at < len(path):
        place, others = int(path[at]), int(path[at + 1])
        yield path[at + 2 : at + 2 + 64 * place], path[at + 2 + 64 * place : at + 2 + 64 * others]
        at += 2 + 64 * others


def folded(leaf: str, path: str) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in steps_of(path):
        leaf = digest_of(left + leaf + right)
    return leaf


def proof_of(path: str) -> str:
    """The digest of all siblings of a path."""
    return digest_of("".join(left + right for left, right in steps_of(path)))


def with_paths(nodes: DataFrame, level: int, above: DataFrame, kept: list[str], told: list[str]) -> DataFrame:
    """(tree, idx, path, kept columns of nodes, told columns of above) for the nodes of one round; above has (tree, block, path, told columns)."""
    kinds = {f.name: f.dataType.simpleString() for f in [*nodes.schema, *above.schema]}
    names = ["tree", "idx", "path", *kept, *told]
    schema = ", ".join(f"`{c}` {'string' if c == 'path' else kinds[c]}" for c in names)

    def run(own: pa.Table, top: pa.Table) -> pa.Table:
        if not own.num_rows:  # a tree that ends below this round
            return pa.table([pa.array([], pa.int64() if c in ("tree", "idx", "doc_id") else pa.string()) for c in names], names)
        own = own.sort_by("idx")
        steps = min(LEVELS, depth_of(own.column("n")[0].as_py()) - level)
        levels = levels_above(own.column("digest").to_pylist(), steps)
        first, above_path = own.column("idx")[0].as_py() // BLOCK * BLOCK, top.column("path")[0].as_py()
        paths = [own_path(levels, i - first, steps) + above_path for i in own.column("idx").to_pylist()]
        columns = [own.column("tree"), own.column("idx"), pa.array(paths, pa.string()), *[own.column(c) for c in kept]]
        columns += [pa.array([top.column(c)[0].as_py()] * own.num_rows, own.schema.field("digest").type) for c in told]
        return pa.table(columns, names)

    own = nodes.select("tree", F.floor(F.col("idx") / BLOCK).alias("block"), "n", "idx", "digest", *[c for c in kept if c != "digest"])
    return own.groupBy("tree", "block").cogroup(above.select("tree", "block", "path", *told).groupBy("tree", "block")).applyInArrow(run, schema)


def proofs(leaves: DataFrame, roots: DataFrame, rounds: list[DataFrame], kept: list[str], told: list[str]) -> DataFrame:
    """The paths of all leaves (tree, n, idx, digest, kept columns); roots has (tree, path, told columns): where each tree's own root stands above."""
    above = roots.select("tree", F.lit(0).cast("long").alias("block"), "path", *told)
    for r in reversed(range(1, len(rounds) - 1)):
        inner = rounds[r].where(F.col("level") == r * LEVELS)  # not the roots of trees that end below
        shallow = above.where("block = 0")
        above = with_paths(inner, r * LEVELS, above, [], told).select("tree", F.col("idx").alias("block"), "path", *told)
        above = above.unionByName(shallow.join(inner.select("tree").distinct(), "tree", "left_anti"))
    return with_paths(leaves, 0, above, kept, told)


def leaves_of(docs: DataFrame) -> DataFrame:
    """Stored (doc_id, source, digest, changed, salt): changed is the leaf of a tampered row, null where none was."""
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    changed = F.when(tampered, leaf_of(*columns[:-1], F.replace(F.col("text"), F.lit("\n"), F.lit(""))))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), leaf_of(*columns).alias("digest"), changed.alias("changed"))
    return stored(rows.withColumn("salt", F.xxhash64(F.monotonically_increasing_id())), "leaves")


def placed(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves with (tree, n, idx): their source's number and size, and their place in it; the sources (tree, n)."""
    ordered = stored(numbered_in_order(leaves, "source", "doc_id", "digest", "salt"), "placed")
    sources = ordered.groupBy("source").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    sources = stored(numbered_in_order(stored(sources, "sources"), "source").withColumnRenamed("place", "tree"), "trees")
    of = small(sources.select(F.col("source").alias("_source"), "first", "n", "tree"))
    rows = ordered.join(of, F.col("source").eqNullSafe(F.col("_source")))
    return stored(rows.select("tree", "n", (F.col("place") - F.col("first")).alias("idx"), "digest", "doc_id", "changed"), "leaves"), sources


def verified(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row."""
    leaves, sources = placed(leaves_of(docs))
    rounds, roots = rounds_of(leaves)
    count = sources.count()
    tops = stored(roots.select(F.lit(0).cast("long").alias("tree"), F.lit(count).cast("long").alias("n"), F.col("tree").alias("idx"), "digest"), "subroots")
    top_rounds, top_root = rounds_of(tops)
    root = (top_root.first() or [None, ""])[1]
    no_path = docs.sparkSession.createDataFrame([(0, "")], "tree long, path string").coalesce(1)
    upper = proofs(tops, no_path, top_rounds, ["digest"], [])
    upper = stored(upper.select(F.col("idx").alias("tree"), "path", F.col("digest").alias("subroot")), "upper")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            paths = columns["path"].to_pylist()
            got = [folded(changed or leaf, path) for changed, leaf, path in zip(columns["changed"].to_pylist(), columns["digest"].to_pylist(), paths, strict=True)]
            out = [columns["doc_id"], columns["digest"], columns["subroot"], pa.array([root] * len(got), pa.string()), pa.array(map(proof_of, paths), pa.string()), pa.array(got, pa.string()), pa.array([x == root for x in got], pa.bool_())]
            yield pa.record_batch(out, ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    paths = proofs(leaves, upper, rounds, ["doc_id", "digest", "changed"], ["subroot"])
    return paths.mapInArrow(fold, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


#: The same for DuckDB: levels, then each leaf's way up its own tree and the tree of subroots; a crc32 bit by bit.
SQL = r"""
WITH RECURSIVE raw AS (
  SELECT row_number() OVER () AS id, doc_id, source, xor(list_reduce(list_prepend(4294967295, list_transform(range(8 * strlen(CAST(doc_id AS VARCHAR))),
      lambda i: (ascii(substr(CAST(doc_id AS VARCHAR), i // 8 + 1, 1)) >> (i % 8)::INT) & 1)), lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295) % 2 = 0 AS even,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head, text, replace(text, chr(10), '') AS cut
  FROM documents),
leaves AS (
  SELECT id, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN even THEN sha256(head || coalesce(strlen(cut) || ':' || cut, '-')) END AS changed FROM raw),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY source) AS n,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, id) - 1 AS idx FROM leaves),
nodes AS (
  SELECT tree, n, 0 AS level, idx, leaf AS digest FROM placed
  UNION ALL
  SELECT tree, (n + 2) // 3, level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY tree, n, level, idx // 3),
subroots AS (SELECT tree, digest, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT n, 0 AS level, tree AS idx, digest FROM subroots
  UNION ALL
  SELECT (n + 2) // 3, level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY n, level, idx // 3),
kids AS (
  SELECT tree, level, idx // 3 AS parent, max(digest) FILTER (idx % 3 = 0) AS a, max(digest) FILTER (idx % 3 = 1) AS b, max(digest) FILTER (idx % 3 = 2) AS c
  FROM (SELECT tree, level, idx, digest FROM nodes UNION ALL SELECT -1, level, idx, digest FROM tops) GROUP BY ALL),
low AS (
  SELECT id, tree, n, 0 AS level, idx, coalesce(changed, leaf) AS digest, '' AS proof FROM placed
  UNION ALL
  SELECT id, w.tree, (n + 2) // 3, w.level + 1, idx // 3,
    sha256((CASE WHEN idx % 3 = 0 THEN digest ELSE a END) || coalesce(CASE WHEN idx % 3 = 1 THEN digest ELSE b END, '') || coalesce(CASE WHEN idx % 3 = 2 THEN digest ELSE c END, '')),
    proof || (CASE WHEN idx % 3 = 0 THEN '' ELSE a END) || coalesce(CASE WHEN idx % 3 = 1 THEN '' ELSE b END, '') || coalesce(CASE WHEN idx % 3 = 2 THEN '' ELSE c END, '')
  FROM low w JOIN kids k ON k.tree = w.tree AND k.level = w.level AND k.parent = w.idx // 3 WHERE n > 1),
high AS (
  SELECT id, s.n, 0 AS level, low.tree AS idx, low.digest, proof FROM low JOIN subroots s USING (tree) WHERE low.n = 1
  UNION ALL
  SELECT id, (n + 2) // 3, w.level + 1, idx // 3,
    sha256((CASE WHEN idx % 3 = 0 THEN digest ELSE a END) || coalesce(CASE WHEN idx % 3 = 1 THEN digest ELSE b END, '') || coalesce(CASE WHEN idx % 3 = 2 THEN digest ELSE c END, '')),
    proof || (CASE WHEN idx % 3 = 0 THEN '' ELSE a END) || coalesce(CASE WHEN idx % 3 = 1 THEN '' ELSE b END, '') || coalesce(CASE WHEN idx % 3 = 2 THEN '' ELSE c END, '')
  FROM high w JOIN kids k ON k.tree = -1 AND k.level = w.level AND k.parent = w.idx // 3 WHERE n > 1)
SELECT p.doc_id, p.leaf, s.digest AS subroot, t.digest AS root, sha256(h.proof) AS proof_sha256, h.digest AS folded_root, h.digest = t.digest AS verified
FROM placed p JOIN subroots s USING (tree) JOIN high h ON h.id = p.id AND h.n = 1 JOIN tops t ON t.n = 1
"""
