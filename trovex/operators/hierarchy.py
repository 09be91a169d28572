"""Trees: paths from parent pointers, and nested JSON folders as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovex.sources.shared import stored

#: Levels of a path; what lies deeper, or in a cycle, is not reached from a root and has no row.
DEEPEST = 50


def paths(edges: DataFrame, root: int = 0, deepest: int = DEEPEST) -> DataFrame:
    """(frn, path, depth) of every node that a root leads to within deepest levels.

    Each level is one join of the level before with the edges, written to the shared folder, so the lineage stays short
    and a lost executor costs one level.
    """
    rows = stored(edges.select("frn", "parent_frn", "name"), "edges")
    level = stored(rows.where(F.col("parent_frn") == root).select("frn", F.col("name").alias("path"), F.lit(1).alias("depth")), "level")
    found = [level]
    while not level.isEmpty() and len(found) < deepest:
        up = level.select(F.col("frn").alias("parent_frn"), F.col("path").alias("above"), "depth")
        step = rows.join(up, "parent_frn").select("frn", F.concat("above", F.lit("\\"), "name").alias("path"), (F.col("depth") + 1).alias("depth"))
        level = stored(step, "level")
        found.append(level)
    return reduce(DataFrame.union, found)


NODE = "type string, name string, url string, children array<string>"


def flattened(trees: DataFrame, key: str, json: str) -> DataFrame:
    """(key, title, url, folder) of every leaf with a url; folder names the folders above it, joined by /.

    Each level opens the folders of the one before.  Nodes are read with one schema, their children as JSON text, so a
    tree of any shape fits.  A level is written to the shared folder, and the last is the one without folders to open.
    """
    node = stored(trees.select(key, F.from_json(json, NODE).alias("n"), F.lit("").alias("folder")), "level")
    out = []
    while not node.isEmpty():
        out.append(node.where("n.url is not null").select(key, F.col("n.name").alias("title"), F.col("n.url").alias("url"), "folder"))
        inner = F.when(F.col("folder") == "", F.col("n.name")).otherwise(F.concat("folder", F.lit("/"), "n.name"))
        below = node.where("n.children is not null").select(key, F.explode("n.children").alias("child"), inner.alias("folder"))
        node = stored(below.select(key, F.from_json("child", NODE).alias("n"), "folder"), "level")
    return reduce(DataFrame.union, out) if out else node.select(key, F.col("n.name").alias("title"), F.col("n.url").alias("url"), "folder")
