"""N-gram Jaccard join by parity sketches.

A document's set holds the hashes of its distinct word shingles.  Equal sets are one node, so copies cost one node
however many there are.  For each band of set sizes the hashes are dealt to m parts, and each part keeps the XOR
(parity) of its hashes.  A part's parity can differ only where the sets differ in that part, so the count of differing
parts, the Hamming distance of these sketches, is at most the symmetric difference.  A pair that links in a band
differs in at most d elements and m > d, hence it shares a part: the sketches join on (band, part, parity), with
nothing lost.  Empty parts are not joined on unless a set has so few others that nothing else is certain; m leaves
room for the empty parts that are to be expected.

Parts with the same members count once.  The members of a part are compared in blocks by a bit sketch of the whole set,
whose Hamming distance is again at most the symmetric difference.  A block gives a forest of the pairs that may link,
never all of them: as many rows as it has members.  The forests join into clusters, outside which nothing links, and
each cluster is verified on whole sets, by the counts of shared elements, whatever the number of parts that its members
share.  A block of a cluster gives a forest of its own verified links.  Clusters of several blocks go on by components:
first one set of each component is compared with those of the others, and only where components stay apart are their
members compared, those of different components alone.  So sets that link travel once or twice, and pairs of blocks
are made of what does not link, although its sketches could not rule it out.

Null and empty texts have an empty set and link with nothing.  Very long texts are taken whole: their sketches have a
bit an element, and a block of a cluster holds as many sets as ELEMENTS allows.  Repeated rows are copies.  A null
doc_id takes part; its component is the smallest doc_id that is not null.  Ties do not arise, as a component is named by
its smallest doc_id.  Empty tables give empty results; other columns are ignored by joined() and kept by one_of_each().
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovex.llm.common import WORD, binaries, bounded, longs, lower_ascii, private, slices, small, stored, strings
from trovex.llm.components import components, forest

#: Ratio of the largest to the smallest size in a band.
BAND = 1.25
#: Least bits of the sketch of a whole set; a larger set has a bit an element at least, else its sketch would tell nothing.
BITS = 2048
#: Members of one block of a part or cluster, and elements of the sets of one block of a cluster, about.
BLOCK, ELEMENTS = 1024, 1 << 20
#: Cells of the matrix of sets and elements that is held at a time.
CELLS = 1 << 22
#: Word hashes that a worker keeps, about 130 bytes each.
KEPT = 100_000
MIX1, MIX2, STEP = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Rule:
    """Shingles of n words; sets link where 100 * intersection >= percent * union."""

    n: int
    percent: int

    def apart(self, both: int) -> int:
        """The largest symmetric difference of linked sets whose sizes add up to both."""
        return both * (100 - self.percent) // (100 + self.percent)

    def bands(self, size: int) -> list[int]:
        """The bands in which a set of this size may meet one as large or larger, or smaller: its own, and that of its largest partner."""
        own, last = band_of(size), band_of(size * 100 // self.percent)
        return list(range(own, last + 1))

    def parts(self, band: int) -> tuple[int, int]:
        """(d, m) of a band."""
        low, high = LOWS[band], LOWS[band + 1] - 1
        d = self.apart(2 * high)
        m = d + 1
        for _ in range(20):  # until the room for empty parts fits m
            empty = m * math.exp(-low / m)
            more = d + 1 + math.ceil(empty + 5 * math.sqrt(empty) + 0.5) if d else 1
            if more <= m:
                break
            m = more
        return d, m


def lows() -> list[int]:
    """The smallest size in each band."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, math.ceil(out[-1] * BAND)))
    return out


LOWS = lows()


def band_of(size: int) -> int:
    return int(np.searchsorted(LOWS, size, "right")) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * MIX1
    x = (x ^ (x >> np.uint64(33))) * MIX2
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        from xxhash import xxh3_64_intdigest

        self[word] = h = xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_hashes = WordHashes()


def shingle_sets(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """All sets one after another, each sorted, and their sizes."""
    if len(_hashes) > KEPT:
        _hashes.clear()
    found, sizes = [], []
    for text in texts:
        words = WORD.findall(lower_ascii(text))
        w = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
        if len(w) >= n:
            h = w[: len(w) - n + 1]
            for k in range(1, n):
                h = h * STEP + w[k : len(w) - n + 1 + k]
            h = mixed(h)
            h.sort()
        elif len(w):
            h = np.array([len(w)], np.uint64)
            for x in w:
                h = h * STEP + x
            h = mixed(h)
        else:
            h = w
        found.append(h)
        sizes.append(len(h))
    flat, ends = np.concatenate(found) if found else np.empty(0, np.uint64), np.cumsum(sizes)
    first = np.ones(len(flat), bool)
    first[1:] = flat[1:] != flat[:-1]
    starts = (ends - sizes)[np.array(sizes, bool)] if len(sizes) else ends
    first[starts] = True
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return flat[first], np.bincount(owner[first], minlength=len(sizes)).astype(np.int64)


def node_of(own: np.ndarray) -> int:
    """The hash of a set, as a signed 64-bit integer."""
    from xxhash import xxh3_64_intdigest

    h = xxh3_64_intdigest(own.tobytes())
    return h - (1 << 64) if h >= 1 << 63 else h


def part_keys(flat: np.ndarray, sizes: np.ndarray, rule: Rule, bands: np.ndarray, plans: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the parts of each set in its band of bands (-1: none), and the set that each belongs to."""
    d = np.array([plans[b][0] if b >= 0 else 0 for b in bands.tolist()], np.int64)
    m = np.array([plans[b][1] if b >= 0 else 1 for b in bands.tolist()], np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    keep = d[owner] > 0
    h, owner = flat[keep], owner[keep]
    if not len(h):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    part = ((h >> np.uint64(32)) * m[owner].astype(np.uint64)) >> np.uint64(32)
    at = (owner.astype(np.uint64) << np.uint64(32)) | part  # sorted, as the sets are
    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    parity = np.bitwise_xor.reduceat(mixed(h * STEP), starts)
    whose, part = owner[starts], part[starts]
    full = np.bincount(whose, minlength=len(sizes))
    few = np.flatnonzero((full <= d) & (d > 0))
    for k in few:  # the empty parts too: these sets have too few others
        empty = np.setdiff1d(np.arange(m[k]), part[whose == k].astype(np.int64)).astype(np.uint64)
        whose, part, parity = np.concatenate([whose, np.full(len(empty), k)]), np.concatenate([part, empty]), np.concatenate([parity, np.zeros(len(empty), np.uint64)])
    salt = (bands[whose].astype(np.uint64) << np.uint64(40)) + part
    return mixed(parity + mixed(salt * STEP + np.uint64(1))).view(np.int64), whose


def sketches(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, text_hash, n_shingles, node, bits, keys): a node's bits and keys stand at its first document in each task."""
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        plans = {b: rule.parts(b) for b in range(80)}
        for part in slices(batches, 250):
            flat, sizes = shingle_sets(strings(part.column(2)), rule.n)
            ends = np.cumsum(sizes)
            sets = [flat[e - s : e] for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]
            nodes = [node_of(x) if len(x) else None for x in sets]
            fresh = []
            for x in nodes:
                fresh.append(x is not None and x not in seen)
                seen.add(x)
            if len(seen) > 500_000:
                seen.clear()  # a node that comes again is sent again
            all_bands = [rule.bands(len(x)) if f else [] for x, f in zip(sets, fresh, strict=True)]
            keys, whose = [], []
            for k in range(max(map(len, all_bands), default=0)):
                bands = np.array([b[k] if k < len(b) else -1 for b in all_bands], np.int64)
                x, w = part_keys(flat, sizes, rule, bands, plans)
                keys.append(x)
                whose.append(w)
            key, own = np.concatenate([np.empty(0, np.int64), *keys]), np.concatenate([np.empty(0, np.int64), *whose])
            order = np.argsort(own, kind="stable")
            offsets = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(sizes)))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(key[order]))
            bits = binaries([bit_sketch(x) if f else None for x, f in zip(sets, fresh, strict=True)])
            yield pa.record_batch([part.column(0), part.column(1), longs(sizes), pa.array(nodes, pa.int64()), bits, lists], ["doc_id", "text_hash", "n_shingles", "node", "bits", "keys"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, node long, bits binary, keys array<long>")


def shared_parts(sketched: DataFrame) -> DataFrame:
    """(key, node, n): the n members of each part that more than one node has; of parts with the same members, one.

    Counts by key come first, combined in each task before they travel, so a part that a third of all nodes have is no
    task's alone.  Parts of two need no more; members of the others are looked up, in a join that Spark may split.
    """
    rows = sketched.where("size(keys) > 0").select(F.explode("keys").alias("key"), "node")
    parts = stored(rows.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count(F.lit(1)).alias("n")).where("a <> b"), "parts")
    pairs = parts.where("n = 2").groupBy("a", "b").agg(F.min("key").alias("key"))
    members = stored(rows.join(small(parts.where("n > 2").select("key")), "key").distinct(), "members")
    marks = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"mark{k}") for k in range(2)]
    kinds = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *marks)
    first = stored(kinds.groupBy("n", "mark0", "mark1").agg(F.min("key").alias("key")).select("key", "n"), "kinds")
    two = pairs.select("key", F.explode(F.array("a", "b")).alias("node"), F.lit(2).cast("long").alias("n"))
    return two.union(members.join(small(first), "key").select("key", "node", "n"))


def grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], compare: Callable[[tuple[int, ...], pa.Table], list[tuple[int, int]]]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) that compare finds in each group of sorted rows."""
    held: list[pa.RecordBatch] = []
    current: tuple[int, ...] | None = None
    found: list[tuple[int, int]] = []

    def flush() -> pa.RecordBatch:
        out = pa.record_batch([longs([x for x, _ in found]), longs([y for _, y in found])], ["a", "b"])
        found.clear()
        return out

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(c)) for c in keys]
        new = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in columns], axis=0)]))
        for s, e in zip(new.tolist(), [*new[1:].tolist(), batch.num_rows], strict=True):
            k = tuple(int(x[s]) for x in columns)
            if k != current:
                if held:
                    found += compare(current, pa.Table.from_batches(held))
                held.clear()
                current = k
                if len(found) > 10_000:
                    yield flush()
            held.append(batch.slice(s, e - s))
    if held:
        found += compare(current, pa.Table.from_batches(held))
    if found:
        yield flush()


def in_blocks(rows: DataFrame, key: str) -> DataFrame:
    """rows, which have a column blocks, for each pair of blocks i <= j of their key that takes them, those together and in order."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    rows = rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "blocks")
    return rows.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")


def near(members: DataFrame, sketched: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): for each block of a part's members, a forest of the pairs that sizes and bit sketches do not rule out."""
    nodes = stored(members.select("node").distinct(), "nodes")
    own = sketched.where("bits is not null").join(small(nodes), "node", "left_semi").select("node", F.col("n_shingles").alias("size"), "bits").dropDuplicates(["node"])
    rows = in_blocks(members.join(own, "node").withColumn("blocks", F.ceil(F.col("n") / BLOCK)).drop("n"), "key")

    def compare(k: tuple[int, ...], group: pa.Table) -> list[tuple[int, int]]:
        node, size, block = (np.asarray(group.column(c)) for c in ("node", "size", "block"))
        bits = BitRows(group.column("bits").combine_chunks())
        left, right = (np.flatnonzero(block == x) for x in k[1:])
        tree, found = np.arange(len(node)), []
        for i in left.tolist():
            r = right[tree[right] != tree[i]]
            if k[1] == k[2]:
                r = r[r > i]
            r = r[100 * np.minimum(size[r], size[i]) >= rule.percent * np.maximum(size[r], size[i])]
            if not len(r):
                continue
            r = r[bits.apart(i, r) * (100 + rule.percent) <= (size[r] + size[i]) * (100 - rule.percent)]
            for j in r.tolist():
                if tree[i] != tree[j]:
                    tree[tree == tree[j]] = tree[i]
                    found.append((int(node[i]), int(node[j])))
        return found

    pairs = rows.mapInArrow(lambda batches: grouped(batches, ("key", "i", "j"), compare), "a long, b long")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def node_sets(docs: DataFrame, wanted: DataFrame, rule: Rule) -> DataFrame:
    """(node, label, blocks, elements) of the wanted (node, label, blocks, doc_id, text_hash): each set's sorted hashes."""
    d = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash")).alias("d")
    w = small(wanted).alias("w")
    rows = d.join(w, F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.text_hash") == F.col("w.text_hash")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # repeated rows come once from a task
        for part in slices(batches, 250):
            flat, sizes = shingle_sets(strings(part.column(3)), rule.n)
            ends, keep, raw = np.cumsum(sizes), [], []
            for k, (e, s, node) in enumerate(zip(ends.tolist(), sizes.tolist(), part.column(0).to_pylist(), strict=True)):
                own = flat[e - s : e]
                if s and node not in seen and node_of(own) == node:  # texts whose hashes are equal may differ
                    seen.add(node)
                    keep.append(k)
                    raw.append(own.tobytes())
            kept = part.take(pa.array(keep, pa.int64()))
            yield pa.record_batch([*kept.columns[:3], binaries(raw)], ["node", "label", "blocks", "elements"])

    return rows.select("w.node", "w.label", "w.blocks", "d.text").mapInArrow(run, "node long, label long, blocks long, elements binary")


def links(sets: list[np.ndarray], lefts: int, rule: Rule) -> np.ndarray:
    """Whether each of the first lefts sets links with each of the others, or with each of all where lefts is their number.

    Shared elements are counted by a product of the matrices that tell which set has which element; elements of one set
    alone, or of all, need no column there.
    """
    n, size = len(sets), np.array(list(map(len, sets)), np.int64)
    right = slice(0, n) if lefts == n else slice(lefts, n)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n, dtype=np.int32), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    del order
    starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    count = np.diff(np.append(starts, len(flat)))
    del flat, starts
    some = (count > 1) & (count < n)
    column = np.repeat(np.arange(some.sum(), dtype=np.int32), count[some])
    owner = owner[np.repeat(some, count)]
    shared = np.full((lefts, right.stop - right.start), int((count == n).sum()), np.int64)
    width, columns = max(64, CELLS // n), int(some.sum())
    for at in range(0, columns, width):
        a, b = np.searchsorted(column, (at, at + width))
        has = np.zeros((n, min(width, columns - at)), np.float32)
        has[owner[a:b], column[a:b] - at] = 1
        shared += (has[:lefts] @ has[right].T).astype(np.int64)
    both = size[:lefts, None] + size[right]
    return 100 * shared >= rule.percent * (both - shared)


def verified(rows: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): a forest of the links of each group (label, i, j) of dealt sets; links of block i with block j, or within i."""

    def compare(k: tuple[int, ...], group: pa.Table) -> list[tuple[int, int]]:
        node, block = np.asarray(group.column("node")), np.asarray(group.column("block"))
        node, once = np.unique(node, return_index=True)  # a node may come from several tasks
        block = block[once]
        order = np.argsort(block, kind="stable")
        node, raw = node[order], group.column("elements").take(pa.array(once[order]))
        lefts = int((block == k[1]).sum())
        if lefts == len(node) and k[1] != k[2] or not lefts:
            return []
        found = links([np.frombuffer(x.as_buffer(), np.uint64) for x in raw], lefts, rule)
        left, right = forest(found)
        pairs = zip(node[left].tolist(), node[right + (0 if lefts == len(node) else lefts)].tolist(), strict=True)
        return [(a, b) if a < b else (b, a) for a, b in pairs if a != b]

    return rows.mapInArrow(lambda batches: grouped(batches, ("label", "i", "j"), compare), "a long, b long").distinct()


def dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j")


def blocks_of(rows: DataFrame, *key: str) -> DataFrame:
    """Stored (key, blocks): how many blocks the members (node, size) of each key make."""
    count = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") / ELEMENTS))
    return stored(rows.groupBy(*key).agg(count.alias("blocks")), "cluster-sizes")


def apart(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Stored members (node, label, ...) of the clusters that edges leave in several components, with part: their component."""
    part = components(edges).withColumnRenamed("label", "part")
    rows = stored(members.join(part, "node", "left").withColumn("part", F.coalesce("part", "node")), "parts-of-clusters")
    several = stored(rows.groupBy("label").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a <> b").select("label"), "open")
    return stored(rows.join(small(several), "label"), "apart")


def cluster_links(docs: DataFrame, clusters: DataFrame, rule: Rule) -> DataFrame:
    """Stored (a, b) that join what links in the stored clusters (node, label, doc_id, text_hash, size)."""
    names = ["node", "label", "blocks", "doc_id", "text_hash"]
    members = stored(clusters.join(small(blocks_of(clusters, "label")), "label"), "wanted")
    own = node_sets(docs, members.select(names), rule).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    edges = stored(verified(dealt(own.drop("blocks").withColumns({"i": F.col("block"), "j": F.col("block")})), rule), "links")
    several = members.where("blocks > 1").drop("blocks")
    if several.isEmpty():
        return edges
    left = apart(several, edges)
    if not left.isEmpty():  # one set of each component
        first = left.groupBy("label", "part").agg(F.min(F.struct("node", "doc_id", "text_hash", "size")).alias("m")).select("label", "m.*")
        first = stored(first, "first")
        first = stored(first.join(small(blocks_of(first, "label")), "label").select(names), "wanted")
        edges = stored(edges.union(verified(in_blocks(node_sets(docs, first, rule), "label"), rule)), "links")
        left = apart(left.drop("part"), edges)
    if not left.isEmpty():  # members of different components
        large = blocks_of(left, "label", "part").where("blocks > 1").withColumnRenamed("blocks", "own")
        rows = left.join(small(large), ["label", "part"], "left")
        rest = blocks_of(rows.where("own is null").drop("own"), "label").withColumnRenamed("blocks", "shared")
        rows = rows.join(small(rest), "label", "left")
        # a large component has blocks of its own; the others share some, by component
        place = F.when(F.col("own").isNotNull(), F.xxhash64("part", F.pmod(F.xxhash64("node"), "own"))).otherwise(F.pmod(F.xxhash64("part"), "shared"))
        rows = stored(rows.withColumn("blocks", place), "placed")
        each = rows.select("label", "blocks", F.when(F.col("own").isNotNull(), F.col("part")).alias("whole")).distinct()
        x, y = stored(each, "blocks").alias("x"), each.alias("y")  # a row for each block of a cluster
        both = x.join(y, (F.col("x.label") == F.col("y.label")) & (F.col("x.blocks") <= F.col("y.blocks")) & F.coalesce(F.col("x.whole") != F.col("y.whole"), F.lit(True)))
        both = both.where("NOT (x.blocks = y.blocks AND x.whole IS NOT NULL)").select("x.label", F.col("x.blocks").alias("i"), F.col("y.blocks").alias("j"))
        turns = stored(both.select("label", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block")), "turns")
        sets = node_sets(docs, stored(rows.select(names), "wanted"), rule).withColumnRenamed("blocks", "block")
        edges = stored(edges.union(verified(dealt(sets.join(small(turns), ["label", "block"])), rule)), "links")
    return edges


def bit_sketch(own: np.ndarray) -> bytes:
    """Each element toggles one bit of a power of two."""
    bits = max(BITS, 1 << (len(own) - 1).bit_length())
    odd = np.bincount((own % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(words: np.ndarray, width: int) -> np.ndarray:
    """The sketch of the same set with fewer bits: its halves' exclusive or."""
    while len(words) > width:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


class BitRows:
    """Sketches of the members of a block; two are compared at the width of the narrower."""

    def __init__(self, column: pa.Array):
        self.rows = [np.frombuffer(x, np.uint64) for x in column.to_pylist()]
        self.width = np.array([len(x) for x in self.rows], np.int64)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def table(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Each member's place among those at least so wide, and these folded to the width."""
        if width not in self.tables:
            wide = self.width >= width
            self.tables[width] = np.cumsum(wide) - 1, np.stack([folded(self.rows[i], width) for i in np.flatnonzero(wide)])
        return self.tables[width]

    def apart(self, i: int, others: np.ndarray) -> np.ndarray:
        """The Hamming distance of member i to others."""
        low = np.minimum(self.width[others], self.width[i])
        out = np.empty(len(others), np.int64)
        for width in np.unique(low).tolist():
            place, rows = self.table(width)
            here = low == width
            out[here] = np.bitwise_count(rows[place[others[here]]] ^ rows[place[i]]).sum(1)
        return out


def sketch_distance(x: bytes, y: bytes) -> int:
    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    width = min(len(p), len(q))
    return int(np.bitwise_count(folded(p, width) ^ folded(q, width)).sum())


def joined(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    sketched = stored(sketches(docs, rule), "sketches")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("least")
    classes = sketched.where("node is not null").groupBy("node").agg(least, F.first("n_shingles").alias("size"))
    classes = stored(classes.select("node", "least.doc_id", "least.text_hash", "size"), "classes")
    pairs = stored(near(shared_parts(sketched), sketched, rule), "near")
    clusters = stored(components(pairs).join(classes, "node"), "clusters")
    labels = components(cluster_links(docs, clusters, rule))
    linked = stored(labels.join(classes.select("node", "doc_id"), "node"), "linked")
    named = stored(linked.groupBy("label").agg(F.min("doc_id").alias("component_id")), "names")
    named = stored(linked.join(small(named), "label").select("node", "component_id"), "named")
    named = stored(classes.select("node", "doc_id").join(small(named), "node", "left").select("node", F.coalesce("component_id", "doc_id").alias("component_id")), "components")
    alone = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return sketched.select("doc_id", "n_shingles", "node").join(named, "node", "left").select("doc_id", "n_shingles", alone.alias("component_id"))


def one_of_each(docs: DataFrame, rule: Rule) -> DataFrame:
    """docs without all but one document of each group of linked ones: that with the smallest doc_id stays.

    Where doc_ids repeat or are null, rows are told apart by a number that is stored with them; of rows with the same
    doc_id any one stays, and one without a doc_id only where all are.
    """
    names = docs.columns
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        found = joined(docs.select("doc_id", "text"), rule)
        dropped = stored(found.where("component_id <> doc_id").select("doc_id"), "dropped")
        return docs.join(small(dropped), "doc_id", "left_anti").select(*names)
    key = private(docs, "row")
    docs = stored(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
    found = joined(docs.select(F.col(key).alias("doc_id"), "text"), rule).select(F.col("doc_id").alias(key), "component_id")
    ids = found.join(docs.select(key, F.col("doc_id").cast("long").alias("id")), key)
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", F.col(key).alias("row"))).alias("least")
    kept = stored(ids.groupBy("component_id").agg(least).select(F.col("least.row").alias(key)), "kept")
    return docs.join(small(kept), key, "left_semi").select(*names)
