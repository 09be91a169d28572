"""Best-fit packing of token pieces into sequences, improved by swaps between underfull bins.

Only documents longer than a sequence are cut: the first piece takes what is over, the others fill a sequence each.
Pieces are dealt to blocks by a hash, and each block is packed by itself: best fit in falling order of length, then a
local search that moves one piece or two, or exchanges one for one, one for two or two for one, from the emptiest bin
into fuller ones.  Each step raises the sum of squared fills, and a bin that runs empty is saved.  The search ends when
no two bins of the block have such a step, or when no packing needs fewer bins.  A block of BLOCK pieces fits a task at
any input size; blocks do not exchange pieces.

Null texts count as empty: a piece with the end id alone.  Repeated rows are packed as often as they stand, and are
dealt to as many blocks as there are rows of them, REPEATS at most.  Pieces of one length are taken in the order of
their columns.  Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovex.llm.common import REPEATS, longs, mapped, stored, strings
from trovex.llm.encoding import crc_of, encoder

#: Pieces of one block.
BLOCK = 32_768


def cut(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document of n tokens."""
    first = n % capacity
    return ([first] if first else []) + [capacity] * (n // capacity)


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's pieces."""

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, piece, start, length, crc = [], [], [], [], []
        for d, x in zip(batch.column(0).to_pylist(), encoder(vocabulary).encode(strings(batch.column(1))), strict=True):
            ids, at = np.append(x, np.uint32(end_id)), 0
            for i, n in enumerate(cut(len(ids), capacity)):
                doc.append(d)
                piece.append(i)
                start.append(at)
                length.append(n)
                crc.append(crc_of(ids[at : at + n]))
                at += n
        return pa.record_batch([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), longs(start), longs(length), longs(crc)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), encode, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: each item, longest first, goes into the fullest bin that has room."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the room they have left
    rooms: list[int] = []  # sizes of room that some bin has, sorted
    for i in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        n = lengths[i]
        at = bisect_left(rooms, n)
        if at < len(rooms):
            left = rooms[at]
            b = room[left].pop()
            if not room[left]:
                rooms.pop(at)
            bins[b].append(i)
        else:
            left, b = capacity, len(bins)
            bins.append([i])
        left -= n
        if left:
            if not room[left]:
                insort(rooms, left)
            room[left].append(b)
    return bins


def bits(mask: int) -> Iterator[int]:
    """The set bits, lowest first."""
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


def spread(mask: int, n: int) -> int:
    """The numbers that are 1 to n above a number of mask."""
    done = 1
    while done < n:
        step = min(done, n - done)
        mask |= mask << step
        done += step
    return mask << 1


def sums_of(items: list[int], lengths: list[int]) -> tuple[int, int]:
    """Lengths of one item, and of two, as bits."""
    ones = twos = 0
    for n, c in Counter(lengths[i] for i in items).items():
        twos |= ones << n
        if c > 1:
            twos |= 1 << 2 * n
        ones |= 1 << n
    return ones, twos


class Index:
    """Underfull bins by their room and by the lengths of one item and of two items in them.

    A bin with room r that gives back t takes v for it if t < v <= t + r.  A tree over the rooms has what their bins
    take: v of one item for nothing, one item or two, and v of two items for nothing or one.
    """

    def __init__(self, capacity: int) -> None:
        self.top = 1 << capacity.bit_length()
        self.takes = ([0] * 2 * self.top, [0] * 2 * self.top)
        self.sums = ([0] * self.top, [0] * self.top)
        self.rooms: list[int] = []  # sorted
        self.bins: tuple[dict[tuple[int, int], dict[int, None]], ...] = ({}, {})  # by (room, length of one or two); 0 of one: every bin

    def change(self, b: int, room: int, ones: int, twos: int, add: bool) -> None:
        fresh = False
        for kind, mask in enumerate((ones | 1, twos)):
            table = self.bins[kind]
            for t in bits(mask):
                if add:
                    own = table.setdefault((room, t), {})
                    own[b] = None
                    gone = len(own) > 1
                else:
                    own = table[room, t]
                    del own[b]
                    gone = bool(own)
                    if not own:
                        del table[room, t]
                if not gone:
                    fresh = True
                    self.sums[kind][room] ^= 1 << t
                    if t == 0:
                        insort(self.rooms, room) if add else self.rooms.pop(bisect_left(self.rooms, room))
        if not fresh:
            return
        one, two = self.sums[0][room], self.sums[1][room]
        for tree, mask in zip(self.takes, (one | two, one), strict=True):
            at = self.top + room
            tree[at] = spread(mask, room)
            while at > 1:
                at >>= 1
                tree[at] = tree[2 * at] | tree[2 * at + 1]

    def least_room(self, ones: int, twos: int) -> int:
        """The least room of a bin that takes one of ones or twos; top if there is none."""
        one, two = self.takes
        if not (one[1] & ones or two[1] & twos):
            return self.top
        at = 1
        while at < self.top:
            at *= 2
            if not (one[at] & ones or two[at] & twos):
                at += 1
        return at - self.top

    def step(self, giver: int, room: int, ones: int, twos: int) -> tuple[int, int, int, bool, bool] | None:
        """(receiver, given, taken, two given, two taken) of the largest move to a bin of that room other than giver."""
        best, found = 0, None
        for given, mask in enumerate((ones, twos)):
            for v in bits(mask):
                least = max(v - room, 0)
                for taken in (0, 1) if not given else (0,):
                    for t in bits(self.sums[taken][room] >> least & (1 << v - least) - 1):
                        if v - least - t <= best:
                            break
                        b = next((b for b in self.bins[taken][room, least + t] if b != giver), None)
                        if b is not None:
                            best, found = v - least - t, (b, v, least + t, bool(given), bool(taken))
                            break
        return found

    def givers(self, room: int, ones: int, twos: int) -> Iterator[int]:
        """The bins, no fuller than room, that have a step into a bin of that room and these lengths."""
        takes = spread(ones | twos | 1, room), spread(ones | 1, room)
        for r in self.rooms[bisect_left(self.rooms, room) :]:
            for kind, mask in enumerate(takes):
                for v in bits(self.sums[kind][r] & mask & ~1):
                    yield from self.bins[kind][r, v]


def improved(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Empties bins by moves and exchanges that each raise the sum of squared fills, until no bin has one left.

    The emptiest bin that may have a step gives to the fullest bin that takes something of it.  A bin without a step is
    asked again when a bin has changed into one that takes something of it.  The search also ends where no packing
    needs fewer bins.
    """
    fill = [sum(lengths[i] for i in items) for items in bins]
    sums = [sums_of(items, lengths) for items in bins]
    used, least = len(bins), -(-sum(lengths) // capacity)
    index = Index(capacity)
    for b, n in enumerate(fill):
        if 0 < n < capacity:
            index.change(b, capacity - n, *sums[b], add=True)
    waiting = {b for b, n in enumerate(fill) if 0 < n < capacity}
    queue = sorted((fill[b], b) for b in waiting)
    while queue and used > least:
        n, giver = heappop(queue)
        if giver not in waiting or fill[giver] != n:
            continue
        ones, twos = sums[giver]
        room = index.least_room(ones, twos)
        step = index.step(giver, room, ones, twos) if room <= capacity - n else None
        if step is None:
            waiting.discard(giver)
            continue
        taker, given, taken, two, back = step
        gives, takes = items_of(bins[giver], lengths, given, two), items_of(bins[taker], lengths, taken, back)
        for b, out, into in ((giver, gives, takes), (taker, takes, gives)):
            index.change(b, capacity - fill[b], *sums[b], add=False)
            for i in out:
                bins[b].remove(i)
            bins[b] += into
            fill[b] += (given - taken) * (1 if b == taker else -1)
            sums[b] = sums_of(bins[b], lengths)
            waiting.discard(b)
        used -= not bins[giver]
        changed = [b for b in (giver, taker) if 0 < fill[b] < capacity]
        for b in changed:
            index.change(b, capacity - fill[b], *sums[b], add=True)
        asked = {b for c in changed for b in index.givers(capacity - fill[c], *sums[c])}
        for b in sorted(asked.union(changed) - waiting):
            waiting.add(b)
            heappush(queue, (fill[b], b))
    return [x for x in bins if x]


def items_of(items: list[int], lengths: list[int], n: int, two: bool) -> list[int]:
    """One item of length n, or two with that sum; none for 0."""
    if not n:
        return []
    if not two:
        return [next(i for i in items if lengths[i] == n)]
    seen: dict[int, int] = {}
    for i in items:
        if n - lengths[i] in seen:
            return [seen[n - lengths[i]], i]
        seen.setdefault(lengths[i], i)
    raise ValueError(f"no two items of {n} together")


def pack(pieces: DataFrame, capacity: int, block: int = BLOCK) -> DataFrame:
    """Adds sequence_id and offset to stored rows with a column length, of 1 to capacity."""
    count = max(1, -(-pieces.count() // block))
    names = pieces.columns
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in pieces.schema)}, sequence_id long, offset long"

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        no = int(rows["_block"].iat[0])
        rows = rows.sort_values(names, kind="stable", ignore_index=True)
        lengths = rows["length"].tolist()
        bins = improved(best_fit(lengths, capacity), lengths, capacity)
        sequence, offset = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
        for b, items in enumerate(bins):
            at = 0
            for i in items:
                sequence[i], offset[i] = no * (block << 8) + b, at
                at += lengths[i]
        return rows[names].assign(sequence_id=sequence, offset=offset)

    repeat = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(REPEATS))  # equal pieces are alike, so it doesn't matter which goes where
    dealt = pieces.withColumn("_block", F.pmod(F.pmod(F.xxhash64(*names, F.lit("block")), F.lit(count)) + repeat, F.lit(count)).cast("long"))
    return dealt.groupBy("_block").applyInPandas(one, schema)


def packed(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """Every piece of docs with its sequence_id and its place there."""
    return pack(stored(pieces(docs, vocabulary, end_id, capacity), "pieces"), capacity)
