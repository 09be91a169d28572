"""Runs of word windows with one anchor, found in whole texts: equal windows always have equal anchors.

A window's anchor is the run of a few words in it with the least hash, the leftmost of equal ones.  Consecutive windows
with the anchor at one place are a segment, so a text has about a segment for half a window's words.  No window occurs
twice in a segment, as the second one would have its anchor further left.
"""

from __future__ import annotations

import numpy as np
import xxhash

from trovex.llm.common import WORD

#: Bits of an anchor's place in a batch; the others order it by hash.  A text has at most 2^30 words.
PLACE_BITS = 30
BASE, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 1 << 64)
#: Distinct words that a worker keeps, about 150 bytes each.
KEPT = 400_000


class Hashes(dict):
    """Word -> 64-bit hash, for the words that this worker has met."""

    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > KEPT:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(MIX)
    return x ^ (x >> np.uint64(29))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0, base^1, ... modulo 2^64, n at least."""
    if len(_powers.get(base, ())) < n:
        steps = np.full(max(n, 1 << 20), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps)
    return _powers[base]


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words."""
    out, have = h, 1
    parts = [(1, h)]
    while 2 * have <= n:
        out = out[:-have] * powers(BASE, have + 1)[have] + out[have:]
        have *= 2
        parts.append((have, out))
    at, total = 0, None
    for size, part in reversed(parts):
        if at + size <= n:
            rest = len(h) - n + 1
            piece = part[at : at + rest]
            total = piece if total is None else total * powers(BASE, size + 1)[size] + piece
            at += size
    return mixed(total)


def least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive values."""
    have = 1
    while 2 * have <= n:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (n - have)], x[n - have :]) if have < n else x


def segments(h: np.ndarray, ends: np.ndarray, window: int, anchor: int, heavy: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(text, start, windows, anchor, content) of every segment of the texts whose words h holds one after another.

    ends: where each text ends in h.  start counts from the text's first word; content is a hash of the segment's words.
    Windows with an anchor of heavy (sorted) are a segment each, and the hash of all their words is their anchor.
    """
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    valid = np.empty(0, np.int64)
    if len(h) >= window:
        text = np.repeat(np.arange(len(ends)), ends - begins)[: len(h) - window + 1]
        valid = (np.arange(len(text)) + window <= ends[text]).nonzero()[0]
    if not len(valid):
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    text = text[valid]
    grams, low = runs(h, anchor), np.uint64((1 << PLACE_BITS) - 1)
    place = (least((grams & ~low) | np.arange(len(grams), dtype=np.uint64), window - anchor + 1) & low)[valid]
    first = np.concatenate([[True], place[1:] != place[:-1]])
    key = grams[place.astype(np.int64)]
    if heavy is not None and len(heavy):
        hot = heavy[np.minimum(np.searchsorted(heavy, key), len(heavy) - 1)] == key
        key = np.where(hot, runs(h, window)[valid], key)
        first |= hot
    heads = first.nonzero()[0]
    counts = np.diff(np.concatenate([heads, [len(key)]]))
    starts = valid[heads]
    stops = starts + counts + (window - 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers(INVERSE, len(h))[: len(h)])])
    content = mixed((sums[stops] - sums[starts]) * powers(BASE, len(h) + 1)[starts] + counts.astype(np.uint64))
    owner = text[heads]
    return owner, starts - begins[owner], counts, key[heads], content
