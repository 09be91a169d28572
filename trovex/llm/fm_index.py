"""A compressed index of one shard's words: the Burrows-Wheeler transform in a wavelet matrix, searched backward.

The transform is that of the suffixes sorted by their first `depth` words, which serves every search of up to depth
words.  Bits are packed, with a count for each 64 of them; borders of the groups of equal prefixes stand in for the
longest common prefixes, so that a search may drop its last word.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A packed row of bits with rank."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-len(bits) // 64) * 64 + 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32)]).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each i."""
        at = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at] + np.bitwise_count(self.words[at] & low)


class WaveletMatrix:
    """A sequence of codes, a row of bits for each bit of a code, the highest first."""

    def __init__(self, codes: np.ndarray, size: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for level in reversed(range(max(1, int(size - 1).bit_length()))):
            bits = (codes >> level & 1).astype(bool)
            self.levels.append((level, Bits(bits), int(len(bits) - bits.sum())))
            codes = np.concatenate([codes[~bits], codes[bits]])
        self.start = self.moved(np.arange(size), np.zeros(size, np.int64))

    def moved(self, code: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, bits, zeros in self.levels:
            ones = bits.rank(i)
            i = np.where(code >> level & 1, zeros + ones, i - ones)
        return i

    def rank(self, code: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each code stands before each i."""
        return self.moved(code, i) - self.start[code]


def paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Ranks of the pairs (left, right)."""
    return np.unique(left * (int(right.max(initial=0)) + 1) + right, return_inverse=True)[1]


def ahead(rank: np.ndarray, n: int) -> np.ndarray:
    """rank of the suffix n words on; 0 beyond the end."""
    return np.concatenate([rank[n:], np.zeros(min(n, len(rank)), rank.dtype)])


class FmIndex:
    """codes: words from 1 on, with 0 after each piece of text."""

    def __init__(self, codes: np.ndarray, size: int, depth: int):
        self.n, self.depth = len(codes), depth
        ranks = {1: codes.astype(np.int64)}
        have = 1
        while 2 * have < depth:
            ranks[2 * have] = paired(ranks[have], ahead(ranks[have], have))
            have *= 2
        shorter, full = (paired(ranks[have], ahead(ranks[have], n - have)) if n > have else ranks[have] for n in (depth - 1, depth))
        order = np.argsort(full, kind="stable")
        self.wavelet = WaveletMatrix(codes[order - 1], size)
        counts = np.bincount(codes, minlength=size)
        self.less = np.cumsum(counts) - counts
        self.group = full[order]  # ranks are gapless, so a group's number is its rank
        self.first = np.full(int(full.max(initial=0)) + 1, self.n)
        np.minimum.at(self.first, full, np.arange(self.n))
        short = shorter[order]
        self.begin = np.searchsorted(short, short, "left")
        self.end = np.searchsorted(short, short, "right")

    def step(self, code: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of code followed by what the intervals stand for."""
        both = np.concatenate([code, code])
        at = self.less[both] + self.wavelet.rank(both, np.concatenate([low, high]))
        return at[: len(code)], at[len(code) :]

    def repeated(self, codes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether the depth words from each place also begin at an earlier place; for places in pieces codes[begins:ends].

        All pieces are searched side by side, from their last words on: an interval grows by the word before, and once
        it stands for depth words it first drops its last one.  Matches so never exceed depth, the threshold.
        """
        found = np.zeros(len(codes), bool)
        order = np.argsort(begins - ends, kind="stable")
        begins, ends = begins[order], ends[order]
        sizes = ends - begins
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.n)
        for t in range(int(sizes.max(initial=0))):
            live = int(np.searchsorted(-sizes, -t, "left"))
            low, high = low[:live], high[:live]
            if t >= self.depth:
                low, high = self.begin[low], self.end[low]
            at = ends[:live] - 1 - t
            low, high = self.step(codes[at], low, high)
            if t >= self.depth - 1:
                found[at] = self.first[self.group[low]] < at
        return found
