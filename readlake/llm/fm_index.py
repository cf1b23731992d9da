"""A compressed full-text index of whole words: a wavelet tree over the Burrows-Wheeler transform, in numpy.

Symbols are small integers; 0 separates texts and never matches. Every query runs for many lanes at once.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with constant-time rank: 64-bit blocks, and the ones before each block."""

    def __init__(self, bits: np.ndarray):
        blocks = -(-(len(bits) + 1) // 64)
        padded = np.zeros(blocks * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(blocks, dtype=np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        block, bit = at >> 6, (at & 63).astype(np.uint64)
        held = self.words[block] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[block] + np.bitwise_count(held)


class WaveletTree:
    """Levels of bits from the highest to the lowest, each level sorted by the bits above it (pointerless form)."""

    def __init__(self, symbols: np.ndarray, depth: int):
        self.depth, self.levels, self.zeros = depth, [], []
        for level in range(depth - 1, -1, -1):
            bit = (symbols >> level) & 1
            self.levels.append(Bits(bit))
            ones = bit.astype(bool)
            self.zeros.append(int(len(bit) - ones.sum()))
            symbols = np.concatenate((symbols[~ones], symbols[ones]))
        #: Where the run of each symbol begins on the last level.
        self.begin = np.zeros((1 << depth) + 1, dtype=np.int64)
        present, first = np.unique(symbols, return_index=True)
        self.begin[present] = first

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        for level, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones = bits.rank(at)
            at = np.where((symbol >> (self.depth - 1 - level)) & 1, zeros + ones, at - ones)
        return at - self.begin[symbol]


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by the `depth` symbols that begin there, by doubling; ties in any fixed order.
    Counts of patterns of up to `depth` symbols need no more."""
    n = len(symbols)
    rank, width = symbols.astype(np.int64), 1
    while True:
        shifted = np.zeros(n, dtype=np.int64)
        if width < n:
            shifted[: n - width] = rank[width:] + 1
        key = rank * (int(rank.max(initial=0)) + 2) + shifted
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        width *= 2
        if width >= depth or new[-1] == n - 1:
            return order


class FMIndex:
    """Texts over symbols 1..., each ended by 0, each text with a weight (how many copies it stands for)."""

    def __init__(self, symbols: np.ndarray, weights: np.ndarray, depth: int):
        n = len(symbols)
        order = suffix_order(symbols, depth + 1)
        transform = symbols[order - 1]
        size = int(symbols.max(initial=0)) + 1
        self.tree = WaveletTree(transform, max(1, int(size - 1).bit_length()))
        self.less = np.zeros(size + 1, dtype=np.int64)
        np.cumsum(np.bincount(symbols, minlength=size), out=self.less[1:])
        self.weight = np.zeros(n + 1, dtype=np.int64)
        np.cumsum(weights[order], out=self.weight[1:])
        self.n = n

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: from the rows of P to the rows of symbol + P."""
        both = self.tree.rank(np.concatenate((symbol, symbol)), np.concatenate((low, high)))
        begin, k = self.less[symbol], len(symbol)
        return begin + both[:k], begin + both[k:]


def matching_statistics(index: FMIndex, stream: np.ndarray, ends: np.ndarray, longest: int, lanes: int = 1 << 17) -> np.ndarray:
    """For each end, the length of the longest run stream[end - length:end], up to `longest`, that stands at least twice in
    the indexed texts (a text of the stream that is indexed too counts as once). Runs stop at separators."""
    found = np.zeros(len(ends), dtype=np.int16)
    for at in range(0, len(ends), lanes):
        live = np.arange(at, min(at + lanes, len(ends)))
        place = ends[live] - 1
        low, high = np.zeros(len(live), dtype=np.int64), np.full(len(live), index.n, dtype=np.int64)
        for length in range(1, longest + 1):
            symbol = np.where(place >= 0, stream[np.maximum(place, 0)], 0)
            go = symbol > 0
            live, place, low, high, symbol = live[go], place[go], low[go], high[go], symbol[go]
            low, high = index.step(symbol, low, high)
            go = index.weight[high] - index.weight[low] >= 2
            live, place, low, high = live[go], place[go] - 1, low[go], high[go]
            found[live] = length
            if not len(live):
                break
    return found
