"""An FM-index over integer symbols: wavelet matrix of the Burrows-Wheeler transform, sampled suffix positions.

All queries are vectorised: many patterns are searched, and many rows located, at once.
"""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - k)] = rank[k:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.cumsum(np.r_[0, sorted_key[1:] != sorted_key[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        k *= 2


class Bits:
    """A bit vector with rank in constant time: packed words and a running count."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view("<u8")
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words).astype(np.int64))]

    def ones(self, at: np.ndarray) -> np.ndarray:
        """How many ones stand before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class FMIndex:
    """Over symbols of 1 and more; 0 is the end mark that it appends."""

    def __init__(self, symbols: np.ndarray, sample: int = 16) -> None:
        text = np.r_[symbols, 0].astype(np.int64)
        self.n = len(text)
        order = suffix_order(text)
        bwt = text[order - 1]
        self.levels: list[tuple[Bits, int]] = []
        self.width = max(1, int(text.max()).bit_length())
        counts = np.bincount(text, minlength=(1 << self.width) + 1)
        self.first = np.r_[0, np.cumsum(counts)]
        for level in range(self.width - 1, -1, -1):
            bit = (bwt >> level & 1).astype(bool)
            self.levels.append((Bits(bit), int((~bit).sum())))
            bwt = np.concatenate([bwt[~bit], bwt[bit]])
        kept = order % sample == 0
        self.sampled, self.samples = Bits(kept), order[kept]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before each position."""
        low, high = np.zeros_like(at), at
        for k, (bits, zeros) in enumerate(self.levels):
            one = (symbol >> (self.width - 1 - k) & 1).astype(bool)
            a, b = bits.ones(low), bits.ones(high)
            low = np.where(one, zeros + a, low - a)
            high = np.where(one, zeros + b, high - b)
        return high - low

    def symbol(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for bits, zeros in self.levels:
            one = bits.get(at)
            ones = bits.ones(at)
            out = out << 1 | one
            at = np.where(one, zeros + ones, at - ones)
        return out

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of patterns of one length (rows); their ranges of suffix ranks."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        alive = np.arange(len(patterns))
        inside = patterns.max(1, initial=0) < 1 << self.width
        low[~inside] = high[~inside] = 0
        alive = alive[inside]
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[alive, k]
            low[alive] = self.first[c] + self.rank(c, low[alive])
            high[alive] = self.first[c] + self.rank(c, high[alive])
            alive = alive[high[alive] > low[alive]]
            if not len(alive):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix ranks: step back through the text until a sampled one."""
        out = np.full(len(rows), -1, np.int64)
        todo, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            known = self.sampled.get(at)
            out[todo[known]] = self.samples[self.sampled.ones(at[known])] + steps
            todo, at = todo[~known], at[~known]
            c = self.symbol(at)
            at = self.first[c] + self.rank(c, at)
            steps += 1
        return out
