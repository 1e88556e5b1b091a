"""A compressed FM-index over short sequences of words, in numpy: many searches advance one backward step at a time together.

The Burrows-Wheeler transform is kept as a wavelet matrix of packed bits with a count per 64 bits. Suffixes are sorted by
their first ``DEPTH`` symbols only, which is all that patterns of up to ``DEPTH`` symbols need.
"""

from __future__ import annotations

import numpy as np

DEPTH = 64
ROUNDS = 6  # of prefix doubling, 2**6 symbols


class BitRank:
    """Bits with a constant-time count of the ones before a position."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        block, rest = at >> 6, (at & 63).astype(np.uint64)
        return self.before[block] + np.bitwise_count(self.words[block] & ((np.uint64(1) << rest) - np.uint64(1)))


class WaveletMatrix:
    """Counts of a symbol before a position, over an alphabet of any size."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = []
        self.depth = max(1, int(size - 1).bit_length())
        for level in range(self.depth):
            bits = (symbols >> (self.depth - 1 - level)) & 1
            self.levels.append((BitRank(bits.astype(np.uint8)), int(len(bits) - bits.sum())))
            symbols = np.concatenate((symbols[bits == 0], symbols[bits == 1]))
        self.begin = self.descend(np.arange(size), np.zeros(size, np.int64))

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, (bits, zeros) in enumerate(self.levels):
            ones = bits.ones(at)
            at = np.where((symbol >> (self.depth - 1 - level)) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.descend(symbol, at) - self.begin[symbol]


def runs(common: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For every row the first row, and the row after the last, that share its first ``depth`` symbols."""
    begins = np.flatnonzero(common < depth)
    which = np.cumsum(common < depth) - 1
    ends = np.append(begins[1:], len(common))
    return begins[which], ends[which]


class FMIndex:
    """Index of sequences; every sequence has an owner number, and a pattern's answer is the least owner that holds it."""

    def __init__(self, symbols: np.ndarray, first: np.ndarray, owner: np.ndarray, window: int):
        if not 1 < window <= DEPTH:
            raise ValueError(f"windows of 2 to {DEPTH} words")
        self.window = window
        self.alphabet, dense = np.unique(symbols, return_inverse=True)
        length = np.diff(first)
        # every sequence is followed by a 0, which no pattern holds
        text = np.zeros(len(symbols) + len(length), np.int64)
        text[np.arange(len(symbols)) + np.repeat(np.arange(len(length)), length)] = dense + 1
        size, n = len(self.alphabet) + 1, len(text)
        ranks = [text.astype(np.int32)]  # by the first 1, 2, 4, ... symbols
        for r in range(ROUNDS):
            tail = np.zeros(n, np.int64)
            tail[: max(0, n - (1 << r))] = ranks[-1][1 << r :] + 1
            both = ranks[-1].astype(np.int64) * (n + size + 1) + tail
            order = np.argsort(both)
            step = np.concatenate(([0], np.cumsum(np.diff(both[order]) != 0)))
            rank = np.empty(n, np.int32)
            rank[order] = step
            ranks.append(rank)
        self.common = self._common(order, ranks, n)
        self.bwt = WaveletMatrix(text[order - 1], size)
        self.smaller = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=size))[:-1]))
        self.widest = runs(self.common, window - 1)
        whole = np.flatnonzero(self.common < window)
        self.run_of = np.cumsum(self.common < window) - 1
        self.least_owner = np.minimum.reduceat(np.repeat(owner, length + 1)[order], whole)

    @staticmethod
    def _common(order: np.ndarray, ranks: list[np.ndarray], n: int) -> np.ndarray:
        """How many symbols a row shares with the row before, up to ``DEPTH - 1``."""
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(n, np.int8)
        for r in range(ROUNDS - 1, -1, -1):
            inside = (a < n) & (b < n)
            same = inside & (ranks[r][np.minimum(a, n - 1)] == ranks[r][np.minimum(b, n - 1)])
            common[1:] += (same << r).astype(np.int8)
            a, b = a + (same << r), b + (same << r)
        return common

    def least_owners(self, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
        """For every position of the streamed sequences: the least owner of an indexed sequence that holds the ``window``
        symbols from there on, or -1 where the longest match is shorter.

        Each sequence is read from its end, one symbol a step, all at once. A match of the full length is first widened to
        all rows that share all but its last symbol. Where no row extends a match, it is widened, symbol by symbol from its
        end, until one does."""
        out = np.full(len(symbols), -1, np.int64)
        dense = np.searchsorted(self.alphabet, symbols)
        known = self.alphabet[np.minimum(dense, len(self.alphabet) - 1)] == symbols
        dense = np.where(known, dense + 1, 0)
        lanes = np.arange(len(first) - 1)
        at = first[1:] - 1
        lo, hi, depth = np.zeros(len(lanes), np.int64), np.full(len(lanes), len(self.common)), np.zeros(len(lanes), np.int64)
        live = at >= first[:-1]
        lanes, at, lo, hi, depth = lanes[live], at[live], lo[live], hi[live], depth[live]
        while len(lanes):
            full = depth >= self.window
            lo, hi = np.where(full, self.widest[0][lo], lo), np.where(full, self.widest[1][lo], hi)
            depth = np.where(full, self.window - 1, depth)
            c = dense[at]
            new_lo = self.smaller[c] + self.bwt.rank(c, lo)
            new_hi = self.smaller[c] + self.bwt.rank(c, hi)
            fails = (new_lo >= new_hi) | (c == 0)
            if fails.any():
                new_lo, new_hi, depth = self._widen(fails, c, at, lo, hi, depth, new_lo, new_hi)
            else:
                depth = depth + 1
            lo, hi = new_lo, new_hi
            found = depth == self.window
            out[at[found]] = self.least_owner[self.run_of[lo[found]]]
            at = at - 1
            live = at >= first[lanes]
            lanes, at, lo, hi, depth = lanes[live], at[live], lo[live], hi[live], depth[live]
        return out

    def _widen(self, fails, c, at, lo, hi, depth, new_lo, new_hi):
        """The longest shorter match of the failing lanes that their next symbol extends."""
        new_depth = np.where(fails, 0, depth + 1)
        new_lo, new_hi = np.where(fails, 0, new_lo), np.where(fails, len(self.common), new_hi)
        todo = np.flatnonzero(fails & (c > 0) & (depth > 0))
        for d in range(self.window - 2, -1, -1):
            if not len(todo):
                break
            try_ = todo[depth[todo] > d]
            if not len(try_):
                continue
            a, z = runs(self.common, d) if d else (np.zeros(len(self.common), np.int64), np.full(len(self.common), len(self.common)))
            l, h = a[lo[try_]], z[lo[try_]]
            x, y = self.smaller[c[try_]] + self.bwt.rank(c[try_], l), self.smaller[c[try_]] + self.bwt.rank(c[try_], h)
            ok = x < y
            new_lo[try_[ok]], new_hi[try_[ok]], new_depth[try_[ok]] = x[ok], y[ok], d + 1
            todo = np.setdiff1d(todo, try_[ok], assume_unique=True)
        return new_lo, new_hi, new_depth
