"""A compressed FM-index over word sequences: BWT in a wavelet matrix of packed bits, queried for all patterns at once."""

from __future__ import annotations

import numpy as np


class BitRank:
    """Packed bits with ranks."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        raw = np.packbits(bits, bitorder="little")
        self.words = np.zeros(n // 64 + 1, np.uint64)
        self.words.view(np.uint8)[:len(raw)] = raw
        self.before = np.zeros(len(self.words) + 1, np.int32)
        self.before[1:] = np.cumsum(np.bitwise_count(self.words))
        self.zeros = n - int(self.before[-1])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first ``i`` bits."""
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & low)


class FMIndex:
    """Index of sequences of symbols 1, 2, ...; 0 ends a sequence. Answers patterns of up to ``depth`` symbols."""

    def __init__(self, text: np.ndarray, depth: int = 32):
        self.text, self.n, self.depth = text, len(text), depth
        rank, span = text.astype(np.int64), 1
        while span < depth:  # suffixes in order of their first ``depth`` symbols
            nxt = np.zeros(self.n, np.int64)
            nxt[:-span] = rank[span:]
            _, rank = np.unique(rank * (int(rank.max()) + 1) + nxt, return_inverse=True)
            span *= 2
        self.suffix = np.argsort(rank, kind="stable")
        bwt = text[self.suffix - 1]
        size = int(text.max()) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        self.levels, seq = [], bwt
        self.bits = max(1, size.bit_length())
        low = np.zeros(size, np.int64)
        symbols = np.arange(size)
        for k in reversed(range(self.bits)):
            bit = (seq >> k) & 1
            level = BitRank(bit.astype(bool))
            one = ((symbols >> k) & 1).astype(bool)
            r = level.ones(low)
            low = np.where(one, level.zeros + r, low - r)
            self.levels.append(level)
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        self.low = low  # where each symbol's range starts behind the last level

    def _rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol among the first i places of the BWT."""
        for k, level in zip(reversed(range(self.bits)), self.levels):
            r = level.ones(i)
            i = np.where((symbol >> k) & 1, level.zeros + r, i - r)
        return i - self.low[symbol]

    def matching_statistics(self, ends: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each end (last place of a pattern in the text): how many symbols back the text occurs twice or more.

        Backward search, one symbol further for all ends in each step, up to
        ``limit``. Also gives the suffix range of what matched in full.
        """
        length = np.zeros(len(ends), np.int64)
        lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), self.n, np.int64)
        live = np.arange(len(ends))
        for step in range(limit):
            at = ends[live] - step
            live = live[at >= 0]
            symbol = self.text[ends[live] - step]
            inside = symbol > 0
            live, symbol = live[inside], symbol[inside]
            a = self.first[symbol] + self._rank(symbol, lo[live])
            b = self.first[symbol] + self._rank(symbol, hi[live])
            more = b - a > 1
            live = live[more]
            lo[live], hi[live] = a[more], b[more]
            length[live] = step + 1
        return length, lo, hi


def first_of_ranges(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of values[lo:hi] for ranges that are equal or apart."""
    if not len(lo):
        return np.zeros(0, values.dtype)
    start, which = np.unique(lo, return_inverse=True)
    stop = np.zeros(len(start), np.int64)
    stop[which] = hi
    cuts = np.column_stack([start, stop]).ravel()
    padded = np.append(values, values[-1])
    return np.minimum.reduceat(padded, cuts)[::2][which]
