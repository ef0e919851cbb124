"""FM-index over integer symbols, vectorised over many patterns and many occurrences at a time."""

from __future__ import annotations

import numpy as np

SAMPLING = 16


def suffix_array(symbols: np.ndarray, bits: int) -> np.ndarray:
    """Start positions of the suffixes in order; ``symbols`` must end with a 0 that occurs nowhere else.

    The first sort packs as many symbols as fit into 62 bits. After it, only suffixes that are still tied are sorted, by
    the rank of what follows, over twice the length in each round.
    """
    n = len(symbols)
    width = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for step in range(width):
        key <<= bits
        key[: max(0, n - step)] |= symbols[step:]
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    first = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    tied = np.flatnonzero(~(first & np.concatenate((first[1:], [True]))))
    while len(tied):
        suffix = order[tied]
        after = suffix + width
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[suffix] * (n + 1) + second
        by_key = np.argsort(key, kind="stable")
        suffix, key = suffix[by_key], key[by_key]
        order[tied] = suffix
        first = np.concatenate(([True], key[1:] != key[:-1]))
        rank[suffix] = tied[np.maximum.accumulate(np.where(first, np.arange(len(tied)), 0))]
        tied = tied[~(first & np.concatenate((first[1:], [True])))]
        width *= 2
    return order


class BitRank:
    """A bit vector with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) + 64) // 64 * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)

    def rank(self, at: np.ndarray) -> np.ndarray:
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at >> 6] + np.bitwise_count(self.words[at >> 6] & low)


class FMIndex:
    """Backward search through wavelet-tree ranks; positions from sampled suffixes.

    ``symbols`` holds numbers from 1 to ``largest``; a terminator is added.
    """

    def __init__(self, symbols: np.ndarray, largest: int):
        text = np.concatenate((symbols, [0])).astype(np.int64)
        self.size, self.bits = len(text), max(1, int(largest).bit_length())
        order = suffix_array(text, self.bits)
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=largest + 1))))
        sampled = order % SAMPLING == 0
        self.sampled, self.positions = BitRank(sampled), order[sampled]
        self.levels: list[tuple[BitRank, int]] = []
        column = text[order - 1].astype(np.int32)
        for level in reversed(range(self.bits)):
            ones = (column >> level & 1).astype(bool)
            zeros = column[~ones]
            self.levels.append((BitRank(ones), len(zeros)))
            column = np.concatenate((zeros, column[ones]))
        # Where each symbol's own stretch begins after the last level.
        self.origin = self._descend(np.arange(largest + 1), np.zeros(largest + 1, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, (ones, zeros) in zip(reversed(range(self.bits)), self.levels, strict=True):
            before = ones.rank(at)
            at = np.where(symbol >> level & 1, zeros + before, at - before)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` in the first ``at`` rows of the transformed text."""
        return self._descend(symbol, at) - self.origin[symbol]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of equally long patterns, one per row of ``patterns``."""
        low, high = np.zeros(len(patterns), np.int64), np.zeros(len(patterns), np.int64)
        counts = np.diff(self.starts)
        live = np.flatnonzero((counts[patterns] > 0).all(axis=1))
        low[live], high[live] = 0, self.size
        for column in reversed(range(patterns.shape[1])):
            symbol = patterns[live, column]
            a = self.starts[symbol] + self.rank(symbol, low[live])
            b = self.starts[symbol] + self.rank(symbol, high[live])
            low[live], high[live] = a, b
            live = live[a < b]
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of the suffixes in these rows: step back until a sampled one is met."""
        found = np.empty(len(rows), np.int64)
        open_, at, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(open_):
            hit = self.sampled[at].astype(bool)
            found[open_[hit]] = self.positions[self.sampled.rank(at[hit])] + steps
            open_, at, steps = open_[~hit], at[~hit], steps + 1
            symbol, place = np.zeros(len(at), np.int64), at
            for level, (ones, zeros) in zip(reversed(range(self.bits)), self.levels, strict=True):
                bit, before = ones[place].astype(np.int64), ones.rank(place)
                symbol |= bit << level
                place = np.where(bit, zeros + before, place - before)
            at = self.starts[symbol] + place - self.origin[symbol]
        return found
