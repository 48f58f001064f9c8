"""An FM-index over a sequence of word numbers: suffix array, wavelet matrix, backward search, sampled positions."""

from __future__ import annotations

import numpy as np

from casewatch.llm.batches import by_value

by_value(__name__)

# Every so many positions one keeps its place in the text.
SAMPLE = 8


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Start places of all suffixes in order; a 0 is a separator, smaller than all else, earlier ones smaller."""
    n = len(symbols)
    gaps = symbols == 0
    rank = np.where(gaps, np.cumsum(gaps) - 1, symbols.astype(np.int64) + int(gaps.sum()))
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (int(after.max()) + 1) + after
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        fresh = np.cumsum(np.r_[0, ranked[1:] != ranked[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        step *= 2


class WaveletMatrix:
    """The preceding symbols in suffix order, one row of bits for each bit of a symbol, with counts of ones."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        at = symbols
        for level in range(bits):
            bit = (at >> (bits - 1 - level)) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(at) - bit.sum()))
            at = np.concatenate([at[bit == 0], at[bit == 1]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        first, last = np.zeros(len(symbol), np.int64), place.astype(np.int64)
        for level in range(self.bits):
            one = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            a, b, zeros = self.ones[level][first], self.ones[level][last], self.zeros[level]
            first, last = np.where(one, zeros + a, first - a), np.where(one, zeros + b, last - b)
        return last - first

    def at(self, place: np.ndarray) -> np.ndarray:
        """The symbols at these places."""
        symbol, now = np.zeros(len(place), np.int64), place.astype(np.int64)
        for level in range(self.bits):
            ones = self.ones[level]
            before = ones[now]
            one = ones[now + 1] > before
            symbol = symbol * 2 + one
            now = np.where(one, self.zeros[level] + before, now - before)
        return symbol


class FMIndex:
    """Finds phrases in `symbols`: runs of words (numbers from 1) with single zeros between and behind them."""

    def __init__(self, symbols: np.ndarray, size: int):
        order = suffix_array(symbols)
        self.rows = len(symbols)
        before = symbols[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=size + 1))]).astype(np.int64)
        self.wavelet = WaveletMatrix(before.astype(np.int64), max(1, int(size).bit_length()))
        # Walks to the left end at a sampled place; the first word of each run is one, so none crosses a zero.
        kept = (order % SAMPLE == 0) | (before == 0)
        self.sampled = np.concatenate([[0], np.cumsum(kept)]).astype(np.int64)
        self.places = order[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [low, high) of suffixes that begin with each phrase, by backward search of all at once."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.rows, np.int64)
        for step in range(phrases.shape[1] - 1, -1, -1):
            live = np.flatnonzero((lengths > step) & (high > low))
            symbol = phrases[live, step]
            low[live] = self.first[symbol] + self.wavelet.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.wavelet.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of the suffixes in these rows, by walking left to the next sampled one."""
        rows, steps, found = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        left = np.arange(len(rows))
        while len(left):
            at = rows[left]
            index = self.sampled[at]
            known = self.sampled[at + 1] > index
            found[left[known]] = self.places[index[known]] + steps[left[known]]
            left = left[~known]
            symbol = self.wavelet.at(rows[left])
            rows[left] = self.first[symbol] + self.wavelet.rank(symbol, rows[left])
            steps[left] += 1
        return found
