"""An FM-index over integer symbols in NumPy: wavelet matrix, backward search, sampled suffix positions.

The text is runs of symbols 1 and up, set apart by separators (0). Each separator counts as a symbol of its own, so no
match crosses one, and suffixes need sorting no further than their separator.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places of the sorted suffixes, by doubling; separators are ordered by place."""
    n = len(text)
    bars = text == 0
    m = int(bars.sum())
    rank = np.where(bars, np.cumsum(bars) - 1, text.astype(np.int64) + m)
    order = np.argsort(rank, kind="stable")
    k = 0
    while n:
        ahead = np.zeros(n, np.int64)
        if k:
            ahead[: n - k] = rank[k:] + 1
        key = rank * (int(rank.max()) + 2) + ahead if k else rank
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = new
        if int(rank.max()) == n - 1:
            break
        k = max(1, 2 * k)
    return order


class WaveletMatrix:
    """Rank and access on a sequence of integers below 2 ** levels, for arrays of queries at once."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.n = levels, len(symbols)
        self.words: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        self.zeros: list[int] = []
        symbols = symbols.astype(np.int64)
        for level in range(levels - 1, -1, -1):
            bits = (symbols >> level & 1).astype(np.uint8)
            packed = np.packbits(np.concatenate([bits, np.zeros(-len(bits) % 64 + 64, np.uint8)]), bitorder="little").view("<u8")
            self.words.append(packed)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]))
            self.zeros.append(int(len(bits) - bits.sum()))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Set bits before ``at``."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][word] + np.bitwise_count(self.words[level][word] & mask)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol comes before each place."""
        low = np.zeros_like(at)
        for level in range(self.levels):
            one = (symbol >> (self.levels - 1 - level) & 1).astype(bool)
            a, b = self._ones(level, low), self._ones(level, at)
            low = np.where(one, self.zeros[level] + a, low - a)
            at = np.where(one, self.zeros[level] + b, at - b)
        return at - low

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for level in range(self.levels):
            one = self._ones(level, at + 1) - self._ones(level, at)
            ones = self._ones(level, at)
            out = out << 1 | one
            at = np.where(one == 1, self.zeros[level] + ones, at - ones)
        return out


class FMIndex:
    """``text``: integers, 0 for separators, its last symbol one of them. ``rate``: one in so many places is sampled."""

    def __init__(self, text: np.ndarray, sigma: int, rate: int = 8):
        order = suffix_array(text)
        self.bwt = WaveletMatrix(text[order - 1], max(1, int(sigma).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma + 1))]).astype(np.int64)
        # Places are sampled from each run's start, so that walking back never steps over a separator.
        places = np.arange(len(text))
        begins = np.maximum.accumulate(np.where(np.concatenate([[True], text[:-1] == 0]), places, 0))
        kept = (places - begins) % rate == 0
        self.sampled = kept[order]
        self.sample_rank = np.cumsum(self.sampled) - 1
        self.samples = order[self.sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals [low, high) of phrases, one a row, aligned to the right."""
        width = phrases.shape[1]
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.bwt.n, np.int64)
        for step in range(width):
            live = np.flatnonzero((lengths > step) & (low < high))
            if not len(live):
                break
            symbol = phrases[live, width - 1 - step].astype(np.int64)
            low[live] = self.first[symbol] + self.bwt.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.bwt.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of suffixes: steps back to a sampled one."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        live = np.flatnonzero(~self.sampled[rows])
        while len(live):
            symbol = self.bwt.access(rows[live])
            rows[live] = self.first[symbol] + self.bwt.rank(symbol, rows[live])
            steps[live] += 1
            live = live[~self.sampled[rows[live]]]
        return self.samples[self.sample_rank[rows]] + steps
