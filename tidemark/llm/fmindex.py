"""An FM-index over a sequence of integer symbols, searched for many phrases at once.

The Burrows-Wheeler transform is held as a wavelet matrix whose levels are bit vectors with
popcount directories; occurrences are located by walking to suffixes whose position is a
multiple of ``SAMPLE``. All steps work on arrays: one call searches all phrases.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in ascending order, by prefix doubling; the last symbol must be a unique smallest."""
    _, rank = np.unique(text, return_inverse=True)
    rank, n, width = rank.astype(np.int64), len(text), 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if new[-1] == n - 1:
            return order
        rank[order] = new
        width *= 2


class Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        held = np.zeros((self.n // 64 + 1) * 64, np.uint8)
        held[: self.n] = bits
        self.words = np.packbits(held, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before ``at``."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)


class FMIndex:
    def __init__(self, symbols: np.ndarray, most: int):
        """``symbols`` are from 1 to ``most``."""
        text = np.append(symbols.astype(np.int64), 0)
        order = suffix_array(text)
        last = text[order - 1]
        counts = np.bincount(text, minlength=most + 1)
        self.n = len(text)
        self.before = np.cumsum(counts) - counts
        self.levels: list[tuple[int, Bits, int]] = []
        column = last
        for shift in reversed(range(max(1, int(most).bit_length()))):
            bits = (column >> shift) & 1
            self.levels.append((shift, Bits(bits), int(len(bits) - bits.sum())))
            column = np.concatenate([column[bits == 0], column[bits == 1]])
        self.start = self._down(np.arange(most + 1), np.zeros(most + 1, np.int64))
        sampled = order % SAMPLE == 0
        self.sampled, self.positions = Bits(sampled), order[sampled]

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where((symbol >> shift) & 1, zeros + ones, at - ones)
        return at

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``phrases``, the range of suffixes that start with it (empty: equal ends)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n)
        live = np.arange(len(phrases))
        for symbol in phrases.T[::-1]:
            symbol = symbol[live]
            base = self.before[symbol] - self.start[symbol]
            low[live], high[live] = base + self._down(symbol, low[live]), base + self._down(symbol, high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        high = np.where(low < high, high, low)
        return low, high

    def _back(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix that is longer by one symbol."""
        symbol, at = np.zeros(len(row), np.int64), row
        for shift, bits, zeros in self.levels:
            one = bits.get(at).astype(np.int64)
            ones = bits.rank(at)
            symbol |= one << shift
            at = np.where(one, zeros + ones, at - ones)
        return self.before[symbol] + at - self.start[symbol]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The position in the text of each row's suffix."""
        found, at, steps = np.empty(len(rows), np.int64), rows.copy(), 0
        open_ = np.arange(len(rows))
        while len(open_):
            here = self.sampled.get(at[open_]).astype(bool)
            done = open_[here]
            found[done] = self.positions[self.sampled.rank(at[done])] + steps
            open_ = open_[~here]
            at[open_] = self._back(at[open_])
            steps += 1
        return found
