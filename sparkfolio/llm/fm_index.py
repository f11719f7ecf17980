"""FM-index over a wavelet matrix, for many patterns at once.

The text is a collection of strings over small integers.  Their suffixes are sorted by prefix doubling, the symbols before
the suffixes are held in a wavelet matrix (packed bits with counts per 64), and backward search narrows the suffix
intervals of all patterns together, symbol by symbol from the last.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Bit-packed levels of a sequence of integers below ``sigma``; answers how often a symbol occurs before a place."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        self.top = max(1, int(sigma - 1).bit_length())
        for level in range(self.top - 1, -1, -1):
            bit = (symbols >> level & 1).astype(bool)
            words = np.zeros(len(symbols) // 64 + 1, np.uint64)
            packed = np.packbits(bit, bitorder="little")
            words.view(np.uint8)[: len(packed)] = packed
            before = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words)[:-1], out=before[1:])
            self.levels.append((words, before, int(len(symbols) - bit.sum())))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        alphabet = np.arange(sigma)
        self.start = self._follow(alphabet, np.zeros(sigma, np.int64))

    def _follow(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, (words, before, zeros) in zip(range(self.top - 1, -1, -1), self.levels):
            word = at >> 6
            ones = before[word] + np.bitwise_count(words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(symbols >> level & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        return self._follow(symbols, at) - self.start[symbols]


class FMIndex:
    """Index of strings given as one sequence of symbols from 1, each string ended by a 0."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        stops = np.flatnonzero(text == 0)
        left = stops[np.searchsorted(stops, np.arange(n))] - np.arange(n)  # symbols up to the string's end
        rank, step, longest = text.astype(np.int64), 1, int(left.max(initial=0))
        while step <= longest:
            beyond = np.zeros(n, np.int64)
            inside = np.flatnonzero(left >= step)
            beyond[inside] = rank[inside + step]
            _, rank = np.unique(rank * (int(rank.max()) + 1) + beyond, return_inverse=True)
            step *= 2
        self.suffixes = np.argsort(rank, kind="stable")
        previous = np.where(self.suffixes > 0, text[self.suffixes - 1], 0)
        sigma = int(text.max(initial=0)) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.bwt = WaveletMatrix(previous.astype(np.int64), sigma)

    def search(self, patterns: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of patterns (one per row, all of one length). A pattern is given up, with an empty interval, as
        soon as fewer than ``least`` suffixes begin with its end."""
        low = self.first[patterns[:, -1]].copy()
        high = self.first[patterns[:, -1] + 1].copy()
        alive = np.flatnonzero(high - low >= least)
        for column in range(patterns.shape[1] - 2, -1, -1):
            symbol = patterns[alive, column]
            base = self.first[symbol]
            low[alive] = base + self.bwt.rank(symbol, low[alive])
            high[alive] = base + self.bwt.rank(symbol, high[alive])
            alive = alive[high[alive] - low[alive] >= least]
        given_up = np.ones(len(low), bool)
        given_up[alive] = False
        high[given_up] = low[given_up]
        return low, high
