"""Compressed full-text index over word numbers: a wavelet matrix on the Burrows-Wheeler transform.

Suffixes are ordered by their first ``DEPTH`` words, which is all that patterns of up to ``DEPTH``
words need: a backward step keeps an interval's occurrences together up to that length.
"""

from __future__ import annotations

import numpy as np

DEPTH = 16


class BitVector:
    """Packed bits with a count of ones before each word of 64."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int32)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])
        self.ones = int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones in front of each position."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        low = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)


class WaveletMatrix:
    """Rank of a symbol in front of a position, one bit vector per binary digit."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.digits = max(1, int(sigma - 1).bit_length())
        self.levels, self.zeros = [], []
        for d in range(self.digits - 1, -1, -1):
            bits = ((symbols >> d) & 1).astype(bool)
            self.levels.append(BitVector(bits))
            self.zeros.append(len(bits) - self.levels[-1].ones)
            symbols = np.concatenate([symbols[~bits], symbols[bits]])

    def interval(self, symbol, low, high):
        """Counts of each symbol in front of ``low`` and ``high``, relative to its own run."""
        start = np.zeros(len(symbol), np.int64)
        low, high = low.astype(np.int64), high.astype(np.int64)
        for d, level, zeros in zip(range(self.digits - 1, -1, -1), self.levels, self.zeros, strict=True):
            one = ((symbol >> d) & 1).astype(bool)
            a, b, c = level.rank(start), level.rank(low), level.rank(high)
            start = np.where(one, zeros + a, start - a)
            low = np.where(one, zeros + b, low - b)
            high = np.where(one, zeros + c, high - c)
        return low - start, high - start


class FMIndex:
    """Index of runs of word numbers (from 1 on); ``text`` holds each run behind a 0."""

    def __init__(self, text: np.ndarray, sigma: int, depth: int):
        n = len(text)
        ranks = text.astype(np.int64)
        by_length, length = {1: ranks}, 1
        while length < DEPTH:
            shifted = np.zeros(n, np.int64)
            shifted[:-length] = ranks[length:] + 1
            key = ranks * (int(ranks.max()) + 2) + shifted
            order = np.argsort(key, kind="stable")
            new = np.ones(n, bool)
            new[1:] = key[order][1:] != key[order][:-1]
            ranks = np.empty(n, np.int64)
            ranks[order] = np.cumsum(new) - 1
            length *= 2
            by_length[length] = ranks
        self.places = order  # of the suffixes in order
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.turned = WaveletMatrix(text[order - 1], sigma)  # what precedes each suffix
        # Suffixes that share their first depth - 1 words: where their run begins and ends.
        pieces, done = [], 0
        for size in (8, 4, 2, 1):
            if done + size <= depth - 1:
                moved = np.full(n, -1, np.int64)
                moved[: n - done] = by_length[size][done:]
                pieces.append(moved[order])
                done += size
        new = np.ones(n, bool)
        new[1:] = np.any([p[1:] != p[:-1] for p in pieces], axis=0) if pieces else False
        edges = np.append(np.flatnonzero(new), n)
        number = np.cumsum(new) - 1
        self.low, self.high = edges[number], edges[number + 1]

    def step(self, word, low, high):
        """Extend patterns by a word on the left: their intervals of suffixes."""
        a, b = self.turned.interval(word, low, high)
        return self.first[word] + a, self.first[word] + b

    def matches(self, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, depth: int):
        """Interval of the ``depth`` words that start at each word of each run, from right to left.

        After a full match the last word is let go, which leaves the run of suffixes that share
        ``depth - 1`` words, and the next word on the left is added: one step per word. A pattern
        that is not in the index gets an empty interval and is begun anew.
        """
        out_low = np.zeros(len(text), np.int64)
        out_high = np.zeros(len(text), np.int64)
        order = np.argsort(-sizes, kind="stable")
        ends, counts = (starts + sizes)[order], (sizes - depth + 1)[order]
        alive = int((counts > 0).sum())
        ends, counts = ends[:alive], counts[:alive]
        low, high = np.zeros(alive, np.int64), np.full(alive, len(self.places))
        for j in range(1, depth + 1):
            low, high = self.step(text[ends - j], low, high)
        for k in range(int(counts[0]) if alive else 0):
            at = ends - depth - k
            out_low[at], out_high[at] = low, high
            more = int(np.searchsorted(-counts, -(k + 1), "left"))  # runs with another window
            ends, counts, low, high, at = ends[:more], counts[:more], low[:more], high[:more], at[:more]
            if not more:
                break
            known = high > low
            a, b = self.low[np.minimum(low, len(self.low) - 1)], self.high[np.minimum(low, len(self.high) - 1)]
            low, high = self.step(text[at - 1], np.where(known, a, 0), np.where(known, b, 0))
            lost = np.flatnonzero(~known)
            if len(lost):
                p, q = np.zeros(len(lost), np.int64), np.full(len(lost), len(self.places))
                for j in range(depth - 1, -1, -1):
                    p, q = self.step(text[at[lost] - 1 + j], p, q)
                low[lost], high[lost] = p, q
        return out_low, out_high
