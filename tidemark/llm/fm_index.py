"""A word-level FM-index over a wavelet matrix, with backward search for many patterns at once."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Rank over a sequence of small integers: one packed bit vector with block counts per bit level."""

    def __init__(self, seq: np.ndarray, sigma: int) -> None:
        self.size = seq.size
        self.levels = max(1, int(sigma - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        first = np.zeros(sigma, np.int64)
        symbol = np.arange(sigma)
        seq = seq.astype(np.int32)
        for level in range(self.levels - 1, -1, -1):
            bit = ((seq >> level) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(seq.size // 64 + 1, np.uint64)
            words.view(np.uint8)[: packed.size] = packed
            counts = np.bitwise_count(words).astype(np.int32)
            self.words.append(words)
            self.before.append(np.cumsum(counts, dtype=np.int32) - counts)
            self.zeros.append(int(seq.size - np.count_nonzero(bit)))
            seq = np.concatenate((seq[~bit], seq[bit]))
            first = self._down(first, ((symbol >> level) & 1).astype(bool), len(self.words) - 1)
        self.first = first

    def _down(self, at: np.ndarray, one: np.ndarray, k: int) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        ones = self.before[k][word] + np.bitwise_count(self.words[k][word] & mask)
        return np.where(one, self.zeros[k] + ones, at - ones)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of symbol[i] before position at[i]."""
        at = at.astype(np.int64)
        for k in range(self.levels):
            at = self._down(at, ((symbol >> (self.levels - 1 - k)) & 1).astype(bool), k)
        return at - self.first[symbol]


class FMIndex:
    """Index of word sequences; ``text`` holds symbols from 1 up, and 0 after each sequence.

    Suffixes are sorted by their first ``depth`` symbols, which is all that
    patterns of up to ``depth`` symbols need.  What stays of the order of
    suffixes is the owner of each (``owner``, by position), so that an interval
    of suffixes tells its smallest owner without their positions.
    """

    def __init__(self, text: np.ndarray, depth: int, owner: np.ndarray) -> None:
        n = text.size
        rank, width = text.astype(np.int64), 1
        order = np.argsort(rank)
        while width < depth + 1:
            ahead = np.zeros(n, np.int64)
            ahead[: max(n - width, 0)] = rank[width:] + 1
            key = rank * (int(rank.max()) + 2) + ahead
            order = np.argsort(key)
            key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
            width *= 2
        self.owner = owner[order]
        sigma = int(text.max()) + 1
        self.bwt = WaveletMatrix(text[order - 1], sigma)
        self.start = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))

    def search(self, text: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of the patterns text[at : at + length]; stops for one that occurs once only."""
        low, high = np.zeros(at.size, np.int64), np.ones(at.size, np.int64)
        live = np.arange(at.size)
        for k in range(length - 1, -1, -1):
            c = text[at[live] + k]
            if k == length - 1:
                low[live], high[live] = self.start[c], self.start[c + 1]
            else:
                both = self.bwt.rank(np.concatenate((c, c)), np.concatenate((low[live], high[live])))
                low[live], high[live] = self.start[c] + both[: c.size], self.start[c] + both[c.size :]
            live = live[high[live] - low[live] > 1]
            if not live.size:
                break
        return low, high

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest owner of each interval; none may be empty.  Equal intervals are looked at once."""
        if not low.size:
            return np.zeros(0, self.owner.dtype)
        lows, first, back = np.unique(low * (self.owner.size + 1) + high, return_index=True, return_inverse=True)
        ends = np.stack((low[first], high[first]), axis=1).ravel()
        held = np.concatenate((self.owner, self.owner[-1:]))
        return np.minimum.reduceat(held, ends)[::2][back]
