"""A compressed FM-index over word numbers, searched for many patterns at once.

The Burrows-Wheeler transform of all texts is held as a wavelet matrix: one bit vector per bit of the
word numbers, with a running count every 64 bits. Backward search takes one more word on the left per
step. `matching_statistics` streams texts through it from right to left and keeps, for each of their
positions, the interval of the longest match (up to a given length) that starts there.
"""

from __future__ import annotations

import numpy as np

from .suffixes import bits_for, suffix_array


class BitVector:
    """Bits with rank: ones(i) is the number of ones before i."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.uint32)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def ones(self, i: np.ndarray) -> np.ndarray:
        block = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block].astype(np.int64) + np.bitwise_count(self.words[block] & mask)


class WaveletMatrix:
    """rank(symbol, i): how often a symbol stands before position i."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels, self.zeros = [], []
        for level in range(bits - 1, -1, -1):
            bit = ((values >> level) & 1).astype(bool)
            self.levels.append(BitVector(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            values = np.concatenate([values[~bit], values[bit]])
        self.bits = bits

    def rank(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        """Occurrences of symbol before lo and before hi."""
        start = np.zeros_like(lo)
        for level, vector, zeros in zip(range(self.bits - 1, -1, -1), self.levels, self.zeros, strict=True):
            one = ((symbol >> level) & 1).astype(bool)
            a, b, s = vector.ones(lo), vector.ones(hi), vector.ones(start)
            lo = np.where(one, zeros + a, lo - a)
            hi = np.where(one, zeros + b, hi - b)
            start = np.where(one, zeros + s, start - s)
        return lo - start, hi - start


class FMIndex:
    """Index of texts laid out one after the other, a 0 behind each (see `suffixes`)."""

    def __init__(self, ids: np.ndarray, longest: int):
        bits = bits_for(ids.max(initial=1))
        sa = suffix_array(ids, bits)
        ends = np.flatnonzero(ids == 0)
        self.rows = np.concatenate([ends, sa.positions])  # an end mark is the smallest symbol
        before = np.where(self.rows > 0, ids[self.rows - 1], 0)
        self.transform = WaveletMatrix(before, bits)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=(1 << bits)))])
        self.longest = longest
        self._edges = self._borders(ids)

    def _borders(self, ids):
        """For each length, the rows at which a new group of suffixes with that many equal words begins."""
        same = np.zeros(len(self.rows), bool)
        same[1:] = True
        padded = np.concatenate([ids, np.zeros(self.longest, ids.dtype)])
        out = []
        for j in range(self.longest):
            word = padded[self.rows + j]
            same[1:] &= (word[1:] == word[:-1]) & (word[1:] > 0)
            out.append(np.append(np.flatnonzero(~same), len(self.rows)))
        return out

    def backward(self, word, lo, hi):
        """The rows of word + pattern, given the rows lo:hi of pattern."""
        a, b = self.transform.rank(word, lo, hi)
        return self.first[word] + a, self.first[word] + b

    def widened(self, lo, length):
        """The rows that share their first `length` words with row lo; all rows at length 0."""
        left, right = np.zeros_like(lo), np.full_like(lo, len(self.rows))
        for n in np.unique(length[length > 0]).tolist():
            at = np.flatnonzero(length == n)
            edges = self._edges[n - 1]
            i = np.searchsorted(edges, lo[at], "right")
            left[at], right[at] = edges[i - 1], edges[i]
        return left, right

    def matching_statistics(self, words: np.ndarray, first: np.ndarray):
        """(length, lo, hi) for each word of the texts words[first[t]:first[t + 1]].

        length is that of the longest match, at most `longest`, that starts at the word and stands in
        the index; lo:hi are its rows. Words that the index does not hold are given as 0.
        """
        n = len(words)
        lengths, los, his = (np.zeros(n, np.int64) for _ in range(3))
        at = first[1:] - 1
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(self.rows))
        length = np.zeros(len(at), np.int64)
        live = np.flatnonzero(at >= first[:-1])
        while len(live):
            here = at[live]
            word, l, h, m = words[here], lo[live], hi[live], length[live]
            full = np.flatnonzero(m >= self.longest)
            if len(full):
                m[full] -= 1
                l[full], h[full] = self.widened(l[full], m[full])
            m[word == 0] = 0
            trying = np.flatnonzero(word > 0)
            new_l, new_h = np.zeros_like(l), np.full_like(h, len(self.rows))
            while len(trying):
                a, b = self.backward(word[trying], l[trying], h[trying])
                good = b > a
                done = trying[good]
                new_l[done], new_h[done] = a[good], b[good]
                m[done] += 1
                trying = trying[~good]
                # Nothing of this length: let go of words on the right; a lone word has to be there.
                lost = m[trying] == 0
                trying = trying[~lost]
                m[trying] -= 1
                l[trying], h[trying] = self.widened(l[trying], m[trying])
            lengths[here], los[here], his[here] = m, new_l, new_h
            lo[live], hi[live], length[live] = new_l, new_h, m
            at[live] -= 1
            live = live[at[live] >= first[live]]
        return lengths, los, his

    def smallest(self, value: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least value[text position] over the rows of each interval lo:hi (none may be empty)."""
        if not len(lo):
            return np.zeros(0, value.dtype)
        pairs, which = np.unique(np.stack([lo, hi], 1), axis=0, return_inverse=True)
        # Intervals that start at the same row and nest are rare; reduceat takes them one by one.
        row_value = np.append(value[self.rows], np.iinfo(value.dtype).max)
        return np.minimum.reduceat(row_value, pairs.ravel())[::2][which.ravel()]
