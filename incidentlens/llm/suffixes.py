"""Suffix arrays over word numbers, and the intervals of patterns in them.

Texts are laid out one after the other with a 0 behind each; word numbers are 1 or more. A 0 ends
every comparison, so a suffix never reaches into the next text. Words that no pattern holds may be
given as 0 too: then the suffixes that start with them are left out of the array.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class SuffixArray:
    keys: np.ndarray      # at each position: its next `width` words packed into one number
    positions: np.ndarray  # the suffixes in lexicographic order
    width: int
    bits: int


def packed(ids: np.ndarray, width: int, bits: int) -> np.ndarray:
    """The next `width` words of each position in one number; zeros behind a text's end."""
    key = ids.astype(np.int64)
    running = ids > 0
    for j in range(1, width):
        following = np.zeros_like(key)
        following[:-j] = ids[j:] if j < len(ids) else 0
        running &= following > 0
        key = (key << bits) | np.where(running, following, 0)
    return key


def bits_for(largest: int) -> int:
    return max(2, int(largest).bit_length())


def suffix_array(ids: np.ndarray, bits: int) -> SuffixArray:
    """Sort by the packed words first, then double the compared length for the ties only."""
    width = 62 // bits
    keys = packed(ids, width, bits)
    positions = np.flatnonzero(ids > 0)
    order = np.argsort(keys[positions], kind="stable")
    positions = positions[order]
    sorted_keys = keys[positions]
    rank = np.zeros(len(ids) + 1, np.int64)
    slots = np.arange(len(positions))
    reached = width
    value, open_end = sorted_keys, (sorted_keys & ((1 << bits) - 1)) > 0
    while len(slots):
        fresh = np.ones(len(slots), bool)
        fresh[1:] = (value[1:] != value[:-1])
        head = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))]
        rank[positions[slots]] = head + 1
        alone = fresh.copy()
        alone[:-1] &= fresh[1:]
        slots = slots[~alone & open_end]
        if not len(slots):
            break
        here = positions[slots]
        ahead = rank[np.minimum(here + reached, len(ids))]
        value = rank[here] * np.int64(len(ids) + 2) + ahead
        order = np.argsort(value, kind="stable")
        positions[slots] = here[order]
        value, open_end = value[order], ahead[order] > 0
        reached *= 2
    return SuffixArray(keys, positions, width, bits)


def intervals(sa: SuffixArray, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pattern (a row of word numbers, its first lengths[i] count) the suffixes lo:hi that
    start with it, found by binary search, `width` words at a step."""
    lo = np.zeros(len(patterns), np.int64)
    hi = np.full(len(patterns), len(sa.positions), np.int64)
    hi[(patterns == 0)[:, :].any(1) & _short(patterns, lengths)] = 0
    depth, first_keys = 0, sa.keys[sa.positions]
    while True:
        live = np.flatnonzero((hi > lo) & (lengths > depth))
        if not len(live):
            return lo, hi
        low, high = _bounds(patterns[live], lengths[live], depth, sa)
        if depth == 0:
            lo[live] = np.searchsorted(first_keys, low, "left")
            hi[live] = np.searchsorted(first_keys, high, "right")
        else:
            a, b = lo[live], hi[live]
            lo[live] = _search(sa, depth, a, b, low, False)
            hi[live] = _search(sa, depth, a, b, high, True)
        depth += sa.width


def _short(patterns, lengths):
    """Whether a 0 stands among the words that count."""
    zero = patterns == 0
    return np.where(zero.any(1), zero.argmax(1), patterns.shape[1]) < lengths


def _bounds(patterns, lengths, depth, sa):
    """The smallest and largest packed number that start with the pattern's words from `depth` on."""
    low = np.zeros(len(patterns), np.int64)
    spare = np.zeros(len(patterns), np.int64)
    for j in range(sa.width):
        at = depth + j
        counted = at < lengths
        word = np.where(counted, patterns[:, min(at, patterns.shape[1] - 1)], 0)
        low = (low << sa.bits) | word
        spare = np.where(counted, spare, (spare << sa.bits) | ((1 << sa.bits) - 1))
    return low, low | spare


def _search(sa, depth, a, b, value, after):
    a, b = a.copy(), b.copy()
    while True:
        live = np.flatnonzero(a < b)
        if not len(live):
            return a
        middle = (a[live] + b[live]) // 2
        found = sa.keys[np.minimum(sa.positions[middle] + depth, len(sa.keys) - 1)]
        right = found <= value[live] if after else found < value[live]
        a[live[right]] = middle[right] + 1
        b[live[~right]] = middle[~right]
