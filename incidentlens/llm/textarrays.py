"""Texts of Arrow batches as flat numpy arrays: bytes, words, hashes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 4 << 20
CHUNK_ROWS = 1 << 14
HASH_BYTES = 1 << 20
MULTIPLIER = 0x9E3779B97F4A7C15
WORD_MULTIPLIER = 0xD6E8FEB86659FD93


def byte_class(characters: bytes) -> np.ndarray:
    """Lookup table, true at the given bytes."""
    table = np.zeros(256, bool)
    table[list(characters)] = True
    return table


#: Bytes of words that are split at space, tab, line feed, vertical tab, form feed, carriage return.
NOT_SPACE = ~byte_class(b" \t\n\v\f\r")
#: Bytes of words made of digits, lower-case letters and everything beyond ASCII.
ALPHANUMERIC = byte_class(bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100)))
#: A-Z to a-z, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Words:
    """Words of several texts: bytes data[start[i]:end[i]]; text t has words first[t]:first[t + 1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def per_text(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The text that each word stands in."""
        return np.repeat(np.arange(len(self.first) - 1), self.per_text)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def chunks(batches, text: str, size: int = CHUNK_BYTES, rows: int = CHUNK_ROWS):
    """Tables of whole rows with about `size` bytes of text and `rows` rows at most; one long text is a chunk
    of its own."""
    for batch in batches:
        table = pa.Table.from_batches([batch]) if isinstance(batch, pa.RecordBatch) else batch
        if not table.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(table[text].cast(pa.large_string())), 0).to_numpy()
        total = np.cumsum(lengths)
        at = 0
        while at < len(total):
            before = total[at - 1] if at else 0
            upto = min(max(at + 1, int(np.searchsorted(total, before + size, "right"))), at + rows)
            yield table.slice(at, upto - at)
            at = upto


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, lower: bool = False) -> Words:
    """The words of texts whose bytes are data[offsets[t]:offsets[t + 1]]."""
    if lower:
        data = LOWER[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(offsets), np.int64))
    is_word = inside[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    after = np.zeros(len(data) + 1, bool)
    after[1:] = is_word
    here = np.zeros(len(data) + 1, bool)
    here[:-1] = is_word
    start = np.flatnonzero(here & (~after | border))
    end = np.flatnonzero(after & (~here | border))
    return Words(data, start, end, np.searchsorted(start, offsets))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers.kept
    if len(up) < n:
        inverse = pow(MULTIPLIER, -1, 1 << 64)
        up = np.full(n, MULTIPLIER, np.uint64)
        down = np.full(n, inverse, np.uint64)
        up[0] = down[0] = 1
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        if n <= 2 * HASH_BYTES:
            _powers.kept = up, down
    return up[:n], down[:n]


_powers.kept = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def word_hashes(w: Words) -> np.ndarray:
    """A 64-bit hash per word, the same for equal words everywhere."""
    out = np.empty(len(w.start), np.uint64)
    at = 0
    while at < len(out):
        base = w.start[at]
        upto = max(at + 1, int(np.searchsorted(w.end, base + HASH_BYTES, "right")))
        data = w.data[base:w.end[upto - 1]]
        up, down = _powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=total[1:])
        start, end = w.start[at:upto] - base, w.end[at:upto] - base
        out[at:upto] = mixed((total[end] - total[start]) * down[start])
        at = upto
    return out


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n consecutive words (the caller drops those that leave a text)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:m].copy()
    for j in range(1, n):
        out *= np.uint64(WORD_MULTIPLIER)
        out += hashes[j:j + m]
    return mixed(out)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All integers of the ranges starts[i] : starts[i] + lengths[i], one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return np.arange(total) + shift
