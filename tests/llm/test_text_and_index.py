"""Word arrays, suffix arrays and the FM-index against plain Python."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from incidentlens.llm.fm_index import FMIndex, WaveletMatrix
from incidentlens.llm.suffixes import bits_for, intervals, suffix_array
from incidentlens.llm.textarrays import ALPHANUMERIC, NOT_SPACE, chunks, utf8, word_hashes, words

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB1 \n\t\x85\xa0éÅ世.", max_size=30)), max_size=8)


def layout(lists):
    ids = [x for one in lists for x in [*one, 0]]
    return np.array(ids, np.int64)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_pattern(texts):
    data, offsets = utf8(pa.array(texts, pa.string()))
    for inside, lower, pattern in ((NOT_SPACE, False, r"[^\x20\x09-\x0D]+"),
                                   (ALPHANUMERIC, True, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = words(data, offsets, inside, lower)
        got = [[w.data[w.start[i]:w.end[i]].tobytes().decode() for i in range(w.first[t], w.first[t + 1])]
               for t in range(len(texts))]
        low = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") if lower else t or "" for t in texts]
        assert got == [re.findall(pattern, t) for t in low]


def test_hashes_are_equal_for_equal_words_only():
    data, offsets = utf8(pa.array(["a b ab ba a", "ab\x00 ab b a"]))
    w = words(data, offsets, NOT_SPACE)
    names = [w.data[a:b].tobytes() for a, b in zip(w.start, w.end, strict=True)]
    hashes = word_hashes(w).tolist()
    assert len(set(hashes)) == len(set(names)) == len(set(zip(names, hashes, strict=True)))


def test_chunks_keep_all_rows():
    table = pa.table({"text": ["x" * n for n in (0, 5, 100, 1, 1, 1)] + [None], "n": range(7)})
    parts = list(chunks([table, table.slice(0, 0)], "text", 4))
    assert [n for p in parts for n in p["n"].to_pylist()] == list(range(7))
    assert len(parts) > 3


LISTS = st.lists(st.lists(st.integers(1, 3), max_size=12), min_size=1, max_size=6)


@settings(max_examples=60, deadline=None)
@given(LISTS, st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=6), min_size=1, max_size=5))
def test_suffix_intervals_are_all_occurrences(lists, patterns):
    ids = layout(lists)
    sa = suffix_array(ids, 15)  # four words to a number
    rows = np.zeros((len(patterns), 6), np.int64)
    for r, p in zip(rows, patterns, strict=True):
        r[:len(p)] = p
    lo, hi = intervals(sa, rows, np.array([len(p) for p in patterns]))
    for p, a, b in zip(patterns, lo, hi, strict=True):
        want = [i for i in range(len(ids)) if ids[i:i + len(p)].tolist() == p]
        assert sorted(sa.positions[a:b].tolist()) == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=200))
def test_wavelet_rank(values):
    values = np.array(values)
    matrix = WaveletMatrix(values, 4)
    for symbol in range(10):
        i = np.arange(len(values) + 1)
        lo, hi = matrix.rank(np.full(len(i), symbol), i, np.full(len(i), len(values)))
        assert lo.tolist() == [int((values[:k] == symbol).sum()) for k in i]
        assert hi.tolist() == [int((values == symbol).sum())] * len(i)


@settings(max_examples=60, deadline=None)
@given(LISTS, st.lists(st.lists(st.integers(0, 4), max_size=10), min_size=1, max_size=5))
def test_matching_statistics(lists, streamed):
    ids, longest = layout(lists), 5
    index = FMIndex(ids, longest)
    first = np.concatenate([[0], np.cumsum([len(s) for s in streamed])])
    flat = np.array([x for s in streamed for x in s], np.int64)
    in_index = np.isin(flat, ids) & (flat > 0)
    length, lo, hi = index.matching_statistics(np.where(in_index, flat, 0), first)
    text = "".join(map(chr, ids))
    at = 0
    for s in streamed:
        for i in range(len(s)):
            best = 0
            while best < longest and i + best < len(s) and s[i + best] and "".join(
                    map(chr, s[i:i + best + 1])) in text:
                best += 1
            assert length[at] == best
            if best:
                word = "".join(map(chr, s[i:i + best]))
                assert hi[at] - lo[at] == sum(text.startswith(word, k) for k in range(len(text)))
            at += 1
    assert bits_for(1) == 2
