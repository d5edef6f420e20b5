"""Phrase collocations against plain counting, and the parse by itself."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from incidentlens.llm import collocations as co
from incidentlens.llm.textarrays import LOWER, utf8

SCHEMA = "doc_id long, text string, lang string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
        yield re.findall(r"[^\x20\x09]+", piece)


def plain_counts(rows, longest):
    counts = Counter()
    for _, text, lang in rows:
        for ws in pieces(text):
            for k in range(1, longest + 1):
                for i in range(len(ws) - k + 1):
                    counts[lang or "und", tuple(ws[i:i + k])] += 1
    return counts


def brute(rows, longest=3, least=10, covered=50, top=2000):
    counts = plain_counts(rows, longest)
    n = Counter()
    for (lang, p), f in counts.items():
        n[lang] += f if len(p) == 1 else 0
    found = {key: f for key, f in counts.items() if len(key[1]) > 1 and f >= least}
    out = {}
    for (lang, p), a in found.items():
        if any(100 * f >= covered * a and len(q) > len(p) and lang == other and
               any(q[i:i + len(p)] == p for i in range(len(q))) for (other, q), f in found.items()):
            continue
        cuts = [(1_000_000 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append(
            (-score, -a, " ".join(p).encode(), a, counts[lang, p[:k]], counts[lang, p[k:]], n[lang], score))
    return sorted((lang, rank, row[2].decode(), *row[3:]) for lang, rows in out.items()
                  for rank, row in enumerate(sorted(rows)[:top], 1))


def corpus_rows(seed, n=150):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "new", "York", "é", "中文", "a'b", "x-y", "12", "City", "of", "zz"]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\v", "\xa0"])
                       for _ in range(rng.randint(0, 60)))
        if i % 3 == 0:
            text += " new york city of the past" * rng.randint(1, 3)
        rows.append((i, text, rng.choice(["en", "en", "de", None])))
    return rows + rows[:5] + [(900, None, "en"), (901, "", "fr"), (902, " .,\n", "en"), (None, "new york", "en")]


@pytest.mark.parametrize(("seed", "longest", "top"), [(1, 3, 2000), (2, 3, 7), (3, 4, 2000), (4, 2, 2000)])
def test_equals_brute_force(corpus, seed, longest, top):
    rows = corpus_rows(seed)
    docs = corpus.createDataFrame(rows, SCHEMA).repartition(4)
    got = co.collocations(docs, longest=longest, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, longest, top=top)


def test_long_texts_are_read_in_parts(corpus, monkeypatch):
    monkeypatch.setattr(co, "PART_BYTES", 200)
    rng = random.Random(3)
    words = ["ab", "cd", "e", "é" * 30, "new", "york"]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", " ", ",", "\n"]) for _ in range(800)), "en")
            for i in range(6)] + [(9, "same " * 2000, "en"), (10, "q" * 5000, "en"), (11, "q" * 999 + " a b", "en")]
    docs = corpus.createDataFrame(rows, SCHEMA)
    got = sorted(tuple(r) for r in co.collocations(docs).collect())
    assert got == brute(rows)


@pytest.mark.parametrize("size", [40, 64, 1000])
def test_parts_own_every_byte_once(size):
    rng = np.random.default_rng(size)
    text = b"".join(bytes([97 + int(c)]) * int(k) + (b" " * int(s)) for c, k, s in
                    zip(rng.integers(0, 9, 200), rng.integers(1, 30, 200), rng.integers(1, 4, 200)))
    data, at = np.frombuffer(text, np.uint8), 0
    for part, own in co.parts(data, 2, size):
        assert part.tobytes() == text[at:at + len(part)]
        behind = text[at + own:].split()
        assert part[own:].tobytes().split()[:2] == behind[:2]
        assert own == len(part) or text[at + own:at + own + 1] == b" "
        at += own
    assert at == len(text)


@pytest.mark.parametrize(("longest", "modulus", "most"), [(3, 4, 1024), (3, 1, 1024), (4, 3, 1024), (3, 10**9, 5)])
def test_parse_counts_every_start_once(longest, modulus, most):
    rows = [r for r in corpus_rows(7) if r[1]]
    data, offsets = utf8(pa.array([r[1] for r in rows]))
    strings, own, _ = co.parse(LOWER[data], offsets, np.diff(offsets), longest, modulus, most)
    counts = Counter()
    for s, mine in zip(strings.to_pylist(), own.tolist(), strict=True):
        parted = [w for p in s.split("\n") for w in [*p.split(" "), None]][:-1]
        starts = [i for i, w in enumerate(parted) if w is not None][:mine]
        assert len(starts) == mine
        for i in starts:
            for k in range(1, longest + 1):
                if i + k <= len(parted) and None not in parted[i:i + k]:
                    counts["x", tuple(parted[i:i + k])] += 1
    assert counts == plain_counts([(0, r[1], "x") for r in rows], longest)
    again, _, _ = co.parse(LOWER[data], offsets, np.diff(offsets), longest, modulus, most)
    assert again.equals(strings)


def test_a_full_bitmap_loses_nothing(corpus):
    rows = corpus_rows(5)
    parsed = co.dictionary(corpus.createDataFrame(rows, SCHEMA))
    wide = {tuple(r) for r in co.phrase_counts(parsed).collect()}
    narrow = {tuple(r) for r in co.phrase_counts(parsed, most_bits=64).collect()}
    assert narrow == wide and any(r[1] == 3 for r in wide)


def test_equal_passages_are_one_entry(corpus):
    rng = random.Random(1)
    passage = " ".join(f"w{rng.randint(0, 99)}" for _ in range(300))
    rows = [(i, f"start {i} {passage} end {i}", "en") for i in range(50)]
    entries = co.dictionary(corpus.createDataFrame(rows, SCHEMA)).collect()
    inner = [r for r in entries if r.n == 50]
    assert sum(r.own for r in inner) > 200  # most of the passage stands once in the dictionary


def test_products_beyond_64_bits(corpus):
    big = 3_000_000_000_000
    counts = corpus.createDataFrame(
        [("x", 1, "a", big), ("x", 1, "b", big + 7), ("x", 2, "a b", big - 3)],
        "lang string, words int, phrase string, n long")
    totals = corpus.createDataFrame([("x", 2 * big + 7)], "lang string, n long")
    row = co.scored(counts, totals).collect()[0]
    assert row.score == 1_000_000 * (big - 3) ** 2 // (big * (big + 7))


def test_empty_and_clashing_columns(corpus):
    assert co.collocations(corpus.createDataFrame([], SCHEMA)).collect() == []
    assert co.collocations(corpus.createDataFrame([(1, None, "en"), (2, "", None)], SCHEMA)).collect() == []
    rows = corpus_rows(6, 60)
    docs = corpus.createDataFrame([(*r, "z", 4, 5) for r in rows], SCHEMA + ", phrase string, n int, own int")
    assert sorted(tuple(r) for r in co.collocations(docs).collect()) == brute(rows)
