"""The prefix trie: the double array itself, and the nodes against a plain dictionary of prefixes."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from incidentlens.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """The nodes of all rebuilt conversations, as tuples of the result's columns."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        start = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        paths[c] = tuple(own.get(start, [])[:h] + turns[h:])
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    kids = {p: 0 for p in members}
    leaves, saved = dict(kids), dict(kids)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p],
         hashlib.sha256(",".join(str(c) for c in sorted(m) if paths[c] == p).encode()).hexdigest())
        for p, m in members.items())


def got(df):
    assert df.columns == pt.RESULT_COLUMNS
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def conversations(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        conv = i if i % 7 else -i
        hot = rng.random() < 0.4
        for k in range(1 if rng.random() < 0.2 else rng.randint(1, 12)):
            text = "hello" if hot and k < 3 else rng.choice(["a", "bé", "", None, "ccc", f"x{conv}"])
            rows.append((conv, rng.choice([k, k, k, None]) if not hot else k, rng.choice(["user", None]) if not hot
                         else "user", text))
    rows += [(None, 1, "user", "left out")]
    return rows + rows[5:9]  # repeated rows, and turns of equal number


@pytest.mark.parametrize(("seed", "shard_turns", "bits"), [(1, 10_000, 64), (2, 30, 64), (3, 7, 64), (4, 60, 3)])
def test_nodes_equal_a_plain_trie(corpus, monkeypatch, seed, shard_turns, bits):
    monkeypatch.setattr(pt, "LEAST_TURNS", shard_turns)
    rows = conversations(seed)
    df = corpus.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(pt.conversation_trie(df, shard_turns, bits=bits)) == brute(rows)


def test_equal_conversations_spread_over_shards(corpus, monkeypatch):
    """A group of copies larger than a shard, its prefix and its extension."""
    monkeypatch.setattr(pt, "LEAST_TURNS", 10)
    monkeypatch.setattr(pt, "LISTING", 8)
    rows = [(c, k, "user", f"t{k}") for c in range(80) for k in range(3 if c % 5 else 12)]
    rows += [(1000 + c, k, "user", f"t{k}") for c in range(40) for k in range(12 + c % 2)]
    rows += [(2000 + c, 0, "user", "solo") for c in range(11, 30)]  # some are turnless
    df = corpus.createDataFrame(rows, SCHEMA)
    assert got(pt.conversation_trie(df, 10)) == brute(rows)


def test_a_long_conversation_and_long_texts(corpus):
    rows = [(5, k, "user", "y" * (k % 3)) for k in range(3000)] + [(6, k, "user", "y" * (k % 3)) for k in range(3001)]
    rows += [(7, 0, "user", "z" * 1_000_000), (7, 1, "user", "z" * 1_000_000 + "!")]
    df = corpus.createDataFrame(rows, SCHEMA)
    found = pt.conversation_trie(df, 1000)
    top = [r for r in found.collect() if r.depth == 0][0]
    assert top.n_convs == 3 and top.n_leaves == (2 if zlib.crc32(b"7") % 9 < 2 else 1)
    # Depths 1 to 3000 hold at least two conversations; saved bytes follow from the texts' lengths.
    assert top.saved_tokens >= sum(k % 3 for k in range(3000))
    assert found.count() >= 3002


def test_empty_and_clashing_columns(corpus):
    empty = corpus.createDataFrame([], SCHEMA)
    assert pt.conversation_trie(empty).collect() == []
    assert pt.conversation_trie(empty).columns == pt.RESULT_COLUMNS
    rows = [(1, 0, "user", "a"), (2, 0, "user", "a"), (5, 0, None, None)]
    df = corpus.createDataFrame([(*r, 7, "p", 3, "k") for r in rows],
                                SCHEMA + ", depth int, path string, shard int, key string")
    assert got(pt.conversation_trie(df)) == brute(rows)


@pytest.mark.parametrize("seed", range(4))
def test_double_array_holds_exactly_its_lists(seed):
    rng = np.random.default_rng(seed)
    lists = [rng.integers(1, [3, 50, 5000, 2][seed], rng.integers(0, 9)).tolist() for _ in range(400)]
    first = np.r_[0, np.cumsum([len(x) for x in lists])]
    symbols = np.array([c for x in lists for c in x], np.int64)
    trie = pt.build(symbols, first)
    prefixes = {tuple(x[:d]) for x in lists for d in range(1, len(x) + 1)}
    assert (trie.check >= 0).sum() == len(prefixes) + 1  # a slot for every prefix, and the root
    states, ends = pt.walk(trie, symbols, first)
    assert (states > 0).all() and (ends >= 0).all()
    name = {}
    for x, a in zip(lists, first[:-1], strict=True):
        for d in range(1, len(x) + 1):
            assert name.setdefault(states[a + d - 1], tuple(x[:d])) == tuple(x[:d])
    assert len(name) == len(prefixes)
    for x in ([7, 7, 7, 7, 7, 7, 7, 7, 7], [99_999], lists[0] + [4999]):
        _, end = pt.walk(trie, np.array(x), np.array([0, len(x)]))
        assert (end[0] >= 0) == (tuple(x) in prefixes)


def test_owners():
    # Shards: a b..ab | ab..ab | ab..abd | abd..x, with what each shares at its border and within
    borders = [(-1, 0), (2, 2), (2, 2), (3, 0)]
    assert pt.owners(borders, 1).tolist() == [0, 0, 0]
    assert pt.owners(borders, 2).tolist() == [0, 0, 0]
    assert pt.owners(borders, 3).tolist() == [0, 0, 0, 2]
    # The middle shard begins with one node of depth 1 and ends with another.
    assert pt.owners([(-1, 0), (1, 0), (1, 1)], 2).tolist() == [0, 1]
