"""Packing and sharding: layout, round trips, and the plans against plain best fit."""

import random
import zlib

import numpy as np
import pytest

from incidentlens.llm import packing, sharding


def test_fast_ids_equal_the_tokenizers_over_latin_text():
    slow, fast = packing.Encoder(packing.vocabulary()[0]), packing.Encoder(*packing.vocabulary())
    for c in range(0x250):
        s = chr(c)
        text = f"ab{s}cd {s}x {s}{s} 12{s}3\n{s}\n\n {s} '{s}ll  {s}"
        assert slow(text) == fast(text), hex(c)
    for text in ("", " ", "Größe  naïve\r\n\t", "世界 hello", "a<|endoftext|>b", "😀 x", "  y", "I'll we've"):
        assert slow(text) == fast(text)


def test_fast_ids_equal_the_tokenizers_on_whole_texts(corpus):
    slow, fast = packing.Encoder(packing.vocabulary()[0]), packing.Encoder(*packing.vocabulary())
    for row in corpus.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        assert slow(row.text or "") == fast(row.text or "")


def test_clashing_columns_are_ignored(corpus):
    docs = corpus.createDataFrame([(1, "a b"), (2, "a b"), (2, "a b"), (3, None)], "doc_id long, text string")
    more = docs.selectExpr("*", "7 AS piece", "'x' AS size", "1 AS shard", "2 AS length")
    assert packing.pack_documents(more).columns == packing.pack_documents(docs).columns
    assert packing.pack_documents(more).count() == 4
    assert sharding.shard_documents(more).columns == sharding.shard_documents(docs).columns
    assert sharding.shard_documents(more).count() == 4


def test_cut():
    assert packing.cut(0, 8) == []
    assert packing.cut(8, 8) == [(0, 8)]
    assert packing.cut(20, 8) == [(0, 4), (4, 8), (12, 8)]
    assert packing.cut(16, 8) == [(0, 8), (8, 8)]


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece(seed):
    rng, capacity = random.Random(seed), 64
    histogram = {rng.randint(1, capacity): rng.randint(1, 40) for _ in range(rng.randint(1, 40))}
    groups = packing.plan(histogram, capacity)
    used = {}
    for count, held in groups:
        assert count > 0 and sum(n * t for n, t in held) <= capacity
        assert sum(t for n, t in held if 3 * n > capacity) <= 2
        for n, t in held:
            used[n] = used.get(n, 0) + count * t
    assert used == histogram
    rooms = []  # first fit decreasing, piece by piece
    for n in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
        at = next((i for i, room in enumerate(rooms) if room >= n), None)
        if at is None:
            rooms.append(capacity - n)
        else:
            rooms[at] -= n
    assert sum(c for c, _ in groups) <= 1.03 * len(rooms) + 1


def test_large_pieces_are_matched_as_well_as_possible():
    rng, capacity = random.Random(1), 90
    for _ in range(30):
        sizes = [rng.randint(31, 90) for _ in range(12)]
        histogram = {s: sizes.count(s) for s in sizes}
        left, bins = sorted(sizes), 0
        while left:  # the largest with the largest that fits is optimal for pairs
            a = left.pop()
            mate = max((m for m in left if m + a <= capacity), default=None)
            if mate is not None:
                left.remove(mate)
            bins += 1
        assert sum(c for c, _ in packing.plan(histogram, capacity)) == bins


def test_packed_documents(corpus):
    rows = [(i, "word " * (i * 7)) for i in range(40)] + [(50, None), (51, ""), (3, "word " * 21), (60, "long text " * 3000)]
    docs = corpus.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(3)
    out = packing.pack_documents(docs, capacity=256).toPandas()
    encode = packing.Encoder(*packing.vocabulary())
    ids = {d: np.array([*encode(t or ""), 0], "<u4") for d, t in rows}
    assert out.groupby("sequence_id")["length"].sum().max() <= 256
    by = out.sort_values(["sequence_id", "offset"])
    assert (by.offset == (by.offset + by.length).groupby(by.sequence_id).shift(fill_value=0)).all()
    for d, part in out.groupby("doc_id"):
        for r in part.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[d][r.start:r.start + r.length])
        copies = 2 if d == 3 else 1
        assert part["length"].sum() == copies * len(ids[d])
    assert packing.pack_documents(docs.limit(0)).count() == 0
    assert packing.gaps_in(packing.pack_documents(docs, capacity=256)).count() == 0


def test_room_tree_finds_the_tightest():
    rng, tree, plain = random.Random(2), sharding.RoomTree(), []
    for i in range(400):
        if rng.random() < 0.6:
            item = (rng.randint(0, 50), i)
            tree.add(*item)
            plain.append(item)
        else:
            size = rng.randint(0, 55)
            want = min((p for p in plain if p[0] >= size), default=None)
            assert tree.take(size) == want
            if want:
                plain.remove(want)


def test_best_fit_decreasing_is_that_of_single_groups():
    rng = random.Random(3)
    for _ in range(20):
        sizes = [rng.randint(1, 30) for _ in range(60)]
        rooms = []
        for s in sorted(sizes, reverse=True):
            fit = [(r, i) for i, r in enumerate(rooms) if r >= s]
            if fit:
                rooms[min(fit)[1]] -= s
            else:
                rooms.append(50 - s)
        kinds = sorted(set(sizes))
        out = sharding.best_fit_decreasing(kinds, [sizes.count(k) for k in kinds], 50)
        load = {}
        for size, n, shard in out:
            load[shard] = load.get(shard, 0) + size * n
        assert sorted(50 - v for v in load.values()) == sorted(rooms)


def test_shards(corpus):
    rng = random.Random(4)
    rows = [(i, "x" * rng.randint(0, 300)) for i in range(400)] + [(1000 + i, "same text " * 20) for i in range(60)]
    rows += [(2000, None), (2001, ""), (5, rows[5][1])]
    docs = corpus.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(4)
    out = sharding.shard_documents(docs, n_shards=8).toPandas()
    assert len(out) == len(rows)
    text = dict(rows)
    assert all(r.size == len((text[r.doc_id] or "").encode()) + 16 and
               r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) for r in out.itertuples())
    assert out.groupby(out.doc_id.map(lambda d: text[d] or "")).shard.nunique().max() == 1
    for _, part in out.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    load = out.groupby("shard")["size"].sum().sort_values()
    assert len(load) == 8
    # The copies' group is larger than the mean; the others are near equal.
    rest = load.iloc[:-1] if load.iloc[-1] > load.sum() / 8 * 1.1 else load
    assert rest.max() - rest.min() < 0.05 * rest.mean()
    assert sharding.shard_documents(docs.limit(0)).count() == 0
