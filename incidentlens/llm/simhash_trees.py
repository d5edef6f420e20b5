"""SimHash near-dedup with vantage-point trees.

A fingerprint is built inside the task that holds the text, `STEP` shingles at a time. Equal fingerprints
become one row before anything is compared. A vantage-point tree over a sample of fingerprints deals them to
shards: each goes to its home shard and, as a query, to every shard that its ball of `reach` bits may
overlap by the triangle inequality. A shard is searched the same way, by vantage points down to small
leaves that are compared bit by bit, so all pairs within reach are found. A shard hands out a spanning
forest of the links it found, never all pairs; the forest's components are those of the links.

A ball of near copies has no vantage point that cuts it: nearly all of it lies near every border. Such a
leaf of the tree is not cut, and within two bits it is searched by midpoints: two fingerprints are at most
two bits apart if and only if both are at most one bit from some value, so each goes, 65 times, to the
parts of the values around it. A value has 65 fingerprints at most, whatever the size of the ball.

The tree's sample is at most an eighth of the fingerprints and about `SAMPLE` of them; it decides how
even the shards are, never which pairs are found.

Defined results: a null, empty or wordless text has fingerprint zero and is linked like any other; a
text of one or two words has one shingle; repeated rows are answered each; rows without an id are linked
too, and a component of nothing else has a null id; an empty table gives no rows. A text is one value; a task
takes about ten bytes a byte of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import discard, stored
from .textarrays import LOWER, NOT_SPACE, Words, chunks, mixed, ranges, utf8, words

SHINGLE = 3
REACH = 2
SEED = 42
SAMPLE = 32_768
SHARD_ROWS = 4_096
LEAF = 128
BLOCK = 1 << 19
#: Shingles that are hashed at once, and bytes of short texts.
STEP, TEXT_BYTES = 1 << 15, 1 << 20
#: A cut is useless if more than this share lies on both sides of it, per bit of reach.
MOST_BOTH = 0.25
#: Leaves of the tree that fill so many shards are dealt by midpoints, so many fingerprints at a time.
DENSE_SHARDS, DEAL_ROWS = 4, 1 << 13
#: Leaves of this many points are searched by midpoints, if no vantage point cuts them.
DENSE = 16 * LEAF
BITS = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])

#: For each byte its bits, one in each byte of a 64-bit number, so that up to 255 can be added at once.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints_of(column, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The fingerprint of each text, as unsigned 64-bit numbers."""
    from xxhash import xxh64_intdigest

    data, offsets = utf8(column)
    out = np.zeros(len(offsets) - 1, np.uint64)
    if not len(data):
        return out
    data = LOWER[data]
    w = words(data, offsets, NOT_SPACE)
    n_shingles = np.where(w.per_text > 0, np.maximum(w.per_text - shingle + 1, 1), 0)
    upto = np.cumsum(n_shingles)
    ones = np.zeros((len(out), 64), np.int64)
    for s in range(0, int(upto[-1]), STEP):
        at = np.arange(s, min(s + STEP, int(upto[-1])))
        text = np.searchsorted(upto, at, "right")
        first = w.first[text] + at - (upto - n_shingles)[text]
        last = np.minimum(first + shingle, w.first[text + 1])
        begin, end, joined = _joined(w, first, last)
        h = np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in zip(begin, end, strict=True)),
                        np.uint64, len(at))
        # Runs of one text, 255 at most.
        new = np.r_[True, text[1:] != text[:-1]]
        run = np.arange(len(at)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        start = np.flatnonzero(run % 255 == 0)
        lanes = np.add.reduceat(_LANES[h.view(np.uint8).reshape(-1, 8)], start, axis=0).view(np.uint8)
        np.add.at(ones, text[start], lanes.reshape(-1, 64))
    bits = 2 * ones > n_shingles[:, None]
    out[:] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def _joined(w: Words, first: np.ndarray, last: np.ndarray):
    """Where each run of words first[i]:last[i] stands in bytes of these words joined by spaces."""
    low, high = int(first[0]), int(last.max())
    start, length = w.start[low:high], w.end[low:high] - w.start[low:high]
    place = np.cumsum(length + 1) - (length + 1)
    flat = np.full(int(place[-1] + length[-1]), 0x20, np.uint8)
    source = ranges(start, length)
    flat[source + np.repeat(place - start, length)] = w.data[source]
    return place[first - low].tolist(), (place + length)[last - 1 - low].tolist(), flat.tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of the documents; fp holds the 64 bits as a signed number."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for table in chunks(batches, "text", TEXT_BYTES):
            fp = fingerprints_of(table["text"], shingle).view(np.int64)
            yield from pa.table({"doc_id": table["doc_id"], "fp": pa.array(fp)}).to_batches()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, fp long")


def _distance(a, b):
    return np.bitwise_count(a ^ b).astype(np.int64)


def _split(points: np.ndarray, reach: int, tries: int = 8):
    """(vantage point, radius) that leaves the fewest on both sides, or None if nothing is split."""
    best = None
    for p in points[np.linspace(0, len(points) - 1, min(tries, len(points))).astype(int)]:
        count = np.bincount(_distance(points, p), minlength=65 + 2 * reach)
        below = np.cumsum(count)
        for radius in range(64):
            share = below[radius] / len(points)
            if 0.3 <= share <= 0.7:
                both = count[max(0, radius - reach + 1):radius + reach + 1].sum() / len(points)
                if best is None or both < best[0]:
                    best = both, p, radius
        if best is None:
            radius = int(np.argmin(np.abs(below[:64] - len(points) / 2)))
            share = below[radius] / len(points)
            both = count[max(0, radius - reach + 1):radius + reach + 1].sum() / len(points)
            if 0.05 <= share <= 0.95:
                best = both, p, radius
    return best[1:] if best and best[0] <= MOST_BOTH * reach else None


def fit_tree(sample: np.ndarray, n_shards: int, reach: int = REACH) -> tuple[list[tuple], np.ndarray]:
    """Nodes (vantage point, radius, inner, outer); a child below zero is leaf -1 - child. Also how many shards
    a leaf is expected to fill."""
    nodes, leaves = [], []

    def build(points, share):
        cut = _split(points, reach) if share > 1 and len(points) >= 8 else None
        if cut is None:
            leaves.append(share)
            return -len(leaves)
        p, radius = cut
        inner = _distance(points, p) <= radius
        at = len(nodes)
        nodes.append(None)
        left = build(points[inner], share * inner.mean())
        right = build(points[~inner], share * (1 - inner.mean()))
        nodes[at] = (p, radius, left, right)
        return at

    build(np.sort(sample), n_shards)
    return nodes, np.array(leaves)


def route(nodes, points: np.ndarray, reach: int = REACH):
    """(point index, shard, whether it is the point's home) for every shard a point's ball may overlap."""
    if not nodes:
        return np.arange(len(points)), np.zeros(len(points), np.int64), np.ones(len(points), bool)
    out, work = [], [(0, np.arange(len(points)), np.ones(len(points), bool))]
    while work:
        at, index, home = work.pop()
        if at < 0:
            out.append((index, np.full(len(index), -1 - at), home))
            continue
        p, radius, inner, outer = nodes[at]
        d = _distance(points[index], p)
        near, far = d - reach <= radius, d + reach > radius
        work.append((inner, index[near], home[near] & (d[near] <= radius)))
        work.append((outer, index[far], home[far] & (d[far] > radius)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Forest:
    """Pairs in, a spanning forest out, in bounded memory."""

    def __init__(self, most: int = 1 << 17):
        self.a, self.b, self.n, self.most = [], [], 0, most

    def add(self, a, b):
        self.a.append(a)
        self.b.append(b)
        self.n += len(a)
        if self.n > 2 * self.most:
            a, b = self.edges()
            self.a, self.b, self.n = [a], [b], len(a)
            self.most = max(self.most, len(a))

    def edges(self):
        if not self.n:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        node, at = np.unique(np.concatenate(self.a + self.b), return_inverse=True)
        a, b = np.split(at, 2) if len(at) == 2 * self.n else (at[:self.n], at[self.n:])
        root = np.arange(len(node))
        while True:
            x, y = root[a], root[b]
            low, high = np.minimum(x, y), np.maximum(x, y)
            if (low == high).all():
                break
            np.minimum.at(root, high, low)
            while True:
                further = root[root]
                if (further == root).all():
                    break
                root = further
        child = np.flatnonzero(root != np.arange(len(node)))
        return node[child], node[root[child]]


def links(members: np.ndarray, queries: np.ndarray, reach: int = REACH):
    """A spanning forest of all pairs (query, member) within reach; each side holds distinct values."""
    forest = Forest()
    work = [(members, queries)]
    while work:
        points, asked = work.pop()
        if not len(points) or not len(asked):
            continue
        cut = _split(points, reach) if len(points) > LEAF else None
        if cut is None:
            _compare(points, asked, reach, forest)
            continue
        p, radius = cut
        d, q = _distance(points, p), _distance(asked, p)
        work.append((points[d <= radius], asked[q - reach <= radius]))
        work.append((points[d > radius], asked[q + reach > radius]))
    return forest.edges()


def _compare(points, asked, reach, forest):
    """All pairs of a leaf; a large leaf that no vantage point splits is searched by midpoints."""
    if len(points) > DENSE and reach == 2:
        by_midpoints(np.union1d(points, asked), forest)
        return
    step = max(1, BLOCK // len(points))
    for s in range(0, len(asked), step):
        part = asked[s:s + step]
        i, j = np.nonzero(np.bitwise_count(part[:, None] ^ points) <= reach)
        other = part[i] != points[j]
        forest.add(part[i[other]], points[j[other]])


def midpoints(points: np.ndarray):
    """(value, point): each point with the 65 values at most one bit away."""
    return (points[:, None] ^ BITS).ravel(), np.repeat(points, len(BITS))


def by_midpoints(points: np.ndarray, forest: Forest):
    """Links of all pairs within two bits."""
    # Values are taken a sixteenth at a time, by the parity of four sets of bits, to bound memory.
    sixteenths = np.array([0x1111111111111111 << k for k in range(4)], np.uint64)
    for k in range(16):
        held = []
        for s in range(0, len(points), 1 << 14):
            value, point = midpoints(points[s:s + (1 << 14)])
            kind = sum(((np.bitwise_count(value & m) & 1).astype(np.int64) << i) for i, m in enumerate(sixteenths))
            held.append((value[kind == k], point[kind == k]))
        _same_value(*map(np.concatenate, zip(*held, strict=True)), forest)


def _same_value(value, point, forest):
    """Link the points of equal values, each to the first of them."""
    order = np.lexsort((point, value))
    value, point = value[order], point[order]
    new = np.r_[True, value[1:] != value[:-1]]
    first = point[np.flatnonzero(new)[np.cumsum(new) - 1]]
    other = first != point
    forest.add(point[other], first[other])


def fingerprint_links(distinct: DataFrame, reach: int = REACH, shard_rows: int = SHARD_ROWS,
                      sample: int = SAMPLE) -> DataFrame:
    """(a, b): links whose components are those of all pairs within reach, for a stored table (fp)."""
    spark = distinct.sparkSession
    n = distinct.count()
    parts = 1 << 20
    share = int(parts * min(1 / 8, sample / max(n, 1)))
    picked = distinct.filter(F.pmod(F.xxhash64("fp"), F.lit(parts)) < share).select("fp").toPandas()["fp"]
    tree, filled = fit_tree(picked.to_numpy(np.int64).view(np.uint64), max(1, -(-n // shard_rows)), reach)
    n_leaves = len(filled)
    # A leaf that fills several shards is a dense ball: its fingerprints go to parts by midpoints.
    dense = np.where((filled > DENSE_SHARDS) & (reach == 2), np.ceil(filled * len(BITS) / 16), 0).astype(np.int64)
    base = n_leaves + np.cumsum(dense) - dense
    held = spark.sparkContext.broadcast((tree, dense, base))

    def deal(batches):
        tree, dense, base = held.value
        for batch in batches:
            fp = batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
            for s in range(0, len(fp), DEAL_ROWS):
                part = fp[s:s + DEAL_ROWS]
                index, shard, home = route(tree, part, reach)
                ball = dense[shard] > 0
                yield _dealt(shard[~ball], part[index[~ball]], home[~ball], None)
                if ball.any():
                    leaf = np.repeat(shard[ball], len(BITS))
                    value, point = midpoints(part[index[ball]])
                    at = base[leaf] + (mixed(value) % dense[leaf].astype(np.uint64)).astype(np.int64)
                    yield _dealt(at, point, np.ones(len(at), bool), value)

    def search(table: pa.Table) -> pa.Table:
        fp = table["fp"].to_numpy().view(np.uint64)
        if table["value"].null_count:
            a, b = links(fp[table["home"].to_numpy()], fp, reach)
        else:
            forest = Forest()
            _same_value(table["value"].to_numpy().view(np.uint64), fp, forest)
            a, b = forest.edges()
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    shards = n_leaves + int(dense.sum())
    dealt = distinct.select("fp").mapInArrow(deal, "shard int, fp long, home boolean, value long")
    return dealt.repartition(shards, "shard").groupBy("shard").applyInArrow(search, "a long, b long")


def _dealt(shard, fp, home, value):
    n = len(shard)
    return pa.RecordBatch.from_arrays(
        [pa.array(shard, pa.int32()), pa.array(fp.view(np.int64)), pa.array(home),
         pa.nulls(n, pa.int64()) if value is None else pa.array(value.view(np.int64))],
        names=["shard", "fp", "home", "value"])


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
               reach: int = REACH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, fp, component_id): the smallest id reachable over links of at most `reach` bits."""
    found = stored(fingerprints(docs, id_col, text_col, shingle))
    distinct, linked = _linked(found, "doc_id", reach, shard_rows)
    known = stored(distinct.join(linked, "fp", "left").select(
        "fp", F.coalesce("least", "first").alias("component_id")))
    discard(linked, distinct)
    return found.join(known, "fp").select("doc_id", "fp", "component_id")


def _linked(found: DataFrame, key: str, reach: int, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, DataFrame]:
    """(fp, first), the smallest key of every fingerprint, and (fp, least), the smallest of its component for
    those that have links; stored tables."""
    distinct = stored(found.groupBy("fp").agg(F.min(key).alias("first")))
    edges = stored(fingerprint_links(distinct, reach, shard_rows))
    n_nodes = 2 * edges.count()
    nodes = stored(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct(), n_nodes)
    reached = connected_components(nodes, edges).join(distinct.withColumnRenamed("fp", "node"), "node")
    smallest = reached.groupBy("root").agg(F.min("first").alias("least"))
    linked = stored(reached.join(smallest, "root").select(F.col("node").alias("fp"), "least"), n_nodes)
    discard(edges, nodes)
    return distinct, linked


def hex_fingerprint(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         shingle: int = SHINGLE, reach: int = REACH) -> DataFrame:
    """One row of every component, as it is: the one with the smallest id.

    Rows without an id come last; of rows with one id the text with the smallest MD5 stays, and of rows equal in
    both the one whose columns have the smallest hash.
    """
    # The row travels as one struct, so its column names can't clash with those used here.
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("doc_id"),
                       docs[text_col].alias("text")).withColumn(
        "key", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id",
                        F.md5(F.coalesce("text", F.lit(""))).alias("md5")))
    found = stored(fingerprints(rows, "key", "text", shingle).withColumnRenamed("doc_id", "key"))
    distinct, linked = _linked(found, "key", reach)
    # A component is named by its smallest key, so a fingerprint's component says which row stays.
    kept = stored(distinct.join(linked, "fp", "left").select(F.coalesce("least", "first").alias("key")).distinct())
    discard(linked, distinct)
    name = F.to_json("key").alias("name")
    # The ids grow with the documents, so the join is a shuffle at every size.
    chosen = rows.withColumn("name", name).join(kept.select(name).hint("merge"), "name", "left_semi")
    if not found.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        chosen = chosen.groupBy("name").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return chosen.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
