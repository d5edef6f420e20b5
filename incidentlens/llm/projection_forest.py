"""Approximate nearest neighbours by cosine: a forest of random-projection trees.

A tree splits by the plane halfway between two random points' directions, at the median. The trees are
fitted on a sample of at most about `SAMPLE` vectors; every vector is indexed. A query walks all trees
through one priority queue ordered by how far it lies beyond a plane, and takes the best `PROBE_SHARE`
of all leaves. Leaves are cells, dealt to parts of about `PART_ROWS` index rows; index rows and queries
meet by part in a cogroup, candidates are ranked there cell by cell by their exact cosine in double
precision, and a part hands on the k best of each query only.

Equal vectors are one index row with their k + 1 smallest ids, which is all that k neighbours with ties
to the smaller id can ever need; a vector that a third of all rows share is one row. Leaves larger than
`BLOCK_ROWS` (where the sample is too small for the table) are searched in blocks, all of them.

The share of leaves is what decides recall, at any size: see README for measured recall.

Defined results: vectors that are null, empty, zero, or hold a null or a number that is not finite take
no part, and neither do those of another length than most; null ids take no part; a row that repeats an
id counts once if its vector is equal; a query id with several vectors asks with the smallest; with fewer than k candidates all are returned; an empty table
gives no rows.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

TREES = 16
LEAF_ROWS = 400
SAMPLE = 20_000
PROBE_SHARE = 0.1
MIN_PROBES = 64
BLOCK_ROWS = 16_384
PART_ROWS = 32_768
SALTS = 64
SEED = 11


@dataclass
class Tree:
    """Planes (normal, offset) and children; a child below zero is leaf -1 - child."""

    normal: np.ndarray
    offset: np.ndarray
    children: np.ndarray
    n_leaves: int

    def leaves(self, unit: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        if not len(self.normal):
            return np.zeros(len(unit), np.int64)
        at = np.zeros(len(unit), np.int64)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            beyond = np.einsum("ij,ij->i", unit[inner], self.normal[node]) > self.offset[node]
            at[inner] = self.children[node, beyond.astype(np.int64)]
        return -1 - at


def fit_tree(unit: np.ndarray, leaf: int, rng) -> Tree:
    normals, offsets, children, n_leaves = [], [], [], 0

    def build(rows):
        nonlocal n_leaves
        plane = _plane(unit[rows], rng) if len(rows) > leaf else None
        if plane is None:
            n_leaves += 1
            return -n_leaves
        normal, offset, beyond = plane
        at = len(normals)
        normals.append(normal)
        offsets.append(offset)
        children.append(None)
        children[at] = (build(rows[~beyond]), build(rows[beyond]))
        return at

    build(np.arange(len(unit)))
    return Tree(np.array(normals).reshape(len(normals), unit.shape[1]), np.array(offsets),
                np.array(children, np.int64).reshape(-1, 2), n_leaves)


def _plane(points, rng, tries: int = 4):
    for _ in range(tries):
        a, b = points[rng.choice(len(points), 2, replace=False)]
        normal = a - b
        size = np.linalg.norm(normal)
        if size < 1e-9:
            continue
        normal = normal / size
        along = points @ normal
        offset = float(np.median(along))
        beyond = along > offset
        if 0.1 <= beyond.mean() <= 0.9:
            return normal, offset, beyond
    return None


def probes(forest: list[Tree], unit: np.ndarray, count: int):
    """For each row the (tree, leaf) cells to search: one priority queue over all trees, keyed by the
    farthest that the row lies on the wrong side of a plane on the way."""
    sides = [tree.normal @ unit.T - tree.offset[:, None] for tree in forest]
    for i in range(len(unit)):
        queue = [(0.0, t, 0 if len(tree.normal) else -1) for t, tree in enumerate(forest)]
        heapq.heapify(queue)
        found = []
        while queue and len(found) < count:
            far, t, at = heapq.heappop(queue)
            side, children = sides[t], forest[t].children
            while at >= 0:
                z = side[at, i]
                near = int(z > 0)
                heapq.heappush(queue, (max(far, abs(z)), t, int(children[at, 1 - near])))
                at = int(children[at, near])
            found.append((t, -1 - at))
        yield found


def clean_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter(
        "id is not null and v is not null and size(v) > 0")
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = rows.filter(F.exists("v", lambda x: x != 0))
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (usual.n if usual else 0))


def distinct_vectors(rows: DataFrame, most: int) -> DataFrame:
    """(v, ids): each different vector with its smallest ids. Copies are first cut down within
    `SALTS` parts, so a much copied vector is no single task's work."""
    keyed = rows.withColumn("key", F.xxhash64("v")).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    part = Window.partitionBy("key", "v", "salt").orderBy("id")
    whole = Window.partitionBy("key", "v").orderBy("id")
    first = keyed.dropDuplicates(["key", "v", "id"]).withColumn("r", F.row_number().over(part)).filter(F.col("r") <= most)
    least = first.withColumn("r", F.row_number().over(whole)).filter(F.col("r") <= most)
    return least.groupBy("key", "v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select("v", "ids")


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    return v / np.linalg.norm(v / np.abs(v).max(1, keepdims=True), axis=1, keepdims=True) / np.abs(v).max(
        1, keepdims=True)


CELL = "part int, cell long, ids binary, vectors binary"


def _cells(cell, ids, vectors, n_parts):
    """One row per cell, its ids and vectors as bytes."""
    order = np.argsort(cell, kind="stable")
    cuts = np.flatnonzero(np.diff(cell[order], prepend=-1))
    parts = np.split(order, cuts[1:])
    cell = cell[order][cuts]
    return pa.record_batch([
        pa.array(cell % n_parts, pa.int32()), pa.array(cell),
        pa.array([ids[p].tobytes() for p in parts], pa.binary()),
        pa.array([vectors[p].tobytes() for p in parts], pa.binary())], names=["part", "cell", "ids", "vectors"])


def nearest(table: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id",
            vector_col: str = "embedding", trees: int = TREES, leaf_rows: int = LEAF_ROWS,
            probe_share: float = PROBE_SHARE, sample: int = SAMPLE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): up to k nearest other rows of `table` for each row of `queries`."""
    spark = table.sparkSession
    most = k + 1
    index = stored(distinct_vectors(clean_vectors(table, id_col, vector_col), most))
    asked = clean_vectors(queries, id_col, vector_col).groupBy("id").agg(F.min("v").alias("v"))
    n = index.count()
    parts = 1 << 20
    share = max(1, int(parts * min(1.0, sample / max(n, 1))))
    picked = index.filter(F.pmod(F.xxhash64("v", F.lit(SEED)), F.lit(parts)) < share).select("v").toArrow()["v"]
    unit = _unit(_matrix(picked)) if len(picked) else np.zeros((0, 0))
    order = np.lexsort(unit.T) if unit.size else np.zeros(0, np.int64)
    leaf = max(8, leaf_rows * len(unit) // max(n, 1))
    rng = np.random.default_rng(SEED)
    forest = [fit_tree(unit[order], leaf, rng) for _ in range(trees)]
    n_leaves = sum(t.n_leaves for t in forest)
    blocks = -(-max(n, 1) * trees // (max(n_leaves, 1) * block_rows))
    count = max(MIN_PROBES, int(np.ceil(probe_share * n_leaves)))
    n_parts = max(8, n * trees // PART_ROWS)
    held = spark.sparkContext.broadcast(forest)
    first_cell = np.concatenate([[0], np.cumsum([t.n_leaves for t in forest])])
    kind = np.float32 if index.schema["v"].dataType.elementType.simpleString() == "float" else np.float64

    def deal(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch["v"]).astype(kind)
            lengths = batch["ids"].value_lengths().to_numpy()
            flat = batch["ids"].flatten().to_numpy()
            # Rows with fewer ids repeat their first one; the same pair is taken once in the end.
            ids = np.repeat(flat[np.cumsum(lengths) - lengths][:, None], most, axis=1)
            ids[np.arange(most) < lengths[:, None]] = flat
            block = ids[:, 0] % blocks
            u = _unit(v)
            for t, tree in enumerate(held.value):
                yield _cells((first_cell[t] + tree.leaves(u)) * blocks + block, ids, v, n_parts)

    def ask(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v, ids = _matrix(batch["v"]).astype(kind), batch["id"].to_numpy()
            cells, rows = [], []
            for i, found in enumerate(probes(held.value, _unit(v), count)):
                for t, at in found:
                    first = (first_cell[t] + at) * blocks
                    cells += range(first, first + blocks)
                    rows += [i] * blocks
            rows = np.array(rows)
            yield _cells(np.array(cells, np.int64), ids[rows], v[rows], n_parts)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = {"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()),
                 "score": pa.array([], pa.float64())}
        asked_cells = {c: right.filter(pc.equal(right["cell"], c)) for c in set(right["cell"].to_pylist())}
        found = []
        for c in set(left["cell"].to_pylist()) & set(asked_cells):
            ids, v = _joined(left.filter(pc.equal(left["cell"], c)), most, kind)
            query, q = _joined(asked_cells[c], 1, kind)
            found.append(_rank(ids, v.astype(np.float64), query[:, 0], q.astype(np.float64), k))
        if not found:
            return pa.table(empty)
        return pa.table(dict(zip(empty, _best(*map(np.concatenate, zip(*found, strict=True)), k), strict=True)))

    cells = index.mapInArrow(deal, CELL).repartition(n_parts, "part")
    questions = asked.mapInArrow(ask, CELL).repartition(n_parts, "part")
    found = cells.groupBy("part").cogroup(questions.groupBy("part")).applyInArrow(
        meet, "query_id long, vec_id long, score double")
    single = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (single.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _joined(table: pa.Table, width: int, kind):
    ids = np.frombuffer(b"".join(table["ids"].to_pylist()), np.int64).reshape(-1, width)
    v = np.frombuffer(b"".join(table["vectors"].to_pylist()), kind)
    return ids, v.reshape(len(ids), -1)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; the same pair gives the same bits wherever it is computed."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def _rank(ids, v, query, q, k, step: int = 256):
    """The k best of one cell for each query, with exact scores; ties at the edge are looked at too."""
    out = [[], [], []]
    unit = _unit(v)
    for s in range(0, len(q), step):
        close = _unit(q[s:s + step]) @ unit.T
        need = min(k + 1, close.shape[1])
        edge = np.partition(close, -need, axis=1)[:, -need] - 1e-9
        i, j = np.nonzero(close >= edge[:, None])
        score = cosine(q[s + i], v[j])
        each = ids[j] != query[s + i][:, None]
        pair, place = np.nonzero(each)
        for column, part in zip(out, _best(query[s + i[pair]], ids[j[pair], place], score[pair], k), strict=True):
            column.append(part)
    return [np.concatenate(x) for x in out]


def _best(query, vec, score, k):
    """The k best different vectors of each query."""
    order = np.lexsort((vec, -score, query))
    query, vec, score = query[order], vec[order], score[order]
    new = np.ones(len(query), bool)
    new[1:] = (query[1:] != query[:-1]) | (vec[1:] != vec[:-1])  # the same pair has the same score
    query, vec, score = query[new], vec[new], score[new]
    top = np.arange(len(query)) - np.searchsorted(query, query, "left") < k
    return query[top], vec[top], score[top]
