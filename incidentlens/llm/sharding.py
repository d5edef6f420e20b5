"""Sharding by best-fit decreasing: indivisible groups of documents into shards of fixed capacity.

Groups are documents of equal text (or any given group column). Groups of equal size are the same
item to the packing, so it runs on the histogram of group sizes. With T bytes in all there are at
most sqrt(2 T) different sizes, whatever the number of groups; that table goes to the driver, and the
shards' free room is held in a balanced tree. A size's groups take its shards by rank.

Defined results: a null text counts as empty; repeated rows are members of one group; an empty table
gives no rows; a group larger than the capacity gets a shard of its own; groups of equal size take any of
their places; other columns are ignored. Texts are read for their length and hash only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .ranks import ranked
from .textarrays import mixed

N_SHARDS = 40
ROW_BYTES = 16


class RoomTree:
    """Balanced search tree (a treap) of (room, shard): the tightest that is enough in O(log n)."""

    def __init__(self):
        self.root = None

    def add(self, room: int, shard: int) -> None:
        low, high = _split(self.root, (room, shard))
        node = [(room, shard), int(mixed(np.array([shard + 1], np.uint64))[0]), None, None]
        self.root = _merge(_merge(low, node), high)

    def take(self, size: int):
        """Remove and return the smallest (room, shard) with room >= size, or None."""
        low, high = _split(self.root, (size, -1))
        if high is None:
            self.root = low
            return None
        node, parents = high, []
        while node[2] is not None:
            parents.append(node)
            node = node[2]
        if parents:
            parents[-1][2] = node[3]
        else:
            high = node[3]
        self.root = _merge(low, high)
        return node[0]


def _split(node, key):
    if node is None:
        return None, None
    if node[0] < key:
        low, high = _split(node[3], key)
        node[3] = low
        return node, high
    low, high = _split(node[2], key)
    node[2] = high
    return low, node


def _merge(a, b):
    if a is None or b is None:
        return a if b is None else b
    if a[1] > b[1]:
        a[3] = _merge(a[3], b)
        return a
    b[2] = _merge(a, b[2])
    return b


def best_fit_decreasing(sizes, counts, capacity: int, most: int | None = None):
    """[(size, groups, shard)] for groups by falling size; None if it takes more than `most` shards.

    The tightest shard stays the tightest while it takes groups of one size, so a run of equal
    groups is one step.
    """
    tree, used, out = RoomTree(), 0, []
    for i in np.argsort(-np.asarray(sizes), kind="stable"):
        size, left = int(sizes[i]), int(counts[i])
        while left:
            found = tree.take(size)
            if found is None:
                found = (max(capacity, size), used)
                used += 1
                if most is not None and used > most:
                    return None
            room, shard = found
            n = min(left, room // size)
            out.append((size, n, shard))
            left -= n
            tree.add(room - n * size, shard)
    return out


def even_plan(sizes, counts, n_shards: int):
    """The plan with the least capacity tried that needs no more than `n_shards`.

    A group above the mean keeps a shard of its own; the capacity is the mean of the rest, raised in
    doubling steps from a 65,536th of it until all groups fit.
    """
    sizes, counts = np.asarray(sizes, np.int64), np.asarray(counts, np.int64)
    total, rest, alone = int((sizes * counts).sum()), n_shards, 0
    for i in np.argsort(-sizes, kind="stable"):
        for _ in range(int(min(counts[i], n_shards))):
            if rest > 1 and sizes[i] * rest > total - alone:
                alone += int(sizes[i])
                rest -= 1
            else:
                break
        else:
            continue
        break
    mean = -(-(total - alone) // rest)
    slack = 0
    while True:
        found = best_fit_decreasing(sizes, counts, mean + slack, n_shards)
        if found is not None:
            return found
        slack = max(2 * slack, mean >> 16, 1)


def place(groups: DataFrame, n_shards: int | None = N_SHARDS, capacity: int | None = None) -> DataFrame:
    """(group, size, shard) for a stored table (group, size).

    With `capacity`, as few shards of that size as best-fit decreasing needs; else `n_shards` shards
    of nearly equal size.
    """
    spark = groups.sparkSession
    histogram = groups.groupBy("size").count().toPandas()
    sizes, counts = histogram["size"].to_numpy(), histogram["count"].to_numpy()
    found = (best_fit_decreasing(sizes, counts, capacity) if capacity
             else even_plan(sizes, counts, n_shards) if len(sizes) else [])
    rows, taken = [], {}
    for size, n, shard in found:
        rows.append((size, taken.get(size, 0), shard))
        taken[size] = taken.get(size, 0) + n
    rows.sort()
    where = spark.sparkContext.broadcast(np.array(rows, np.int64).reshape(-1, 3))
    kind = groups.schema["group"].dataType.simpleString()

    def run(batches):
        table = where.value
        # (size, rank) as one sorted key: number the sizes, then sizes and ranks make a pair.
        distinct, first = np.unique(table[:, 0], return_index=True)
        stride = int(table[:, 1].max(initial=0)) + 1
        keys = np.repeat(np.arange(len(distinct)), np.diff(np.append(first, len(table)))) * stride + table[:, 1]
        for batch in batches:
            rank = np.minimum(batch["_rank"].to_numpy(), stride - 1)
            i = np.searchsorted(keys, np.searchsorted(distinct, batch["size"].to_numpy()) * stride + rank, "right") - 1
            yield pa.record_batch([batch["group"], batch["size"], pa.array(table[i, 2], pa.int32())],
                                  names=["group", "size", "shard"])

    return ranked(groups, ["size"], ["group"], "_rank").mapInArrow(
        run, f"group {kind}, size long, shard int")


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    n_shards: int = N_SHARDS, row_bytes: int = ROW_BYTES) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): equal texts share a shard, shards are near equal in
    bytes, and slots number each shard's rows from 0."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = stored(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + row_bytes).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("group")))
    groups = stored(rows.groupBy("group").agg(F.sum("size").alias("size")))
    shards = place(groups, n_shards).select("group", "shard")
    dealt = stored(rows.join(shards, "group").drop("group"))
    return ranked(dealt, ["shard"], ["doc_id", "text_crc32", "size"], "slot")
