"""Prefix trie of conversations: double-array tries per prefix shard, merged at their borders.

Turns get verified 64-bit identifiers, a conversation is the list of them. All conversations are range
partitioned by that list (and their id), so a shard holds the prefixes of one range, whatever their
frequency: a first turn shared by a third of all conversations, or that many equal conversations, are cut
into as many shards as they need. Each shard numbers its turns densely and packs a double array: from
state s, turn c leads to t = BASE[s] + c if CHECK[t] = s. Conversations are walked through it, counts are
summed by state, and subtree sums go up along CHECK.

Only nodes on a shard's first or last path can lie in other shards too. Such a node is named by its depth
and the leftmost shard that has it, which follows from how many turns neighbouring shards share at their
border (two numbers per shard; nothing else goes to the driver). Their sums are added up; what must count
once (a child, a text's first copy) is counted in the leftmost shard.

Defined results: rows without conv_id are left out; a null role or text is empty; a null turn comes first;
turns of equal number stand in the order of role and text (bytes), and repeated rows are turns of their own; a
conversation may be turnless and is then a member of the root only; an empty table gives no nodes; other
columns are ignored. A conversation is one value: 12 bytes a turn, whatever the length of the texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import is_small
from ..session import discard, stored
from .identifiers import BITS, clashing, with_identifier

#: Turns and conversations of a shard, about; smaller tables have smaller shards, one for each core.
SHARD_TURNS, LEAST_TURNS = 1 << 18, 1 << 12
#: Slots tried for a state with several children before the array is extended.
TRIES = 256
#: Characters of ids in one row of a listing.
LISTING = 1 << 16
#: Rebuilding: conversations are forked in fives, from at most eight shared turns.
FORK, MOST_SHARED = 5, 9

NODE = ("owner int, depth int, conv_id long, parent_conv_id long, parent_owner int, n_convs long, "
        "n_children long, n_leaves long, saved_tokens long, ends_sha256 string, shard int, seq int, listed string")


def turn_lists(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
               text: str = "text", bits: int = BITS) -> DataFrame:
    """(conv_id, path, sizes): a conversation's turns in order, as identifiers, and their texts' bytes."""
    clean = turns.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"),
        F.coalesce(text, F.lit("")).alias("text"))
    clashes = clashing(clean.select("role", "text"), ["role", "text"], bits)
    known = with_identifier(clean, ["role", "text"], "key", clashes, bits).withColumn(
        "size", F.octet_length("text"))
    order = ["turn"]
    tied = stored(clean.groupBy("conv_id", "turn").agg(F.count("*").alias("n")).filter("n > 1").drop("n"))
    if not tied.isEmpty():
        # Texts are moved for turns of equal number only.
        at = tied.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.lit(True).alias("tied"))
        known = known.join(at, (F.col("conv_id") == F.col("c")) & F.col("turn").eqNullSafe(F.col("t")), "left")
        known = known.select("conv_id", "turn", "key", "size", *[
            F.when(F.col("tied"), F.col(c)).alias(c) for c in ("role", "text")])
        order += ["role", "text"]
    listed = F.sort_array(F.collect_list(F.struct(*order, "key", "size")))
    return known.groupBy("conv_id").agg(listed.alias("turns")).select(
        "conv_id", F.transform("turns", lambda x: x["key"]).alias("path"),
        F.transform("turns", lambda x: x["size"]).alias("sizes"))


def rebuilt(lists: DataFrame, fork: int = FORK, most: int = MOST_SHARED) -> DataFrame:
    """Conversation c becomes the first h turns of conversation c - c % fork and its own after its first h;
    h = crc32 of the decimal c, modulo `most`."""
    heads = lists.filter(F.col("conv_id") % fork == 0).select(F.col("conv_id").alias("_from"), *[
        F.slice(c, 1, most).alias(f"_{c}") for c in ("path", "sizes")])
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    joined = lists.withColumn("_from", F.col("conv_id") - F.col("conv_id") % fork).withColumn("_h", h).join(
        heads, "_from", "left")

    def whole(c):
        own = F.slice(c, F.col("_h") + 1, F.greatest(F.size(c), F.lit(1)))
        head = F.slice(f"_{c}", F.lit(1), F.col("_h"))
        return F.when(F.col(f"_{c}").isNull(), own).otherwise(F.concat(head, own)).alias(c)

    return joined.select("conv_id", whole("path"), whole("sizes"))


class DoubleArray:
    """A trie over symbols 1..n in two arrays. The root is state 0; `base` may be negative."""

    def __init__(self, slots: int = 1024):
        self.base = np.zeros(slots, np.int64)
        self.check = np.full(slots, -1, np.int64)
        self.check[0] = 0
        self.low = 1

    def _grow(self, slots: int) -> None:
        more = max(slots, 2 * len(self.check)) - len(self.check)
        self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
        self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def _free(self, n: int) -> np.ndarray:
        """The first n free slots."""
        while True:
            free = np.flatnonzero(self.check[self.low:self.low + 4 * n + 1024] < 0)[:n] + self.low
            if len(free) < n:
                free = np.flatnonzero(self.check[self.low:] < 0)[:n] + self.low
            if len(free) == n:
                self.low = int(free[0])
                return free
            self._grow(len(self.check) + n)

    def pack(self, states: np.ndarray, symbols: np.ndarray) -> None:
        """Add transitions, sorted by state and symbol; each state's children are given at once."""
        if not len(states):
            return
        first = np.flatnonzero(np.r_[True, states[1:] != states[:-1]])
        count = np.diff(np.r_[first, len(states)])
        for at, n in zip(first[count > 1].tolist(), count[count > 1].tolist(), strict=True):
            self._place(states[at], symbols[at:at + n])
        alone = first[count == 1]
        if len(alone):
            slots = self._free(len(alone))
            self.base[states[alone]] = slots - symbols[alone]
            self.check[slots] = states[alone]

    def _place(self, state: int, symbols: np.ndarray) -> None:
        away = symbols - symbols[0]
        tries = int(max(1, min(TRIES, (1 << 20) // len(symbols))))
        starts = self._free(tries)
        if starts[-1] + away[-1] >= len(self.check):
            self._grow(int(starts[-1] + away[-1]) + 1)
        fits = np.flatnonzero((self.check[starts[:, None] + away] < 0).all(axis=1))
        if len(fits):
            slot = int(starts[fits[0]])
        else:
            slot = int(np.flatnonzero(self.check >= 0)[-1]) + 1
            if slot + away[-1] >= len(self.check):
                self._grow(int(slot + away[-1]) + 1)
        self.base[state] = slot - symbols[0]
        self.check[slot + away] = state

    def step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The next states, -1 where there is no such transition."""
        to = self.base[states] + symbols
        inside = (to > 0) & (to < len(self.check))
        to = np.where(inside, to, 0)
        return np.where(inside & (self.check[to] == states), to, -1)


def build(symbols: np.ndarray, first: np.ndarray) -> DoubleArray:
    """The trie of the lists symbols[first[i]:first[i + 1]], packed level by level."""
    trie = DoubleArray(max(1024, len(symbols) + 1))
    length = np.diff(first)
    state = np.zeros(len(length), np.int64)
    alive, depth = np.flatnonzero(length > 0), 0
    while len(alive):
        c = symbols[first[alive] + depth]
        order = np.lexsort((c, state[alive]))
        s, k = state[alive][order], c[order]
        new = np.r_[True, (s[1:] != s[:-1]) | (k[1:] != k[:-1])]
        trie.pack(s[new], k[new])
        state[alive] = trie.step(state[alive], c)
        depth += 1
        alive = alive[length[alive] > depth]
    return trie


def walk(trie: DoubleArray, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The state behind every symbol, and the state that every list ends in (-1: not in the trie)."""
    length = np.diff(first)
    states = np.zeros(len(symbols), np.int64)
    state = np.zeros(len(length), np.int64)
    alive, depth = np.flatnonzero(length > 0), 0
    while len(alive):
        at = first[alive] + depth
        state[alive] = states[at] = trie.step(state[alive], symbols[at])
        depth += 1
        alive = alive[(length[alive] > depth) & (state[alive] >= 0)]
    return states, state


def _extreme(symbols, first, last: bool) -> int:
    """The index of the first or last list in order; a list comes before those that it begins."""
    length = np.diff(first)
    alive, depth = np.arange(len(length)), 0
    while True:
        ended = alive[length[alive] == depth]
        if len(ended) and (not last or len(ended) == len(alive)):
            return int(ended[0])
        alive = alive[length[alive] > depth]
        c = symbols[first[alive] + depth]
        alive = alive[c == (c.max() if last else c.min())]
        depth += 1


def owners(borders: list[tuple[int, int]], shard: int) -> np.ndarray:
    """For each depth that `shard` shares with the shard before: the leftmost shard that has that node.

    A border is (turns that the shard's first list shares with the last one before, turns that its first
    and last lists share)."""
    upto, j = borders[shard][0], shard - 1
    out = np.zeros(max(upto + 1, 0), np.int64)
    for d in range(upto, 0, -1):
        while min(borders[j]) >= d:
            j -= 1
        out[d] = j
    return out


def shard_nodes(table: pa.Table, borders: list[tuple[int, int]]) -> pa.Table:
    """The nodes of one shard's (shard, conv_id, path, sizes)."""
    shard = table["shard"][0].as_py()
    paths = table["path"].combine_chunks()
    first = paths.offsets.to_numpy().astype(np.int64)
    first, keys = first - first[0], paths.flatten().to_numpy(zero_copy_only=False)
    sizes = table["sizes"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    conv = table["conv_id"].to_numpy()
    symbols = np.unique(keys, return_inverse=True)[1] + 1
    trie = build(symbols, first)
    states, ends = walk(trie, symbols, first)
    node = np.unique(np.r_[0, states])
    index = np.full(len(trie.check), -1, np.int64)
    index[node] = np.arange(len(node))
    parent = index[trie.check[node]]
    length = np.diff(first)
    depth, size = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64)
    at = index[states]
    depth[at] = np.arange(len(states)) - np.repeat(first[:-1], length) + 1
    size[at] = sizes
    smallest = np.full(len(node), np.iinfo(np.int64).max)
    np.minimum.at(smallest, at, np.repeat(conv, length))
    smallest[0] = conv.min()
    n_convs = np.bincount(at, minlength=len(node))
    n_convs[0] = len(conv)

    # Nodes that other shards may have: on the first path as far as it is shared, on the last likewise.
    before, after = borders[shard][0], borders[shard + 1][0] if shard + 1 < len(borders) else -1
    owner = np.full(len(node), -1, np.int64)
    early = np.zeros(len(node), bool)

    def along(i, upto):
        return np.r_[0, at[first[i]:first[i] + upto]] if upto >= 0 else np.zeros(0, np.int64)

    end_of_last = -1
    if after >= 0:
        i = _extreme(symbols, first, True)
        owner[along(i, after)] = shard
        end_of_last = index[ends[i]]
    if before >= 0:
        path = along(_extreme(symbols, first, False), before)
        owner[path], early[path] = owners(borders, shard), True

    children = np.bincount(parent[1:][~early[1:]], minlength=len(node))
    has_child = np.bincount(parent[1:], minlength=len(node)) > 0
    leaf = ~has_child
    if end_of_last >= 0 and after >= depth[end_of_last]:
        leaf[end_of_last] = False  # it goes on in the next shard
    leaves = leaf.astype(np.int64)
    saved = n_convs * size - np.where(early, 0, size)
    by_depth = np.argsort(depth, kind="stable")
    starts = np.searchsorted(depth[by_depth], np.arange(int(depth.max(initial=0)) + 2))
    for d in range(len(starts) - 2, 0, -1):
        level = by_depth[starts[d]:starts[d + 1]]
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])

    order = np.lexsort((conv, ends))
    cuts = np.flatnonzero(np.r_[True, ends[order][1:] != ends[order][:-1], True]) if len(order) else [0]
    text = {}
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        text[int(index[ends[order[a]]])] = ",".join(map(str, conv[order[a:b]].tolist()))
    shas = [None if o >= 0 else hashlib.sha256(text.get(i, "").encode()).hexdigest()
            for i, o in enumerate(owner.tolist())]
    root = np.arange(len(node)) == 0
    above = np.where(root, -1, owner[parent])
    nulls = {"owner": owner < 0, "parent_conv_id": root | (above >= 0), "parent_owner": above < 0}
    columns = {"owner": owner, "depth": depth, "conv_id": smallest, "parent_conv_id": smallest[parent],
               "parent_owner": above, "n_convs": n_convs, "n_children": children, "n_leaves": leaves,
               "saved_tokens": saved}
    types = {"owner": pa.int32(), "depth": pa.int32(), "parent_owner": pa.int32()}
    n = len(node)
    out = pa.table({c: pa.array(v, types.get(c, pa.int64()), mask=nulls.get(c)) for c, v in columns.items()} | {
        "ends_sha256": pa.array(shas, pa.string()), "shard": pa.array(np.full(n, shard), pa.int32()),
        "seq": pa.array(np.zeros(n), pa.int32()), "listed": pa.nulls(n, pa.string())})
    parts = [(owner[i], depth[i], shard, k, t[s:s + LISTING]) for i, t in text.items() if owner[i] >= 0
             for k, s in enumerate(range(0, len(t), LISTING))]
    if not parts:
        return out
    by = dict(zip(("owner", "depth", "shard", "seq", "listed"), zip(*parts, strict=True), strict=True))
    return pa.concat_tables([out, pa.table({
        c.name: pa.array(by[c.name], c.type) if c.name in by else pa.nulls(len(parts), c.type) for c in out.schema})])


def _digest(batches):
    """SHA-256 per (owner, depth) of listings sorted by (owner, depth, shard, seq); one state at a time."""
    at, shard, running = None, None, None

    def row():
        return pa.RecordBatch.from_pylist(
            [{"owner": at[0], "depth": at[1], "ends": running.hexdigest()}],
            pa.schema([("owner", pa.int32()), ("depth", pa.int32()), ("ends", pa.string())]))

    for batch in batches:
        for o, d, s, t in zip(*[batch[c].to_pylist() for c in ("owner", "depth", "shard", "listed")], strict=True):
            if (o, d) != at:
                if at:
                    yield row()
                at, shard, running = (o, d), None, hashlib.sha256()
            if shard is not None and s != shard:
                running.update(b",")
            shard = s
            running.update(t.encode())
    if at:
        yield row()


def _common(a: str, b: str):
    """How many leading elements two arrays share; -1 if the first is null."""
    differ = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(F.col(a).isNull(), -1).when(differ == 0, F.size(b)).otherwise(differ - 1).cast("int")


def sharded(lists: DataFrame, shard_turns: int = SHARD_TURNS) -> tuple[DataFrame, list[tuple[int, int]]]:
    """The lists with the number of their shard, and the shards' borders (see `owners`)."""
    work = lists.agg(F.sum(F.size("path") + 1).alias("n")).first()["n"] or 0
    cores = lists.sparkSession.sparkContext.defaultParallelism
    n = max(1, -(-work // shard_turns), min(cores, -(-work // LEAST_TURNS)))
    dealt = lists if n == 1 else lists.repartitionByRange(n, "path", "conv_id")
    number = F.lit(0) if n == 1 else F.spark_partition_id()
    dealt = stored(dealt.withColumn("part", number))
    ends = dealt.groupBy("part").agg(F.min("path").alias("low"), F.max("path").alias("high"))
    # One row per shard.
    borders = ends.withColumn("before", F.lag("high").over(Window.orderBy("part"))).select(
        "part", _common("before", "low").alias("shared"), _common("low", "high").alias("inside")).orderBy(
        "part").collect()
    parts = {r.part: i for i, r in enumerate(borders)}
    if list(parts) != list(range(len(parts))):
        names = lists.sparkSession.createDataFrame(list(parts.items()), "part int, shard int")
        dealt = dealt.join(F.broadcast(names), "part")
    else:
        dealt = dealt.withColumn("shard", F.col("part"))
    return dealt.drop("part"), [(r.shared, r.inside) for r in borders]


def trie_nodes(lists: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The nodes of the trie of (conv_id, path, sizes)."""
    dealt, borders = sharded(lists, shard_turns)
    if not borders:
        return lists.sparkSession.createDataFrame([], RESULT)
    found = stored(dealt.groupBy("shard").applyInArrow(lambda table: shard_nodes(table, borders), NODE))
    inner, edge = found.filter("owner is null"), found.filter("owner is not null")
    listed = edge.filter("listed is not null").select("owner", "depth", "shard", "seq", "listed")
    digests = listed.repartition("owner", "depth").sortWithinPartitions(
        "owner", "depth", "shard", "seq").mapInArrow(_digest, "owner int, depth int, ends string")
    sums = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    merged = stored(edge.groupBy("owner", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.min("parent_owner").alias("parent_owner"),
        *[F.sum(c).alias(c) for c in sums]).join(digests.hint("merge"), ["owner", "depth"], "left")
        .withColumn("ends_sha256", F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest()))))
    above = merged.select(F.col("owner").alias("parent_owner"), (F.col("depth") + 1).alias("depth"),
                          F.col("conv_id").alias("parent"))
    above = F.broadcast(above) if is_small(above) else above.hint("merge")
    columns = ["depth", "conv_id", "parent_owner", *sums, "ends_sha256"]
    # Children of border nodes take the merged node's smallest member.
    open_ends = inner.filter("parent_owner is not null").select(*columns).unionByName(merged.select(*columns))
    closed = inner.filter("parent_owner is null")
    joined = open_ends.join(above, ["parent_owner", "depth"], "left").withColumn(
        "parent_conv_id", F.col("parent"))
    out = [F.col("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent_conv_id"),
           *[F.col(c) for c in sums], F.col("ends_sha256")]
    return closed.select(*out).unionByName(joined.select(*out)).select(*RESULT_COLUMNS)


RESULT_COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                  "ends_sha256"]
RESULT = ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in RESULT_COLUMNS)


def conversation_trie(turns: DataFrame, shard_turns: int = SHARD_TURNS, fork: int = FORK,
                      most: int = MOST_SHARED, bits: int = BITS) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations of (conv_id, turn, role, text)."""
    lists = stored(turn_lists(turns, bits=bits))
    whole = stored(rebuilt(lists, fork, most))
    out = trie_nodes(whole, shard_turns)
    discard(lists)
    return out
