"""LM scoring: a small causal self-attention model in numpy, and a smoothed unigram base.

The model reads subword ids. The probability of the next id is that of its class times that of the id
within its class, given the id before it (absolute discounting, backing off to the class alone). The
classes start from their counts after the id before (discounted as well); one layer of causal
self-attention over the window moves these log weights, so it learns what the pair does not tell: the
language, the kind of text, what stands two ids back. Classes are k-means clusters of ids by their
neighbours. Everything is learned from all training documents: ids, pairs of ids and neighbours are
counted over them, and each is read once by the gradient passes, a third of them per round. These run on
the executors: each part of the stored ids trains from the same start, and the parameters are averaged by
Spark, round by round.
Scoring cuts each document into overlapping windows of `WINDOW` inputs; every id, the end included, is
scored once, in the first window that gives it at least `WINDOW - STRIDE` inputs of context (or all
there are), many windows at a time with one causal mask.

The base counts every word of the corpus. Words travel as 64-bit hashes: a task sends each of its
words once with its count in training text, the word's shard adds the counts up and answers the task's
step with the totals, so a very frequent word is one entry per step. Which document holds which word
stays beside it in a stored table and meets the answers by step. Pairs of ids go the same way, by their
exact numbers and to shards of their own, whose totals are the table of all pairs. Of it only what has a
fixed size reaches the driver: counts per id, per id and neighbour, per id and class of the next.

Defined results: a null text counts as empty and has one token, the end; rows without an id are scored
and never learned from; repeated rows are scored each and counted each; without training documents N
and V are 0 and the model is uniform; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .packing import Encoder, vocabulary
from .textarrays import LOWER, NOT_SPACE, chunks, mixed, ranges, utf8, word_hashes, words

N_IDS = 50_257
BOUNDARY = 50_256
WINDOW = 16
STRIDE = 12
WIDTH = 8
CLASSES = 32
DISCOUNT = 0.75
OWN_ROWS = 2_048
NEIGHBOURS = 64
ROUNDS = 3
BATCH = 512
RATE = 0.15
SCALE = 512.0
#: Bound of every parameter, so that no exponential overflows.
BOUND = 3.0
SHARD_BYTES = 16 << 20
STEP_BYTES = 6 << 20
PIECE_BYTES = 1 << 20
SCORE_BLOCK = 128
SEED = 5
END_HASH = np.uint64(0)


class Lookup:
    """Numbers for keys, by binary search."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[order].astype(np.int64), values[order]

    def __call__(self, keys: np.ndarray):
        """(values, whether the key is there)."""
        if not len(self.keys):
            return np.zeros(len(keys)), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.values[at], self.keys[at] == keys


@dataclass
class Model:
    row: np.ndarray         # input row of each id
    klass: np.ndarray       # class of each id
    inside: np.ndarray      # log probability of each id within its class
    prior: np.ndarray       # per id before: log probability of each class, by counts
    pairs: Lookup           # of (id before, id): log probability of the id within its class
    left: np.ndarray        # per id before and class: log of what is left for the class alone
    table: np.ndarray       # per input row: query, key, value
    near: np.ndarray        # what a distance adds to the attention score
    out: np.ndarray
    totals: np.ndarray | None = None    # per id before and class: how often the two follow each other

    def __getstate__(self) -> dict:
        """What tasks get: of the tables by class the cells in use."""
        if self.totals is None:
            return self.__dict__
        cells = np.flatnonzero(self.totals)
        small = {"row": self.row.astype(np.uint16), "klass": self.klass.astype(np.uint8), "cells": cells.astype(np.int32),
                 "totals": self.totals.ravel()[cells], "left": self.left.ravel()[cells].astype(np.float32)}
        return {k: v for k, v in self.__dict__.items() if k != "prior"} | small

    def __setstate__(self, state: dict) -> None:
        cells = state.pop("cells", None)
        if cells is not None:
            state |= {n: _by_class(cells, state[n]) for n in ("totals", "left")}
            state |= {n: state[n].astype(np.int64) for n in ("row", "klass")} | {"prior": _prior(state["totals"])}
        self.__dict__.update(state)

    def parameters(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.table, self.near, self.out)])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for name in ("table", "near", "out"):
            shape = getattr(self, name).shape
            size = int(np.prod(shape))
            setattr(self, name, flat[at:at + size].reshape(shape).astype(np.float32))
            at += size


def _mask(near: np.ndarray) -> np.ndarray:
    """near[i - j] where j is not later than i, else minus infinity."""
    distance = np.arange(len(near))[:, None] - np.arange(len(near))
    return np.where(distance >= 0, near[np.maximum(distance, 0)], -1e9).astype(np.float32)


def windows_of(lengths: np.ndarray, stride: int = STRIDE):
    """Windows over documents of so many targets each, laid out one after the other with one boundary
    id before each: (first input position, inputs, targets already scored before this window)."""
    n = 1 + np.maximum(0, -(-(lengths - WINDOW) // stride))
    begin = np.cumsum(lengths + 1) - (lengths + 1)
    nth = ranges(np.zeros(len(n), np.int64), n)
    first = np.repeat(begin, n) + stride * nth
    inputs = np.minimum(WINDOW, np.repeat(begin + lengths, n) - first)
    return first, inputs, np.where(nth > 0, WINDOW - stride, 0)


def _attend(model: Model, mask, x):
    """Hidden states of windows of input rows, and what the backward pass needs."""
    parts = model.table.take(x.ravel(), 0).reshape(*x.shape, 3 * WIDTH)
    q, k, v = (parts[..., i * WIDTH:(i + 1) * WIDTH] for i in range(3))
    a = np.matmul(q, np.ascontiguousarray(k.transpose(0, 2, 1)))
    a += mask
    np.exp(a, out=a)
    a /= (a @ np.ones(x.shape[1], np.float32))[..., None]
    return np.matmul(a, v), a, q, k, v


def _classes(model: Model, h, before):
    """Log weights of the classes after each id, given hidden states: the counts' own, moved by attention."""
    logits = h @ model.out
    logits += model.prior.take(before, 0)
    return logits


def within_class(model: Model, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Log probability of each id within its class, given the id before it."""
    before = before.astype(np.int64)
    value, there = model.pairs(before * N_IDS + ids)
    return np.where(there, value, model.left[before, model.klass[ids]] + model.inside[ids])


def score_ids(model: Model, ids: np.ndarray, lengths: np.ndarray, given: np.ndarray | None = None) -> np.ndarray:
    """Natural log probability of each document. `ids` holds a boundary id before each document's
    targets, of which the last is its end; lengths counts targets. `given` has, for each place in ids,
    the log probability within its class; without it the model's own pairs are asked."""
    first, inputs, done = windows_of(lengths)
    doc = np.repeat(np.arange(len(lengths)), 1 + np.maximum(0, -(-(lengths - WINDOW) // STRIDE)))
    rows, mask = model.row[ids], _mask(model.near)
    offset, ones = np.arange(WINDOW), np.ones(CLASSES, np.float32)
    out = np.zeros(len(lengths))
    for s in range(0, len(first), SCORE_BLOCK):
        f, n, d = (z[s:s + SCORE_BLOCK] for z in (first, inputs, done))
        at = f[:, None] + np.minimum(offset, n[:, None] - 1)
        h = _attend(model, mask, rows.take(at))[0]
        scored = (offset >= d[:, None]) & (offset < n[:, None])
        place = at[scored]
        target = ids[place + 1]
        logits = _classes(model, h[scored], ids[place])
        value = logits[np.arange(len(place)), model.klass[target]].astype(np.float64)
        np.exp(logits, out=logits)
        value -= np.log((logits @ ones).astype(np.float64))
        value += within_class(model, ids[place], target) if given is None else given[place + 1]
        out += np.bincount(np.repeat(doc[s:s + SCORE_BLOCK], scored.sum(1)), value, len(lengths))
    return out


def gradients(model: Model, rows, before, after, counted):
    """(gradient by place in the table, of distances, of the output) of the summed loss of windows of input
    rows, given the ids before and the classes after, where `counted`."""
    h, a, q, k, v = _attend(model, _mask(model.near), rows)
    hidden = h.reshape(-1, WIDTH)
    p = _classes(model, hidden, before.ravel())
    np.exp(p, out=p)
    weight = counted.ravel().astype(np.float32)
    p *= (weight / (p @ np.ones(CLASSES, np.float32)))[:, None]
    p.ravel()[np.arange(0, p.size, CLASSES) + after.ravel()] -= weight
    dh = (p @ model.out.T).reshape(h.shape)
    ds = np.matmul(dh, np.ascontiguousarray(v.transpose(0, 2, 1)))
    ds -= ((dh * h) @ np.ones(WIDTH, np.float32))[..., None]
    ds *= a
    parts = np.empty((*rows.shape, 3 * WIDTH), np.float32)
    parts[..., :WIDTH] = np.matmul(ds, k)
    parts[..., WIDTH:2 * WIDTH] = np.matmul(ds.transpose(0, 2, 1), q)
    parts[..., 2 * WIDTH:] = np.matmul(a.transpose(0, 2, 1), dh)
    parts = parts.reshape(-1, 3 * WIDTH)
    offset = np.arange(WINDOW)
    distance = offset[:, None] - offset
    causal = distance >= 0
    return parts, np.bincount(distance[causal], ds.sum(0)[causal], WINDOW), hidden.T @ p


def train_pass(model: Model, ids: np.ndarray, lengths: np.ndarray, seed: int, memory: dict | None = None) -> dict:
    """One pass of Adagrad over windows side by side: every id is a target once. Changes the model's arrays
    for new ones; gives the sums of squares for the next pass."""
    rng = np.random.default_rng(seed)
    first, inputs, _ = windows_of(lengths, WINDOW)
    order = rng.permutation(len(first))
    if memory is None:
        memory = {n: np.full_like(getattr(model, n), 1e-3) for n in ("table", "near", "out")}
        model.table = model.table.copy()
    offset = np.arange(WINDOW)
    rows, klass = model.row[ids].astype(np.uint16), model.klass[ids]
    for s in range(0, len(order), BATCH):
        take = order[s:s + BATCH]
        n = inputs[take][:, None]
        at = first[take][:, None] + np.minimum(offset, n - 1)
        counted = offset < n
        x = rows.take(at)
        parts, near, out = gradients(model, x, ids.take(at), klass.take(at + 1), counted)
        share = np.float32(SCALE / counted.sum())
        by_row = np.argsort(x.ravel(), kind="stable")
        sorted_rows = x.ravel()[by_row]
        begin = np.append(0, np.flatnonzero(sorted_rows[1:] != sorted_rows[:-1]) + 1)
        used = sorted_rows[begin]
        gradient = np.add.reduceat(parts.take(by_row, 0), begin, axis=0) * share
        seen = memory["table"][used] + gradient ** 2
        memory["table"][used] = seen
        model.table[used] = np.clip(model.table[used] - RATE * gradient / np.sqrt(seen), -BOUND, BOUND)
        for name, g in (("near", near), ("out", out)):
            g = g.astype(np.float32) * share
            memory[name] += g ** 2
            setattr(model, name, np.clip(getattr(model, name) - RATE * g / np.sqrt(memory[name]), -BOUND, BOUND))
    return memory


def encoded(texts, encode) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts laid out as boundary, ids, end; and how many targets each text has."""
    # The end of one text and the boundary before the next are two ids.
    parts = [np.array([BOUNDARY, *encode(t or ""), BOUNDARY], np.int32) for t in texts]
    return np.concatenate(parts), np.array([len(p) - 1 for p in parts], np.int64)


def fit(steps: DataFrame, pairs: DataFrame):
    """The model learned from all training documents that `steps` (see `_steps`) holds, and what tasks hold
    of it: the same with the parameters of the start. `pairs` has the counts of all their pairs of ids."""
    spark = steps.sparkSession
    model = _start(pairs)
    cells, total, kinds = _counted(pairs, lambda before, ids, n: (before * CLASSES + model.klass[ids], n))
    model.totals, model.left = _by_class(cells, total), _by_class(cells, np.log(DISCOUNT * kinds / total))
    model.prior = _prior(model.totals)
    learned = steps.filter("shard = -1").select("ids", "tokens")
    held = spark.sparkContext.broadcast(model)
    for turn in range(ROUNDS if len(cells) else 0):
        model.load(_averaged(learned, held, model.parameters(), turn))
    return model, held


def _by_class(cells, values) -> np.ndarray:
    """The values as a table of ids before and classes; zero where the two never follow each other."""
    out = np.zeros(N_IDS * CLASSES)
    out[cells] = values
    return out.reshape(N_IDS, CLASSES)


def _prior(count: np.ndarray) -> np.ndarray:
    """Per id before, the log probability of each class by absolute discounting, from the counts of
    (id before, class); an id that nothing followed has the classes' own shares."""
    own = count.sum(0) + 1
    own /= own.sum()
    total, kinds = count.sum(1, keepdims=True), (count > 0).sum(1, keepdims=True)
    share = (np.maximum(count - DISCOUNT, 0) + DISCOUNT * kinds * own) / np.maximum(total, 1)
    return np.log(np.where(total > 0, share, own)).astype(np.float32)


def pair_keys(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the targets, id before * N_IDS + id of each)."""
    target = np.ones(len(ids), bool)
    target[np.cumsum(lengths + 1) - (lengths + 1)] = False
    at = np.flatnonzero(target)
    return at, ids[at - 1].astype(np.uint64) * np.uint64(N_IDS) + ids[at].astype(np.uint64)


def _counted(pairs: DataFrame, cells):
    """(cell, count, number of different pairs) of the cells that pairs fall into; cells(ids before,
    ids, counts) gives cells and counts, none or several for each pair."""
    def count(batches):
        for batch in batches:
            for blob in batch["counts"].to_pylist():
                key, n = _spread(blob, np.uint64, np.int64)
                key = np.cumsum(key).astype(np.int64)
                at, n = cells(key // N_IDS, key % N_IDS, n)
                cell, number = np.unique(at, return_inverse=True)
                yield pa.record_batch([
                    pa.array(cell, pa.int64()),
                    pa.array(np.bincount(number, n, len(cell)).astype(np.int64)),
                    pa.array(np.bincount(number, minlength=len(cell)))], names=["cell", "n", "kinds"])

    found = pairs.mapInArrow(count, "cell long, n long, kinds long").groupBy("cell").agg(
        F.sum("n").alias("n"), F.sum("kinds").alias("kinds")).toArrow()
    return [found[c].to_numpy() for c in ("cell", "n", "kinds")]


def _filled(cells, counts, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    out[cells] = counts
    return out


def _within(n, total, left):
    """Log probability within its class of an id seen n times, of the `total` times that its class was,
    after the id before it; `left` is the log of what the discounts leave to it."""
    return np.log((n - DISCOUNT) / total + np.exp(left))


def _given_before(keys, n, klass, inside) -> tuple[Lookup, np.ndarray]:
    """(lookup of ids given the id before, what is left for each class alone)."""
    ids = keys % N_IDS
    group, number = np.unique(keys // N_IDS * CLASSES + klass[ids], return_inverse=True)
    total, kinds = np.bincount(number, n, len(group)), np.bincount(number, minlength=len(group))
    left = np.log(DISCOUNT * kinds / total)
    return Lookup(keys, _within(n, total[number], left[number] + inside[ids])), _by_class(group, left)


def given_before(model: Model, keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log probability within its class of each pair's id, seen n times in training text."""
    keys = keys.astype(np.int64)
    ids = keys % N_IDS
    cell = keys // N_IDS, model.klass[ids]
    value = model.left[cell] + model.inside[ids]
    here = np.flatnonzero(n)
    value[here] = _within(n[here], model.totals[cell][here], value[here])
    return value


def _start(pairs: DataFrame) -> Model:
    """Classes, tables and random parameters."""
    rng = np.random.default_rng(SEED)
    counts = _filled(*_counted(pairs, lambda before, ids, n: (ids, n))[:2], N_IDS)
    top = np.argsort(-counts, kind="stable")
    column = np.full(N_IDS, 2 * NEIGHBOURS, np.int64)
    column[top[:NEIGHBOURS]] = np.arange(NEIGHBOURS)

    def neighbours(before, ids, n):
        first, second = column[before], column[ids]
        left, right = first < NEIGHBOURS, second < NEIGHBOURS
        return (np.concatenate([ids[left] * 2 * NEIGHBOURS + first[left],
                                before[right] * 2 * NEIGHBOURS + NEIGHBOURS + second[right]]),
                np.concatenate([n[left], n[right]]))

    cells, n, _ = _counted(pairs, neighbours)
    context = np.zeros(N_IDS * 2 * NEIGHBOURS, np.float32)
    context[cells] = n
    context = context.reshape(N_IDS, -1)
    known = np.flatnonzero(context.sum(1) > 0)
    klass = np.full(N_IDS, CLASSES - 1, np.int64)
    if len(known):
        share = np.sqrt(context[known] / context[known].sum(1, keepdims=True))
        klass[known] = _clusters(share, np.sqrt(np.maximum(counts[known], 1)), CLASSES - 1, rng)
    size = np.bincount(klass, minlength=CLASSES)
    total = np.bincount(klass, counts, CLASSES)
    inside = np.log(counts + 0.1) - np.log(np.maximum(total + 0.1 * size, 1e-9))[klass]
    row = OWN_ROWS + klass
    row[top[:OWN_ROWS]] = np.arange(min(OWN_ROWS, N_IDS))
    row[BOUNDARY] = 0
    table = rng.normal(0, 0.1, (OWN_ROWS + CLASSES, 3 * WIDTH)).astype(np.float32)
    none = Lookup(np.zeros(0, np.int64), np.zeros(0))
    empty = np.zeros((N_IDS, CLASSES))
    return Model(row, klass, inside, _prior(empty), none, empty, table,
                 np.zeros(WINDOW, np.float32), rng.normal(0, 0.1, (WIDTH, CLASSES)).astype(np.float32))


def _clusters(points, weight, k, rng, steps: int = 12) -> np.ndarray:
    """Weighted k-means; at most k clusters."""
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False, p=weight / weight.sum())]
    for _ in range(steps):
        near = (points @ centres.T - 0.5 * (centres ** 2).sum(1)).argmax(1)
        total = np.bincount(near, weight, len(centres))
        for c in np.flatnonzero(total):
            own = near == c
            centres[c] = (points[own] * weight[own, None]).sum(0) / total[c]
    return near


def _third(ids, tokens, turn: int):
    """(ids, lengths) of the training documents of a step whose turn it is."""
    _, _, train = _spread(ids, np.int64, np.bool_, np.bool_)
    lengths, _, tokens = _spread(tokens, np.int64, np.int64, np.uint16)
    train = train & (np.arange(len(train)) % ROUNDS == turn)
    return tokens[np.repeat(train, lengths + 1)], lengths[train]


def _with(held, parameters) -> Model:
    """The model that a task holds, with the parameters sent after it."""
    model = replace(held.value)
    model.load(parameters.value)
    return model


def _averaged(learned: DataFrame, held, start: np.ndarray, turn: int, block: int = 8192) -> np.ndarray:
    """Parameters after a pass of each part of the stored table over its share of the turn's documents, from
    the given start, averaged by the ids read."""
    sent = learned.sparkSession.sparkContext.broadcast(start.astype(np.float32))

    def train(batches):
        model, read = None, 0
        for batch in batches:
            for row_ids, row_tokens in zip(batch["ids"].to_pylist(), batch["tokens"].to_pylist(), strict=True):
                ids, lengths = _third(row_ids, row_tokens, turn)
                if not len(lengths):
                    continue
                model = model or _with(held, sent)
                memory = train_pass(model, ids.astype(np.int32), lengths, turn, memory if read else None)
                read += len(ids)
        if model is None:
            return
        flat = model.parameters()
        cuts = range(0, len(flat), block)
        yield pa.record_batch([
            pa.array(np.arange(len(cuts)), pa.int32()), pa.array([float(read)] * len(cuts)),
            pa.array([(flat[c:c + block].astype(np.float64) * read).tobytes() for c in cuts], pa.binary())],
            names=["block", "weight", "part"])

    def mean(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(p, np.float64) for p in table["part"].to_pylist())
        return pa.table({"block": table["block"].slice(0, 1),
                         "part": pa.array([(total / table["weight"].to_numpy().sum()).tobytes()], pa.binary())})

    found = (learned.mapInArrow(train, "block int, weight double, part binary")
             .groupBy("block").applyInArrow(mean, "block int, part binary").collect())
    if not found:
        return start
    return np.concatenate([np.frombuffer(r.part, np.float64) for r in sorted(found, key=lambda r: r.block)])


def _squeeze(*columns) -> bytes:
    raw = b"".join([np.array([len(columns[0])], np.int64).tobytes()] + [c.tobytes() for c in columns])
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _spread(blob: bytes, *kinds) -> list[np.ndarray]:
    """The columns of a blob; the last may have another length than the others and is all that is left."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for i, kind in enumerate(kinds):
        out.append(np.frombuffer(raw, kind, n if i < len(kinds) - 1 else -1, at))
        at += n * np.dtype(kind).itemsize
    return out


STEP = "step long, shard int, words binary, places binary, ids binary, tokens binary"


def _steps(files, n_shards: int):
    """Per step of a task: its documents with their ids, and per shard its words or pairs of ids."""
    def run(batches):
        encoder = Encoder(*files)
        part, n = TaskContext.get().partitionId(), 0
        for table in chunks(_large(batches), "text", STEP_BYTES):
            ids, lengths, hashes, docs, base = [], [], [], [], 0
            for piece in chunks([table], "text", PIECE_BYTES):
                got = encoded(piece["text"].to_pylist(), encoder)
                ids.append(got[0].astype(np.uint16))
                lengths.append(got[1])
                data, offsets = utf8(piece["text"])
                w = words(LOWER[data], offsets, NOT_SPACE)
                hashes += [word_hashes(w), np.full(piece.num_rows, END_HASH)]
                docs += [w.text_of() + base, np.arange(piece.num_rows) + base]
                base += piece.num_rows
            yield _step(part << 32 | n, table, np.concatenate(ids), np.concatenate(lengths),
                        np.concatenate(hashes), np.concatenate(docs), n_shards)
            n += 1
    return run


def _large(batches, size: int = STEP_BYTES):
    """Batches put together to about `size` bytes."""
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += batch.nbytes
        if total >= size:
            yield pa.Table.from_batches(held)
            held, total = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _step(step, table, tokens, lengths, hashes, docs, n_shards):
    train = table["train"].to_numpy(zero_copy_only=False).astype(np.int64) if table.num_rows else np.zeros(0, np.int64)
    word, number = np.unique(hashes, return_inverse=True)
    n_docs = table.num_rows
    pair, times = np.unique(number.astype(np.int64) * n_docs + docs, return_counts=True)
    pair_word, pair_doc = pair // n_docs, pair % n_docs
    learned = np.bincount(pair_word, times * train[pair_doc], len(word)).astype(np.int64)
    per_word = np.bincount(pair_word, minlength=len(word))
    shard = (word % np.uint64(n_shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order], prepend=-1))
    begin = np.cumsum(per_word) - per_word
    ids = table["doc_id"].combine_chunks()
    out = [[step], [-1], [None], [None]]
    for own in np.split(order, cuts[1:]):
        at = ranges(begin[own], per_word[own])
        rank = np.repeat(np.arange(len(own)), per_word[own])
        for column, value in zip(out, (step, int(shard[own[0]]), _squeeze(_gaps(word[own]), learned[own]),
                                       _squeeze(rank.astype(np.uint32), pair_doc[at].astype(np.uint32),
                                                times[at].astype(np.uint32))), strict=True):
            column.append(value)
    # A pair's number with a bit for training text, so that one sort gives pairs and counts.
    key, times = np.unique(pair_keys(tokens, lengths)[1] << np.uint64(1) | np.repeat(train, lengths).astype(np.uint64),
                           return_counts=True)
    pair, number = np.unique(key >> np.uint64(1), return_inverse=True)
    learned = np.bincount(number, times * (key & np.uint64(1)).astype(np.int64), len(pair)).astype(np.int64)
    shard = pair_shards(pair, n_shards)
    for s in np.unique(shard):
        own = shard == s
        for column, value in zip(out, (step, int(s), _squeeze(_gaps(pair[own]), learned[own]), None), strict=True):
            column.append(value)
    none = [None] * (len(out[0]) - 1)
    own = (_squeeze(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), train > 0),
           _squeeze(lengths, np.bincount(docs, minlength=n_docs).astype(np.int64), tokens))
    return pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32())] + [
        pa.array(c, pa.binary()) for c in (out[2], out[3], [own[0], *none], [own[1], *none])],
        names=["step", "shard", "words", "places", "ids", "tokens"])


def _gaps(rising: np.ndarray) -> np.ndarray:
    """Rising numbers as steps, which take less room."""
    return np.diff(rising, prepend=np.uint64(0))


def pair_shards(pair: np.ndarray, n_shards: int) -> np.ndarray:
    """The shard of each pair of ids; words have those below."""
    return n_shards + (mixed(pair) % np.uint64(n_shards)).astype(np.int64)


def _answers(table: pa.Table) -> pa.Table:
    """One shard: per step the training counts of the words or pairs it asked for; and the shard's N and
    V with its words or pairs of training text and their counts."""
    asked = [_spread(b, np.uint64, np.int64) for b in table["words"].to_pylist()]
    asked = [(np.cumsum(a), n) for a, n in asked]
    word, number = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
    count = np.bincount(number, np.concatenate([a[1] for a in asked]), len(word)).astype(np.int64)
    blobs = [_squeeze(c) for c in np.split(count[number], np.cumsum([len(a[0]) for a in asked])[:-1])]
    n, known = table.num_rows, count > 0
    return pa.table({
        "step": pa.concat_arrays([table["step"].combine_chunks(), pa.nulls(1, pa.int64())]),
        "shard": pa.array(table["shard"].to_pylist() + [table["shard"][0].as_py()], pa.int32()),
        "counts": pa.array([*blobs, _squeeze(_gaps(word[known]), count[known])], pa.binary()),
        "n": pa.array([None] * n + [int(count.sum())], pa.int64()),
        "v": pa.array([None] * n + [int(known.sum())], pa.int64())})


RESULT = "doc_id long, n_tokens long, n_known long, base double, score double"


def _gather(held, parameters, n_shards: int):
    """One step: its documents' figures from the answers of all shards."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        answers = dict(zip(right["shard"].to_pylist(), right["counts"].to_pylist(), strict=True))
        places = dict(zip(left["shard"].to_pylist(), left["places"].to_pylist(), strict=True))
        del places[-1]
        ids, missing, _ = _spread(left["ids"].drop_null()[0].as_py(), np.int64, np.bool_, np.bool_)
        lengths, n_tokens, tokens = _spread(left["tokens"].drop_null()[0].as_py(), np.int64, np.int64, np.uint16)
        base, known = np.zeros(len(ids)), np.zeros(len(ids))
        for shard, blob in sorted(places.items()):
            rank, doc, times = _spread(blob, np.uint32, np.uint32, np.uint32)
            count = _spread(answers[shard], np.int64)[0][rank]
            base += np.bincount(doc, times * np.log10(count + 1.0), len(ids))
            known += np.bincount(doc, times * (count > 0), len(ids))
        at, keys = pair_keys(tokens, lengths)
        pair, number = np.unique(keys, return_inverse=True)
        shard, n = pair_shards(pair, n_shards), np.zeros(len(pair), np.int64)
        for s in np.unique(shard):
            n[shard == s] = _spread(answers[s], np.int64)[0]
        given = np.zeros(len(tokens))
        model = _with(held, parameters)
        given[at] = given_before(model, pair, n)[number]
        score = score_ids(model, tokens.astype(np.int32), lengths, given) / np.log(10)
        return pa.table({"doc_id": pa.array(ids, mask=missing), "n_tokens": pa.array(n_tokens),
                         "n_known": pa.array(known.astype(np.int64)), "base": pa.array(base),
                         "score": pa.array(score)})
    return run


def score_documents(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", files=None) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every document; the column
    `train` says which are learned from. Scores are base-10 logarithms. A vocabulary has `N_IDS` ids at most."""
    files = files or vocabulary()
    if Encoder(*files).tokenizer.get_vocab_size() > N_IDS:
        raise ValueError(f"the vocabulary has more than {N_IDS} ids")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       (F.coalesce(train, F.lit(False)) & F.col(id_col).isNotNull()).alias("train"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_shards = max(8, -(-size // SHARD_BYTES))
    steps = stored(rows.mapInArrow(_steps(files, n_shards), STEP))
    answers = stored(steps.filter("shard >= 0").select("step", "shard", "words").repartition(2 * n_shards, "shard")
                     .groupBy("shard").applyInArrow(_answers, "step long, shard int, counts binary, n long, v long"))
    own = answers.filter("step is null")
    n, v = own.filter(F.col("shard") < n_shards).agg(F.sum("n"), F.sum("v")).first()
    n, v = n or 0, v or 0
    pairs = own.filter(F.col("shard") >= n_shards).select("counts")
    model, held = fit(steps, pairs)
    parameters = spark.sparkContext.broadcast(model.parameters().astype(np.float32))
    places = steps.filter(F.col("shard") < n_shards).select("step", "shard", "places", "ids", "tokens")
    found = places.groupBy("step").cogroup(
        answers.filter("step is not null").groupBy("step")).applyInArrow(_gather(held, parameters, n_shards), RESULT)
    return found.select("doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
                        (F.col("base") - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"),
                        "score")
