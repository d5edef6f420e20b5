"""Substring dedup with a compressed FM-index per shard.

A word is removed when a window of `window` words that covers it also starts in a document with a
smaller id. To find such windows without holding every text against every shard:

1. Each window has an anchor, the `ANCHOR` consecutive words inside it with the least hash (leftmost
   on a tie), so equal windows have equal anchors. Neighbouring windows mostly share theirs and form a
   segment. Anchors, not texts, are shuffled, and those found in one document only are done with.
2. The segments of the other anchors (a small part of the text) go, by anchor, to shards. Equal
   segments are one there, and all of them but the one in the smallest document are removed.
3. A shard builds an FM-index over its distinct segments and streams them through it by backward
   search (`fm_index`). The rows of a match of `window` words give the smallest document that holds
   the window: if that is smaller than the segment's own, the window's interval is reported.

Skew: a task first settles what several of its own documents share and passes one entry on, so a
passage in a third of all documents is one entry per few megabytes of text. An anchor with more than
`HOT_ENTRIES` entries even so (a template in near copies) is dealt again by whole windows, each a
segment of its own. Anchors are compared by 64-bit hashes, which only select. Equal segments within a task's
step are settled there by their bytes, so their removals don't come from the index. The index compares
windows by words numbered by their 64-bit hash: two words that share one would count as the same.

Defined results: a null or empty text has no words and keeps ''; texts shorter than a window lose
nothing; rows that repeat an id are not smaller than each other; rows without an id lose nothing and
remove nothing; an empty table gives no rows. Windows are judged on the input.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, stored
from .fm_index import FMIndex
from .textarrays import NOT_SPACE, Words, chunks, gram_hashes, ranges, utf8, word_hashes, words

WINDOW = 13
ANCHOR = 4
HOT_ENTRIES = 20_000
SHARD_BYTES = 4 << 20
#: Text of one task's step: what it holds twice is settled before anything is sent.
STEP_BYTES = 8 << 20
ENTRY = np.dtype([("anchor", "<u8"), ("doc", "<i8"), ("mark", "<u4"), ("start", "<u4"), ("n", "<u1")])


def segments_of(w: Words, window: int):
    """(anchor, text, first window within the text, windows): runs of windows that share an anchor."""
    hashes = word_hashes(w)
    grams = gram_hashes(hashes, ANCHOR)
    reach = window - ANCHOR + 1
    n = len(grams) - reach + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    least, at = grams[:n].copy(), np.zeros(n, np.int16)
    for j in range(1, reach):
        other = grams[j:j + n]
        smaller = other < least
        least[smaller] = other[smaller]
        at[smaller] = j
    per_text = np.maximum(w.per_text - window + 1, 0)
    valid = ranges(w.first[:-1], per_text)
    text = np.repeat(np.arange(len(per_text)), per_text)
    place = valid + at[valid]
    new = np.ones(len(valid), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    n_windows = np.diff(np.append(head, len(valid)))
    return least[valid[head]], text[head], valid[head] - w.first[text[head]], n_windows


def _pack(entries: np.ndarray) -> bytes:
    """Entries column by column, compressed."""
    columns = b"".join(np.ascontiguousarray(entries[name]).tobytes() for name in ENTRY.names)
    return zstandard.ZstdCompressor(level=1).compress(columns)


def _unpack(blob: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    entries = np.empty(len(raw) // ENTRY.itemsize, ENTRY)
    at = 0
    for name in ENTRY.names:
        kind = ENTRY[name]
        entries[name] = np.frombuffer(raw, kind, len(entries), at)
        at += kind.itemsize * len(entries)
    return entries


def _send(n_shards: int, window: int):
    """Anchors of each step, by shard: one entry per anchor, and apart those already known as shared."""
    def run(batches):
        for table in chunks(batches, "text", STEP_BYTES):
            data, offsets = utf8(table["text"])
            anchor, text, start, n = segments_of(words(data, offsets, NOT_SPACE), window)
            entries = np.empty(len(anchor), ENTRY)
            entries["anchor"], entries["start"], entries["n"] = anchor, start, n
            entries["doc"] = table["doc"].to_numpy()[text]
            entries["mark"] = table["mark"].to_numpy()[text]
            entries = entries[np.lexsort((entries["doc"], anchor))]
            same = np.zeros(len(entries), bool)
            same[1:] = entries["anchor"][1:] == entries["anchor"][:-1]
            other = same.copy()
            other[1:] &= entries["doc"][1:] != entries["doc"][:-1]
            group = np.cumsum(~same) - 1
            shared = np.bincount(group, other)[group] > 0 if len(group) else same
            yield from _rows(entries, shared, same, n_shards)
    return run


def _rows(entries, shared, same, n_shards):
    # Of an anchor with several documents here, one entry with n = 0 stands for "shared, seen here".
    mark = entries[shared & ~same].copy()
    mark["n"] = 0
    for kind, part in ((0, np.concatenate([entries[~shared], mark])), (1, entries[shared])):
        shard = ((part["anchor"] >> np.uint64(20)) % np.uint64(n_shards)).astype(np.int64)
        if kind:  # on their way through only, so any shard will do
            shard = np.full(len(part), int(part["doc"].sum() % n_shards) if len(part) else 0)
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.diff(shard[order], prepend=-1))
        to = shard[order][cuts]
        blobs = [_pack(x) for x in np.split(part[order], cuts[1:])] if len(part) else []
        yield pa.record_batch([pa.array(to, pa.int32()), pa.array(np.full(len(to), kind), pa.int32()),
                               pa.array(blobs, pa.binary())], names=["to", "kind", "blob"])


FOUND = "doc long, mark long, start int, n int, anchor long, hot boolean"


def _meet(hot_entries: int):
    """Entries whose anchor stands in two documents at least; of hot anchors also a row without document."""
    def run(table: pa.Table) -> pa.Table:
        parts = [[], []]
        for kind, blob in zip(table["kind"].to_pylist(), table["blob"].to_pylist(), strict=True):
            parts[kind].append(_unpack(blob))
        sent, passed = (np.concatenate(p) if p else np.empty(0, ENTRY) for p in parts)
        anchors, group, count = np.unique(sent["anchor"], return_inverse=True, return_counts=True)
        first_doc = np.full(len(anchors), np.iinfo(np.int64).max)
        last_doc = np.full(len(anchors), np.iinfo(np.int64).min)
        np.minimum.at(first_doc, group, sent["doc"])
        np.maximum.at(last_doc, group, sent["doc"])
        shared = first_doc < last_doc
        shared |= np.bincount(group, sent["n"] == 0, len(anchors)) > 0
        found = np.concatenate([sent[shared[group] & (sent["n"] > 0)], passed])
        hot = anchors[count > hot_entries]
        nothing = pa.nulls(len(hot), pa.int64())
        out = {name: pa.array(found[name].astype(np.int64)) for name in ("doc", "mark", "start", "n")}
        return pa.table({
            "doc": pa.concat_arrays([out["doc"], nothing]), "mark": pa.concat_arrays([out["mark"], nothing]),
            "start": pa.concat_arrays([out["start"], nothing]).cast(pa.int32()),
            "n": pa.concat_arrays([out["n"], nothing]).cast(pa.int32()),
            "anchor": pa.array(np.concatenate([found["anchor"], hot]).view(np.int64)),
            "hot": pa.array(np.arange(len(found) + len(hot)) >= len(found))})
    return run


SEGMENT = np.dtype([("doc", "<i8"), ("mark", "<u4"), ("start", "<u4"), ("n", "<u1"), ("size", "<u4")])


def _cut(n_shards: int, window: int):
    """The words of listed segments, by shard; hot ones window by window. Equal contents of a step go
    once; the others of them are already answered and go without content."""
    def run(batches):
        for table in chunks(batches, "text", STEP_BYTES):
            data, offsets = utf8(table["text"])
            w = words(data, offsets, NOT_SPACE)
            lists = table["list"].combine_chunks()
            counts = lists.value_lengths().to_numpy()
            flat = lists.flatten()
            start, n = (flat.field(k).to_numpy().astype(np.int64) for k in (0, 1))
            hot = flat.field(2).to_numpy(zero_copy_only=False)
            text = np.repeat(np.arange(len(counts)), counts)
            if hot.any():
                each = np.where(hot, n, 1)
                n, text, hot = (np.repeat(x, each) for x in (np.where(hot, 1, n), text, hot))
                start = ranges(start, each)
            first = w.first[text] + start
            if not len(first):
                continue
            hashes = word_hashes(w)
            grams = gram_hashes(hashes, ANCHOR)
            key = np.min([grams[first + j] for j in range(window - ANCHOR + 1)], axis=0)
            key[hot] = gram_hashes(hashes, window)[first[hot]]
            joined, begin, end = _joined(w)
            b, e = begin[first].tolist(), end[first + n + window - 2].tolist()
            content = [joined[i:j] for i, j in zip(b, e, strict=True)]
            segment = np.empty(len(first), SEGMENT)
            segment["start"], segment["n"] = start, n
            segment["doc"], segment["mark"] = table["doc"].to_numpy()[text], table["mark"].to_numpy()[text]
            least: dict[bytes, int] = {}
            for c, d in zip(content, segment["doc"].tolist(), strict=True):
                if least.setdefault(c, d) > d:
                    least[c] = d
            content = [c if least[c] == d else b"" for c, d in zip(content, segment["doc"].tolist(), strict=True)]
            segment["size"] = [len(c) for c in content]
            yield _by_shard(segment, content, ((key >> np.uint64(20)) % np.uint64(n_shards)).astype(np.int64))
    return run


def _by_shard(segment, content, shard):
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order], prepend=-1))
    press = zstandard.ZstdCompressor(level=1)
    blobs = []
    for part in np.split(order, cuts[1:]):
        columns = [np.ascontiguousarray(segment[part][name]).tobytes() for name in SEGMENT.names]
        blobs.append(press.compress(b"".join([np.int64(len(part)).tobytes(), *columns, *[content[i] for i in part.tolist()]])))
    return pa.record_batch([pa.array(shard[order][cuts], pa.int32()), pa.array(blobs, pa.binary())],
                           names=["to", "blob"])


def _segments(blob: bytes):
    """Segments of a blob and their contents laid end to end."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    out, at = np.empty(int(np.frombuffer(raw, np.int64, 1)[0]), SEGMENT), 8
    for name in SEGMENT.names:
        kind = SEGMENT[name]
        out[name] = np.frombuffer(raw, kind, len(out), at)
        at += kind.itemsize * len(out)
    return out, raw[at:]


def _joined(w: Words):
    """The words with one space behind each, and where each begins and ends."""
    inside = NOT_SPACE[w.data]
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    place = np.cumsum(keep) - 1
    joined = np.where(inside, w.data, 0x20).astype(np.uint8)[keep].tobytes()
    return joined, place[w.start], place[w.end - 1] + 1


VERDICT = "doc long, mark long, start int, n int"


def _search(window: int):
    """Windows to remove, as runs (first window, windows) of each segment."""
    def run(table: pa.Table) -> pa.Table:
        segments, raw = zip(*map(_segments, table["blob"].to_pylist()), strict=True)
        segment = np.concatenate(segments)
        doc, mark, start, n = (segment[c].astype(np.int64) for c in ("doc", "mark", "start", "n"))
        size = segment["size"].astype(np.int64)
        known, rest = np.flatnonzero(size == 0), np.flatnonzero(size)
        out = [(doc[known], mark[known], start[known], n[known])]
        if len(rest):
            offsets = np.concatenate([[0], np.cumsum(size[rest])])
            contents = pa.LargeStringArray.from_buffers(len(rest), pa.py_buffer(offsets), pa.py_buffer(b"".join(raw)))
            out.append(_search_contents(contents, doc[rest], mark[rest], start[rest], window))
        doc, mark, start, n = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"doc": pa.array(doc), "mark": pa.array(mark), "start": pa.array(start, pa.int32()),
                         "n": pa.array(n, pa.int32())})
    return run


def _search_contents(contents, doc, mark, start, window):
    coded = contents.dictionary_encode()
    which = coded.indices.to_numpy().astype(np.int64)
    least = np.full(len(coded.dictionary), np.iinfo(np.int64).max)
    np.minimum.at(least, which, doc)
    data, offsets = utf8(coded.dictionary)
    w = words(data, offsets, NOT_SPACE)
    vocabulary, number = np.unique(word_hashes(w), return_inverse=True)
    text = w.text_of()
    n_words = len(number)
    ids = np.zeros(n_words + len(least), np.int64)
    ids[np.arange(n_words) + text] = number + 1
    owner = np.repeat(least, w.per_text + 1)
    index = FMIndex(ids, window)
    length, lo, hi = index.matching_statistics(number.astype(np.int64) + 1, w.first)
    whole = np.flatnonzero(length == window)
    before = np.full(n_words, np.iinfo(np.int64).max)
    before[whole] = index.smallest(owner, lo[whole], hi[whole])
    # Windows of each distinct segment; a segment of a later document loses them all.
    n_windows = w.per_text - window + 1
    flag_at = np.cumsum(n_windows) - n_windows
    flags_before = before[ranges(w.first[:-1], n_windows)]
    counts = n_windows[which]
    flags = flags_before[ranges(flag_at[which], counts)] < np.repeat(doc, counts)
    row = np.repeat(np.arange(len(which)), counts)
    offset = ranges(np.zeros(len(which), np.int64), counts)
    here = np.flatnonzero(flags)
    new = np.ones(len(here), bool)
    new[1:] = (np.diff(here) > 1) | (np.diff(row[here]) > 0)
    head = np.flatnonzero(new)
    return (doc[row[here[head]]], mark[row[here[head]]], (start[row[here[head]]] + offset[here[head]]).astype(np.int32),
            np.diff(np.append(head, len(here))).astype(np.int32))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   hot_entries: int = HOT_ENTRIES) -> DataFrame:
    """(doc, mark, spans): per document the runs of removed windows as (first word, windows); `mark`
    tells rows of one id apart (see `_keyed`)."""
    rows = _keyed(docs, id_col, text_col).filter("doc is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_shards = max(8, -(-size // SHARD_BYTES))
    sent = rows.mapInArrow(_send(n_shards, window), "to int, kind int, blob binary")
    found = stored(sent.repartition(n_shards, "to").groupBy("to").applyInArrow(_meet(hot_entries), FOUND))
    hot = found.filter("hot").select("anchor", F.lit(True).alias("is_hot"))
    entries = found.filter("not hot").drop("hot").join(hot, "anchor", "left").select(
        "doc", "mark", F.struct("start", "n", F.coalesce("is_hot", F.lit(False)).alias("hot")).alias("one"))
    lists = entries.groupBy("doc", "mark").agg(F.collect_list("one").alias("list"))
    cut = _with(rows, lists, "inner").select("doc", "mark", "text", "list").mapInArrow(
        _cut(n_shards, window), "to int, blob binary")
    verdicts = stored(cut.repartition(n_shards, "to").groupBy("to").applyInArrow(_search(window), VERDICT))
    discard(found)
    return verdicts.groupBy("doc", "mark").agg(F.collect_set(F.struct("start", "n")).alias("spans"))


def _with(rows, lists, how):
    """Rows with their documents' lists. The lists grow with the documents, so the join is a shuffle at every size."""
    return rows.join(lists.hint("merge"), ["doc", "mark"], how)


def _keyed(docs, id_col, text_col):
    """(doc, mark, text): mark is 0, or where ids repeat the text's crc32, which tells their rows apart."""
    ids = docs.select(F.col(id_col).cast("long").alias("doc"))
    repeats = not ids.filter("doc is not null").groupBy("doc").count().filter("count > 1").isEmpty()
    text = F.coalesce(F.col(text_col), F.lit(""))
    mark = F.crc32(text.cast("binary")) if repeats else F.lit(0).cast("long")
    return docs.select(F.col(id_col).cast("long").alias("doc"), mark.alias("mark"), text.alias("text"))


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def _remove(window: int, with_text: bool):
    def run(batches):
        for table in chunks(batches, "text"):
            data, offsets = utf8(table["text"])
            w = words(data, offsets, NOT_SPACE)
            lists = table["spans"].combine_chunks()
            counts = lists.value_lengths().fill_null(0).to_numpy()
            flat = lists.flatten()
            start, n = (flat.field(k).to_numpy().astype(np.int64) for k in (0, 1))
            first = np.repeat(w.first[:-1], counts) + start
            step = np.zeros(len(w.start) + 1, np.int64)
            np.add.at(step, first, 1)
            np.subtract.at(step, first + n + window - 1, 1)
            gone = np.cumsum(step)[:-1] > 0
            removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[w.first])
            kept = list(_kept(w, gone))
            yield pa.record_batch([
                table["doc"].combine_chunks(), pa.array(w.per_text, pa.int64()), pa.array(removed, pa.int64()),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
                pa.array([k.decode() if with_text else None for k in kept], pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])
    return run


def _kept(w: Words, gone: np.ndarray):
    """Per text its remaining words, joined by one space."""
    inside = np.zeros(len(w.data) + 1, np.int8)
    left = ~gone
    np.add.at(inside, w.start[left], 1)
    np.subtract.at(inside, w.end[left], 1)
    inside = np.cumsum(inside, dtype=np.int8)[:-1].astype(bool)
    # Each kept word with one space behind it.
    length = np.where(left, w.end - w.start + 1, 0)
    total = np.concatenate([[0], np.cumsum(length)])
    out = np.full(total[-1], 0x20, np.uint8)
    target = np.ones(total[-1], bool)
    target[total[1:][left] - 1] = False
    out[target] = w.data[inside]
    raw = out.tobytes()
    for a, b in zip(total[w.first[:-1]].tolist(), total[w.first[1:]].tolist(), strict=True):
        yield raw[a:max(a, b - 1)]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   with_text: bool = True, hot_entries: int = HOT_ENTRIES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept): the words left of every document."""
    spans = repeated_spans(docs, id_col, text_col, window, hot_entries)
    rows = _with(_keyed(docs, id_col, text_col), spans, "left")
    return rows.select("doc", "text", "spans").mapInArrow(_remove(window, with_text), RESULT)
