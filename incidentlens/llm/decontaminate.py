"""Benchmark decontamination with suffix arrays over the training texts.

Each task cuts its documents into shards of a few megabytes and sorts the word suffixes of a shard
(`suffixes.suffix_array`). Every suffix of the benchmark is then looked up by binary search; from the
intervals follow all places where a benchmark window stands verbatim, and from windows that continue
each other the longest match of each document. Nothing is shuffled: a document's result needs only
the document and the benchmark. The benchmark is a query set held against all rows. It is taken in
blocks of at most `BLOCK_BYTES` of text (one item at least), each a pass over the documents, so what
is sent to the tasks has a bound at any benchmark size.

Defined results: null, empty or wordless texts have no words and are never hit; items without words
are no items; a repeated row is answered twice; repeated item ids count once; without items nothing
is hit. Other columns are passed through unread, whatever their names are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .suffixes import bits_for, intervals, suffix_array
from .textarrays import ALPHANUMERIC, chunks, ranges, utf8, word_hashes, words

WINDOW = 10
BLOCK_BYTES = 8 << 20
SPANS = "array<struct<start:long,length:long>>"
REPORT = f"n_words long, spans {SPANS}, items array<string>, longest struct<n_words:long,doc_word:long,item_id:string,item_word:long>"


class Benchmark:
    """Windows of the items, as word numbers over the items' own vocabulary."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int):
        data, offsets = utf8(pa.array(texts, pa.string()))
        w = words(data, offsets, ALPHANUMERIC, lower=True)
        hashes = word_hashes(w)
        self.vocabulary, number = np.unique(hashes, return_inverse=True)
        number = number.astype(np.int64) + 1
        per_item = w.per_text
        n_windows = np.where(per_item > 0, np.maximum(per_item - window + 1, 1), 0)
        start = ranges(w.first[:-1], n_windows)
        item = np.repeat(np.arange(len(ids)), n_windows)
        length = np.minimum(per_item[item], window)
        cells = np.minimum(start[:, None] + np.arange(window), max(len(number) - 1, 0))
        rows = np.where(np.arange(window) < length[:, None], number[cells] if len(number) else 0, 0)
        self.patterns, which = np.unique(rows, axis=0, return_inverse=True) if len(rows) else (rows, item)
        self.lengths = (self.patterns > 0).sum(1)
        order = np.argsort(which.ravel(), kind="stable")
        self.place_item = item[order]
        self.place_word = (start - w.first[item])[order]
        self.place_first = np.searchsorted(which.ravel()[order], np.arange(len(self.patterns) + 1))
        self.ids = np.array(ids, object)
        self.bits = bits_for(len(self.vocabulary))

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers; 0 for words that no item holds."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


def match(column, bench: Benchmark):
    """Per text: words, covered spans, items found, longest match."""
    data, offsets = utf8(column)
    w = words(data, offsets, ALPHANUMERIC, lower=True)
    n_texts, n_words = len(offsets) - 1, len(w.start)
    text_of = w.text_of()
    ids = np.zeros(n_words + n_texts + 1, np.int64)
    ids[np.arange(n_words) + text_of] = bench.number(word_hashes(w))
    sa = suffix_array(ids, bench.bits)
    lo, hi = intervals(sa, bench.patterns, bench.lengths)
    pattern = np.repeat(np.arange(len(lo)), hi - lo)
    place = sa.positions[ranges(lo, hi - lo)]
    # Positions count one end mark per text before them.
    text = np.searchsorted(w.first[1:] + np.arange(1, n_texts + 1), place, "right") if n_texts else place
    word = place - text
    steps = np.zeros(n_words + 1, np.int64)
    np.add.at(steps, word, 1)
    np.subtract.at(steps, word + bench.lengths[pattern], 1)
    hit = np.cumsum(steps)[:n_words] > 0
    spans = _runs(hit, w, text_of)
    order = np.lexsort((pattern, text))
    items, longest = {}, {}
    edges = np.flatnonzero(np.diff(text[order], prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        t = int(text[order[a]])
        mine = order[a:b]
        items[t], longest[t] = _items(bench, pattern[mine], word[mine] - w.first[t])
    return w.per_text, spans, items, longest


def _runs(hit, w, text_of):
    """Per text the covered spans, as (first word, words)."""
    here = np.flatnonzero(hit)
    if not len(here):
        return {}
    new = np.ones(len(here), bool)
    new[1:] = (np.diff(here) > 1) | (np.diff(text_of[here]) > 0)
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(here)))
    out = {}
    for i, n in zip(here[first], length, strict=True):
        t = int(text_of[i])
        out.setdefault(t, []).append((int(i - w.first[t]), int(n)))
    return out


def _items(bench, pattern, word):
    """Items found in one text, and its longest run of windows that continue each other."""
    counts = np.diff(bench.place_first)[pattern]
    places = ranges(bench.place_first[pattern], counts)
    item, item_word = bench.place_item[places], bench.place_word[places]
    doc_word = np.repeat(word, counts)
    length = np.repeat(bench.lengths[pattern], counts)
    order = np.lexsort((doc_word, doc_word - item_word, item))
    item, item_word, doc_word, length = (x[order] for x in (item, item_word, doc_word, length))
    new = np.ones(len(item), bool)
    new[1:] = ((np.diff(item) != 0) | (np.diff(doc_word - item_word) != 0) | (np.diff(doc_word) != 1))
    first = np.flatnonzero(new)
    run = np.diff(np.append(first, len(item)))
    total = run + length[first] - 1
    best = int(np.lexsort((item_word[first], doc_word[first], -total))[0])
    found = sorted({str(x) for x in bench.ids[np.unique(item)]})
    return found, (int(total[best]), int(doc_word[first[best]]), str(bench.ids[item[first[best]]]),
                   int(item_word[first[best]]))


def blocks(items: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int = BLOCK_BYTES):
    """The benchmark in blocks of bounded size, each as a broadcast."""
    spark = items.sparkSession
    chosen = items.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).filter(
        "i is not null")
    total = chosen.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    for b in range(n):
        rows = chosen.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).collect()
        yield spark.sparkContext.broadcast(Benchmark([r.i for r in rows], [r.t for r in rows], window))


def report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document: id, n_words, covered spans (first word, words), items with occurring windows,
    and the longest verbatim match with its places."""
    kind = docs.schema[id_col].dataType.simpleString()
    table = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                        F.lit(0).cast("long").alias("n_words"), F.array().cast(SPANS).alias("spans"),
                        F.array().cast("array<string>").alias("items"),
                        F.lit(None).cast("struct<n_words:long,doc_word:long,item_id:string,item_word:long>").alias("longest"))
    for block in blocks(items, item_col, item_text_col, window):
        table = table.mapInArrow(_reporter(block), f"doc_id {kind}, text string, {REPORT}")
    return table.drop("text")


def _reporter(block):
    def run(batches):
        for table in chunks(batches, "text"):
            n_words, spans, items, longest = match(table["text"], block.value)
            old = table.select(["spans", "items", "longest"]).to_pylist()
            all_spans, all_items, all_longest = [], [], []
            for t, row in enumerate(old):
                merged = _merged([(s["start"], s["length"]) for s in row["spans"]], spans.get(t, []))
                all_spans.append([{"start": a, "length": n} for a, n in merged])
                all_items.append(sorted({*row["items"], *items.get(t, [])}))
                best = max((x for x in (longest.get(t), row["longest"] and tuple(row["longest"].values())) if x),
                           default=None, key=lambda x: (x[0], -x[1]))
                all_longest.append(best and dict(zip(
                    ("n_words", "doc_word", "item_id", "item_word"), best, strict=True)))
            one = pa.struct([("start", pa.int64()), ("length", pa.int64())])
            where = pa.struct([("n_words", pa.int64()), ("doc_word", pa.int64()), ("item_id", pa.string()),
                               ("item_word", pa.int64())])
            yield from pa.table({
                "doc_id": table["doc_id"], "text": table["text"], "n_words": pa.array(n_words, pa.int64()),
                "spans": pa.array(all_spans, pa.list_(one)), "items": pa.array(all_items, pa.list_(pa.string())),
                "longest": pa.array(all_longest, where)}).to_batches()
    return run


def _merged(a, b):
    if not a or not b:
        return a or b
    out = []
    for start, n in sorted([*a, *b]):
        if out and start <= out[-1][0] + out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], start + n - out[-1][0]))
        else:
            out.append((start, n))
    return out


def remove_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text",
                        item_col: str = "item_id", item_text_col: str = "text",
                        window: int = WINDOW) -> DataFrame:
    """The documents in which no benchmark window stands; all columns as they are."""
    schema = docs.schema
    for block in blocks(items, item_col, item_text_col, window):
        docs = docs.mapInArrow(_filterer(block, text_col), schema)
    return docs


def _filterer(block, text_col):
    def run(batches):
        for table in chunks(batches, text_col):
            spans = match(table[text_col], block.value)[1]
            clean = np.ones(table.num_rows, bool)
            clean[list(spans)] = False
            yield from table.filter(pa.array(clean)).to_batches()
    return run


def digest(found: DataFrame) -> DataFrame:
    """The counts of a report: words, words hit, items, and a hash of the items' ids."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["length"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"), "longest")


def items_hash(ids) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
