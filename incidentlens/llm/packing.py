"""Best-fit packing of tokenised documents into sequences of fixed length.

Tokens are counted inside tasks and never leave them: a piece is a document number, a start, a length
and a checksum. Packing needs only how many pieces have each length, a table of at most `capacity`
rows, so it runs on that histogram: pieces longer than a third of a sequence come at most two to a
sequence and are matched greedily, the longest with the longest that still fits; shorter ones go, by
falling length, into the tightest gap. Equal lengths are handled together, so the work and the plan's
size depend on the number of lengths, not of documents. Pieces then take the plan's places by their
rank within their length.

Defined results: a null or empty text has the end mark only; a repeated row is packed twice, each time in
places of its own; pieces of equal length take any of their places; other columns are ignored; an empty
table gives no rows. A text is one value; its ids are held together, some 40 bytes a token.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .ranks import ranked
from .textarrays import chunks

CAPACITY = 2048
END = 0
#: Above this lead byte a text holds characters beyond Latin Extended-B.
LATIN_LEAD = 0xC9


class Encoder:
    """Ids of a byte-level BPE vocabulary file.

    Texts of Latin letters go through the same vocabulary's rank file, which is several times faster
    and gives the same ids there (held by tests over that whole range); all others, and texts that
    spell out a special token, go through the tokenizer itself.
    """

    def __init__(self, path: str, ranks: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = _rank_encoder(ranks) if ranks else None

    def __call__(self, text: str) -> list[int]:
        if self.fast and not any(s in text for s in self.special) and (
                text.isascii() or max(text.encode()) <= LATIN_LEAD):
            return self.fast(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids


def _rank_encoder(path):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={}).encode_ordinary


def vocabulary() -> tuple[str, str]:
    """The default vocabulary: tokenizer file and rank file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than the others."""
    head = n % capacity or min(n, capacity)
    return [(0, head)] + [(s, capacity) for s in range(head, n, capacity)] if n else []


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
           files: tuple[str, str | None] | None = None, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the pieces of every document."""
    files = files or vocabulary()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        encode = Encoder(*files)
        for table in chunks(batches, "text"):
            rows = []
            for doc, text in zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), end], "<u4")
                rows += [(doc, k, s, n, zlib.crc32(ids[s:s + n]))
                         for k, (s, n) in enumerate(cut(len(ids), capacity))]
            columns = list(zip(*rows, strict=True))
            yield pa.record_batch([
                pa.array(columns[0], table["doc_id"].type), pa.array(columns[1], pa.int32()),
                *[pa.array(c, pa.int64()) for c in columns[2:]]],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Gaps:
    """Groups of sequences by free room: a group is how many there are, and what each of them holds."""

    def __init__(self):
        self.sizes: list[int] = []
        self.groups: dict[int, list] = {}

    def add(self, room: int, count: int, held: tuple) -> None:
        if count:
            if room not in self.groups:
                insort(self.sizes, room)
                self.groups[room] = []
            self.groups[room].append((count, held))

    def tightest(self, size: int):
        """Take out one group with the least room that is enough, or None."""
        at = bisect_left(self.sizes, size)
        if at == len(self.sizes):
            return None
        room = self.sizes[at]
        count, held = self.groups[room].pop()
        if not self.groups[room]:
            del self.groups[room], self.sizes[at]
        return room, count, held


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple]]:
    """Groups (sequences, ((length, times), ...)) that hold the histogram's pieces."""
    left = {n: c for n, c in histogram.items() if c}
    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    gaps = Gaps()
    for n in large:
        while left[n]:
            # The longest large piece that fits beside this one; among equals two at a time.
            mate = next((m for m in large if m <= capacity - n and left[m] > (m == n)), None)
            if mate is None:
                gaps.add(capacity - n, left[n], ((n, 1),))
                left[n] = 0
            elif mate == n:
                pairs = left[n] // 2
                gaps.add(capacity - 2 * n, pairs, ((n, 2),))
                left[n] -= 2 * pairs
            else:
                pairs = min(left[n], left[mate])
                gaps.add(capacity - n - mate, pairs, ((n, 1), (mate, 1)))
                left[n] -= pairs
                left[mate] -= pairs
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            room, count, held = gaps.tightest(n) or (capacity, left[n], ())
            each = room // n  # once a piece is in, that gap stays the tightest until it is too small
            full = min(count, left[n] // each)
            gaps.add(room - each * n, full, (*held, (n, each)))
            left[n] -= full * each
            rest = min(left[n], each) if full < count else 0
            if rest:
                gaps.add(room - rest * n, 1, (*held, (n, rest)))
                left[n] -= rest
            if held:
                gaps.add(room, count - full - bool(rest), held)
    return [g for room in gaps.sizes for g in gaps.groups[room]]


def places(groups) -> dict[str, np.ndarray]:
    """Rows (length, first rank, times in a sequence, first sequence, offset), by length and rank."""
    rows, taken, sequence = [], {}, 0
    for count, held in groups:
        offset = 0
        for n, times in held:
            rows.append((n, taken.get(n, 0), times, sequence, offset))
            taken[n] = taken.get(n, 0) + count * times
            offset += n * times
        sequence += count
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "times", "sequence", "offset"), table.T, strict=True))


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset; `cut_pieces` has to be a stored table."""
    spark = cut_pieces.sparkSession
    histogram = {r.length: r["count"] for r in cut_pieces.groupBy("length").count().collect()}
    where = spark.sparkContext.broadcast(places(plan(histogram, capacity)))
    rows = ranked(cut_pieces, ["length"], ["doc_id", "piece", "start", "ids_crc32"], "_rank")

    def run(batches):
        at = where.value
        stride = int(at["rank"].max(initial=0)) + 1
        keys = at["length"] * stride + at["rank"]
        for batch in batches:
            n = batch["length"].to_numpy()
            rank = batch["_rank"].to_numpy()
            i = np.searchsorted(keys, n * stride + np.minimum(rank, stride - 1), "right") - 1
            nth = rank - at["rank"][i]
            yield pa.record_batch(
                [*[batch[c] for c in names], pa.array(at["sequence"][i] + nth // at["times"][i]),
                 pa.array(at["offset"][i] + nth % at["times"][i] * n)],
                names=[*names, "sequence_id", "offset"])

    names = cut_pieces.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut_pieces.schema)
    return rows.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = CAPACITY, files=None, end: int = END) -> DataFrame:
    """Cut, plan and place all documents."""
    return pack(stored(pieces(docs, id_col, text_col, capacity, files, end)), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, pieces in order, length): what a loader writes out."""
    one = F.struct("offset", "doc_id", "piece", "start", "length")
    return packed.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(one)).alias("pieces"), F.sum("length").alias("n_tokens"))


def gaps_in(packed: DataFrame) -> DataFrame:
    """Rows that break the layout: a piece that does not start where the one before it ends."""
    before = Window.partitionBy("sequence_id").orderBy("offset")
    ends = F.coalesce(F.lag(F.col("offset") + F.col("length")).over(before), F.lit(0))
    return packed.withColumn("_ends", ends).filter("offset <> _ends").drop("_ends")
