"""Phrase collocations by prefix-free parsing.

A text is cut at triggers: runs of `longest - 1` words whose hash falls into one of `MODULUS` classes. A
chunk reaches from one trigger to the end of the next one, so neighbours overlap by the trigger, and equal
passages are cut into equal chunks whatever stands around them. Chunks become a dictionary with the number
of times each occurs in the parse; phrases are counted inside distinct chunks and weighted by it. A phrase
belongs to the chunk in which it starts before the closing trigger, so what lies in an overlap is counted
once and no phrase crosses a border uncounted.

Counting goes by length. Words and pairs are counted over the whole dictionary; for longer phrases only the
places are read at which both phrases shorter by a word are frequent. That is looked up in a bitmap of at
most `BITMAP` bits (8 MB), built from hashes of the frequent phrases: it may let through too much, never too
little, and counts are always of the phrases themselves. Copies are added up in each task before they are
shuffled, so a phrase, a passage or a language of any frequency is one row per task.

Defined results: a null text is empty, a null lang is `und`; empty texts add nothing; repeated rows count
each; a text of any length is read in parts of `PART_BYTES` that overlap like chunks do; ties stand in the
contract's order (score, a, phrase by its bytes); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import rank_within
from ..session import discard, stored
from .textarrays import LOWER, byte_class, chunks, gram_hashes, ranges, utf8, word_hashes, words

LONGEST, LEAST_COUNT, COVERED, TOP = 3, 10, 50, 2000
#: A trigger every so many words, and the most words between two cuts.
MODULUS, MOST_WORDS = 16, 1024
PART_BYTES = 1 << 20
COUNT_BYTES = 4 << 20
BITMAP = 1 << 26
SCALE = 1_000_000
BREAK = byte_class(b".,;:!?\n\v\f\r")
WORD = ~(BREAK | byte_class(b" \t"))
#: Inside a chunk: words of a piece stand apart by a space, pieces by a line feed.
CHUNK_WORD = ~byte_class(b" \n")


def _slices(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """The strings data[start[i]:start[i] + length[i]], which may overlap."""
    offsets = np.r_[0, np.cumsum(length)].astype(np.int64)
    flat = data[ranges(start, length)]
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(flat)).cast(pa.string())


def parts(data: np.ndarray, ahead: int, size: int = PART_BYTES):
    """(part of one text, bytes it owns): cuts lie between words, `ahead` words are looked at beyond."""
    at = 0
    while at < len(data):
        cut = at + size
        while cut < len(data) and WORD[data[cut]]:
            blank = np.flatnonzero(~WORD[data[cut:cut + size]])
            cut += int(blank[0]) if len(blank) else size
        if cut >= len(data):
            yield data[at:], len(data) - at
            return
        reach = 64 * ahead
        while True:
            behind = data[cut:cut + reach]
            w = words(behind, np.array([0, len(behind)]), WORD)
            # The last word may go on beyond what is looked at.
            if cut + reach >= len(data) or len(w.end) > ahead:
                break
            reach *= 4
        end = cut + (int(w.end[ahead - 1]) if len(w.end) >= ahead else len(behind))
        yield data[at:end], cut - at
        at = cut


def parse(data: np.ndarray, offsets: np.ndarray, owned: np.ndarray, longest: int = LONGEST,
          modulus: int = MODULUS, most: int = MOST_WORDS) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(chunk, words it owns, its text) of lower-case texts; text t owns its first owned[t] bytes."""
    overlap = longest - 1
    w = words(data, offsets, WORD)
    n = len(w.start)
    if not n:
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = w.text_of()
    mine = w.start < (offsets[:-1] + owned)[text]
    length = w.end - w.start
    place = np.cumsum(length + 1) - (length + 1)
    flat = np.full(int(place[-1] + length[-1] + 1), 0x20, np.uint8)
    inside = np.flatnonzero(WORD[data])
    flat[inside + np.repeat(place - w.start, length)] = data[inside]
    piece = np.searchsorted(np.flatnonzero(BREAK[data]), w.start)
    parted = np.r_[piece[1:] != piece[:-1], True]
    flat[(place + length)[parted]] = 0x0A

    last = w.first[1:][text]
    trigger = np.zeros(n, bool)
    h = gram_hashes(word_hashes(w), overlap)
    trigger[:len(h)] = h % np.uint64(modulus) == 0
    index = np.arange(n)
    trigger &= mine & (index + overlap <= last)
    trigger[w.first[:-1][w.per_text > 0]] = True
    trigger |= mine & ((index - w.first[:-1][text]) % most == 0)
    begin = np.flatnonzero(trigger)
    # A chunk owns the words up to the next one, or to the last word that its text owns.
    n_mine = np.bincount(text[mine], minlength=len(w.first) - 1)
    following = np.r_[begin[1:], n]
    own_end = np.minimum(following, (w.first[:-1] + n_mine)[text[begin]])
    some = own_end > begin
    begin, own_end = begin[some], own_end[some]
    end = np.minimum(own_end + overlap, last[begin])
    strings = _slices(flat, place[begin], place[end - 1] + length[end - 1] - place[begin])
    return strings, own_end - begin, text[begin]


def dictionary(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST,
               modulus: int = MODULUS) -> DataFrame:
    """(lang, chunk, own, n): the distinct chunks of a language's parse and how often each occurs; `own` is the
    number of leading words at which phrases of this chunk start. A stored table."""

    def run(batches):
        for table in chunks(batches, "text", PART_BYTES):
            data, offsets = utf8(table["text"])
            data = LOWER[data]
            if len(data) > PART_BYTES and table.num_rows == 1:
                units = ((d, np.array([0, len(d)]), np.array([own])) for d, own in parts(data, longest - 1))
            else:
                units = [(data, offsets, np.diff(offsets))]
            langs = table["lang"].combine_chunks()
            for unit in units:
                strings, own, text = parse(*unit, longest, modulus)
                yield pa.RecordBatch.from_arrays(
                    [langs.take(pa.array(text)), strings, pa.array(own, pa.int32())], names=["lang", "chunk", "own"])

    found = docs.select(F.coalesce(lang_col, F.lit("und")).alias("lang"), F.col(text_col).alias("text")).filter(
        "text is not null").mapInArrow(run, "lang string, chunk string, own int")
    return stored(found.groupBy("lang", "chunk", "own").agg(F.count("*").alias("n")))


def _gathered(batches, size: int):
    """Tables of several batches, about `size` bytes each."""
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += batch.nbytes
        if total >= size:
            yield pa.Table.from_batches(held).combine_chunks()
            held, total = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _sums(keys: np.ndarray, weight: np.ndarray):
    """(one place of each distinct key, the sum of its weights)."""
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    first = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])
    return order[first], np.add.reduceat(weight[order], first)


def _bits(hashes: np.ndarray, size: int):
    """Words and masks of a bitmap of `size` bits (a power of two)."""
    at = hashes >> np.uint64(65 - size.bit_length())
    return (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))


def grams(table: pa.Table, lengths: list[int], frequent: np.ndarray | None = None) -> list[pa.RecordBatch]:
    """(lang, words, phrase, n): phrases of the given lengths inside the chunks of a table, added up.

    With `frequent`, a bitmap of phrases one word shorter than the only length given, places at which one of
    the two is not in it are left out."""
    data, offsets = utf8(table["chunk"])
    w = words(data, offsets, CHUNK_WORD)
    n = len(w.start)
    chunk = w.text_of()
    own = np.arange(n) - w.first[:-1][chunk] < table["own"].to_numpy()[chunk]
    weight = table["n"].to_numpy()[chunk]
    spelled = _slices(data, w.start, w.end - w.start).dictionary_encode()
    code, n_codes = spelled.indices.to_numpy().astype(np.int64), max(len(spelled.dictionary), 1)
    lang = table["lang"].combine_chunks().dictionary_encode()
    # Whether the next word follows in the same piece.
    joined = np.zeros(n, bool)
    joined[:-1] = (chunk[1:] == chunk[:-1]) & (data[np.minimum(w.end[:-1], len(data) - 1)] == 0x20)
    key = lang.indices.to_numpy().astype(np.int64)[chunk] * n_codes + code
    whole = np.ones(n, bool)
    out = []
    for size in range(1, max(lengths) + 1):
        if size > 1:
            whole = whole[:-1] & joined[size - 2:n - 1][:len(whole) - 1] if n >= size else whole[:0]
            key = np.unique(key[:len(whole)], return_inverse=True)[1] * n_codes + code[size - 1:n]
        if size not in lengths or not len(whole):
            continue
        here = whole & own[:len(whole)]
        if frequent is not None:
            block, mask = _bits(gram_hashes(word_hashes(w), size - 1), 64 * len(frequent))
            known = (frequent[block] & mask) != 0
            here &= known[:len(whole)] & known[1:len(whole) + 1]
        at = np.flatnonzero(here)
        if not len(at):
            continue
        first, total = _sums(key[at], weight[at])
        first = at[first]
        phrase = _slices(data, w.start[first], w.end[first + size - 1] - w.start[first])
        out.append(pa.RecordBatch.from_arrays(
            [lang.dictionary.take(lang.indices.take(pa.array(chunk[first]))),
             pa.array(np.full(len(first), size), pa.int32()), phrase, pa.array(total, pa.int64())],
            names=["lang", "words", "phrase", "n"]))
    return out


def _counted(parsed: DataFrame, lengths: list[int], least: int, frequent: np.ndarray | None = None) -> DataFrame:
    """(lang, words, phrase, n) of the phrases that occur `least` times; a stored table."""
    held = None if frequent is None else parsed.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        for table in _gathered(batches, COUNT_BYTES):
            yield from grams(table, lengths, None if held is None else held.value)

    found = parsed.mapInArrow(run, "lang string, words int, phrase string, n long")
    return stored(found.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= least))


def bitmap(phrases: DataFrame, length: int, most: int = BITMAP) -> np.ndarray:
    """The bitmap of a table's phrases of `length` words, about 16 bits to a phrase and `most` at most; the driver
    gets its words that are not zero."""
    n = phrases.count()
    size = max(64, min(most, 1 << (16 * n).bit_length()))

    def run(batches):
        for table in _gathered(batches, COUNT_BYTES):
            data, offsets = utf8(table["phrase"])
            w = words(data, offsets, CHUNK_WORD)
            at, mask = _bits(gram_hashes(word_hashes(w), length)[w.first[:-1]], size)
            order = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.r_[True, at[order][1:] != at[order][:-1]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(at[order][first]), pa.array(np.bitwise_or.reduceat(mask[order], first).view(np.int64))],
                names=["at", "bits"])

    rows = phrases.select("phrase").mapInArrow(run, "at long, bits long").groupBy("at").agg(
        F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(size // 64, np.uint64)
    out[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def phrase_counts(parsed: DataFrame, longest: int = LONGEST, least: int = LEAST_COUNT,
                  most_bits: int = BITMAP) -> DataFrame:
    """(lang, words, phrase, n) of all phrases of up to `longest` words that occur `least` times."""
    out = level = _counted(parsed, [1, 2][:longest], least)
    for size in range(3, longest + 1):
        shorter = level.filter(F.col("words") == size - 1)
        level = _counted(parsed, [size], least, bitmap(shorter, size - 1, most_bits))
        out = out.unionByName(level)
    return out


def scored(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, words, phrase, a, l, r, n, score) of all phrases of two words and more.

    The lowest-scoring cut counts; products are decimals of 38 digits, exact up to 10^15 words."""
    cuts = counts.filter("words > 1").select(
        "lang", "words", "phrase", F.col("n").alias("a"),
        F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn(
        "right", F.expr("substr(phrase, length(left) + 2)"))
    known = counts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    sides = cuts.join(known, ["lang", "left"]).join(
        known.select("lang", F.col("left").alias("right"), F.col("l").alias("r")), ["lang", "right"])
    wide = "cast({} as decimal(16, 0))".format
    score = F.expr(f"cast({SCALE} as decimal(7, 0)) * ({wide('a')} * {wide('a')}) div ({wide('l')} * {wide('r')})")
    best = sides.withColumn("score", score).groupBy("lang", "words", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return best.join(totals, "lang").select("lang", "words", "phrase", "a", "best.l", "best.r", "n", "best.score")


def uncovered(found: DataFrame, covered: int = COVERED) -> DataFrame:
    """Without the phrases that stand in a longer one with `covered` percent of their count or more."""
    inner = found.filter("words > 2").select(
        "lang", "words", F.col("a").alias("longer"), F.split("phrase", " ").alias("w")).select(
        "lang", "longer", "w", F.explode(F.expr(
            "flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1),"
            " i -> array_join(slice(w, i, m), ' '))))")).alias("phrase"))
    most = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return found.join(most, ["lang", "phrase"], "left").filter(
        f"longer is null or 100 * longer < {covered} * a").drop("longer")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST,
                 least: int = LEAST_COUNT, covered: int = COVERED, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases."""
    parsed = dictionary(docs, lang_col, text_col, longest)
    totals = stored(parsed.groupBy("lang").agg(F.sum(F.col("own") * F.col("n")).alias("n")))
    counts = phrase_counts(parsed, longest, least)
    found = stored(scored(counts, totals))
    discard(parsed)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    ranked = rank_within(uncovered(found, covered), ["lang"], order, "rank").filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
