"""Language ID as a mixture: each document's language proportions by expectation-maximisation.

Training counts hashed byte trigrams per language over all given documents; the table has `BINS`
numbers per language. A document is then a mixture of those distributions. EM estimates its
proportions, and the set of languages is chosen by penalised likelihood: starting from all, the
language with the smallest share is dropped as long as the log-likelihood falls by less than the
penalty of one parameter. The largest share of the chosen set is the prediction, and its size the
score. Documents are independent, so predicting shuffles nothing; a step handles a few megabytes of
texts as one matrix.

Defined results: a null text, or one without a letter, is `und` with score 0; with no learned language
everything is `und`; of languages that explain a text equally well the one that sorts first is dropped
first, and equal shares of those that stay go to the first of them; repeated rows are answered each;
rows without an id are predicted, never learned from. Only text and lang are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textarrays import chunks

BINS = 4096
SMOOTHING = 0.5
STEPS = 12
FULL_STEPS = 25
#: Every character is in three trigrams, so the evidence counts about three times.
PENALTY = 3.0
UNKNOWN = "und"
STEP_BYTES = 2 << 20
#: Rows that one matrix of counts holds at most.
STEP_ROWS = 1000
#: The letter categories, so no digit or number of any script.
LETTER = regex.compile(r"\p{L}")

#: Each byte's class: letters and all bytes beyond ASCII are themselves, everything else is a gap.
_CLASS = np.zeros(256, np.uint32)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


def trigram_counts(texts: list[str | None]) -> np.ndarray:
    """(texts, BINS) counts of hashed trigrams of lower-cased bytes; runs of non-letters are one gap."""
    coded = [(t or "").lower().encode() for t in texts]
    size = np.array([len(c) for c in coded], np.int64)
    symbol = _CLASS[np.frombuffer(b"".join(coded), np.uint8)]
    text = np.repeat(np.arange(len(coded), dtype=np.int64), size)
    keep = np.ones(len(symbol), bool)
    keep[1:] = (symbol[1:] > 0) | (symbol[:-1] > 0) | (text[1:] != text[:-1])
    symbol, text = symbol[keep], text[keep]
    if len(symbol) < 3:
        return np.zeros((len(coded), BINS), np.float32)
    h = (symbol[:-2] * np.uint32(0x9E3779B1)) ^ (symbol[1:-1] * np.uint32(0x85EBCA77)) ^ (
        symbol[2:] * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    bins = (h >> np.uint32(20)).astype(np.int64) % BINS
    whole = text[:-2] == text[2:]
    flat = np.bincount(text[:-2][whole] * BINS + bins[whole], minlength=len(coded) * BINS)
    return flat.reshape(len(coded), BINS).astype(np.float32)


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text"):
    """(languages, probabilities[language, bin]) from all rows with a language and a text."""
    def count(batches):
        total: dict[str, np.ndarray] = {}
        for table in chunks(batches, "text", STEP_BYTES, STEP_ROWS):
            langs = np.array(table["lang"].to_pylist(), object)
            counts = trigram_counts(table["text"].to_pylist())
            for lang in set(langs.tolist()):
                total[lang] = total.get(lang, 0) + counts[langs == lang].sum(0, dtype=np.float64)
        for lang, sums in total.items():
            yield pa.record_batch([pa.array([lang] * BINS), pa.array(np.arange(BINS), pa.int32()),
                                   pa.array(sums.astype(np.int64))], names=["lang", "bin", "n"])

    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter(
        "lang is not null and text is not null")
    table = (rows.mapInArrow(count, "lang string, bin int, n long")
             .groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas())
    languages = sorted(table["lang"].unique())
    counts = np.zeros((len(languages), BINS))
    counts[np.searchsorted(languages, table["lang"].to_numpy()) if languages else [], table["bin"]] = table["n"]
    smooth = counts + SMOOTHING
    return languages, smooth / smooth.sum(1, keepdims=True)


def mixture(counts: np.ndarray, probability: np.ndarray, shares: np.ndarray, steps: int):
    """EM for all rows at once: (shares, log-likelihood). A share of zero stays zero."""
    p = probability.astype(np.float32)
    total = np.maximum(counts.sum(1, keepdims=True), 1)
    shares = shares.astype(np.float32)
    for _ in range(steps):
        weight = counts / np.maximum(shares @ p, 1e-30)
        shares = shares * (weight @ p.T) / total
        shares /= np.maximum(shares.sum(1, keepdims=True), 1e-30)
    return shares, (counts * np.log(np.maximum(shares @ p, 1e-30))).sum(1, dtype=np.float64)


def choose(counts: np.ndarray, probability: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Shares over the language set that penalised likelihood selects, per row."""
    n_rows, n_languages = len(counts), len(probability)
    start = np.full((n_rows, n_languages), 1 / n_languages, np.float32)
    shares, fit = mixture(counts, probability, start, FULL_STEPS)
    price = penalty * 0.5 * np.log(np.maximum(counts.sum(1), 2))
    live = np.arange(n_rows)
    for _ in range(n_languages - 1):
        several = (shares[live] > 0).sum(1) > 1
        live = live[several]
        if not len(live):
            break
        tried = shares[live].copy()
        smallest = np.where(tried > 0, tried, np.inf).argmin(1)
        tried[np.arange(len(live)), smallest] = 0
        tried /= tried.sum(1, keepdims=True)
        tried, less = mixture(counts[live], probability, tried, STEPS)
        better = fit[live] - less < price[live]
        shares[live[better]], fit[live[better]] = tried[better], less[better]
        live = live[better]
    return shares


def predict(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text",
            penalty: float = PENALTY) -> DataFrame:
    """(doc_id, lang_pred, score, languages): languages lists the chosen set with its shares."""
    languages, probability = model
    held = docs.sparkSession.sparkContext.broadcast(probability)
    kind = docs.schema[id_col].dataType.simpleString()
    share_type = pa.struct([("lang", pa.string()), ("share", pa.float64())])

    def run(batches):
        for table in chunks(batches, "text", STEP_BYTES, STEP_ROWS):
            texts = table["text"].to_pylist()
            known = [bool(languages and t and LETTER.search(t)) for t in texts]
            at = np.flatnonzero(known)
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            mixes: list = [[] for _ in texts]
            if len(at):
                shares = choose(trigram_counts([texts[i] for i in at]), held.value, penalty)
                best = shares.argmax(1)
                score[at] = np.clip(shares[np.arange(len(at)), best], 0, 1)
                for i, b, row in zip(at.tolist(), best.tolist(), shares.tolist(), strict=True):
                    lang[i] = languages[b]
                    mixes[i] = [{"lang": languages[k], "share": v} for k, v in enumerate(row) if v > 0]
            yield pa.record_batch([table["doc_id"].combine_chunks(), pa.array(lang), pa.array(score),
                                   pa.array(mixes, pa.list_(share_type))],
                                  names=["doc_id", "lang_pred", "score", "languages"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double, languages array<struct<lang:string,share:double>>")


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus
