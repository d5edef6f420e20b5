"""The pipeline's stages one by one against their own operators' definitions."""

import re

import corpus_pipeline
from incidentlens.llm import decontaminate, language_mixture, packing, quality_rules
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def test_stages(corpus, tmp_path):
    raw = corpus.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    labels = corpus.read.parquet(f"{DATA}/labels.parquet")
    good = {r.doc_id for r in quality_rules.score_documents(
        raw, labels, language_mixture.remainder("doc_id", 5) != 0).filter("predicted = 1").collect()}
    docs, out = raw, {}
    for name, stage in stages.items():
        docs = stage(corpus, docs, DATA)
        docs.write.parquet(str(tmp_path / name))
        docs = corpus.read.parquet(str(tmp_path / name))
        out[name] = docs.collect()
        if name != "best-fit packing":
            assert docs.columns == raw.columns
    names = list(stages)
    assert {r.doc_id for r in out[names[0]]} == good
    assert len(out[names[1]]) == len(out[names[0]])
    assert all(r.n_chars == len(r.text) for r in out[names[1]])
    kept = {r.doc_id for r in out[names[2]]}
    assert len(kept) == len(out[names[2]]) and kept <= good
    items = [r.text for r in corpus.read.parquet(f"{DATA}/benchmark.parquet").collect()]

    def grams(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {" ".join(w[i:i + 10]) for i in range(max(1, len(w) - 9))} if w else set()

    banned = set().union(*(grams(t) for t in items))
    clean = {r.doc_id for r in out[names[2]] if not grams(r.text) & banned}
    assert {r.doc_id for r in out[names[3]]} == clean
    encode = packing.Encoder(*packing.vocabulary())
    lengths = {r.doc_id: len(encode(r.text or "")) + 1 for r in out[names[3]]}
    packed = {}
    for r in out[names[4]]:
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.length
    assert packed == lengths
    assert decontaminate.WINDOW == 10


def test_empty_documents(corpus):
    docs = corpus.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(corpus, docs, DATA)
        assert out.count() == 0
        docs = out


def test_nulls_and_repeated_rows_pass_through(corpus):
    raw = corpus.read.parquet(f"{DATA}/documents.parquet").limit(30)
    odd = corpus.createDataFrame([(9001, None, None, None, None), (9002, "", "en", None, 0),
                                  (None, "no id", "en", "s", 5), (9002, "other", "en", "s", 5)], raw.schema)
    docs = raw.unionByName(odd).unionByName(raw.limit(3)).withColumn("host", F.lit("x")).withColumn("row", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = stage(corpus, docs, DATA)
        assert name == "best-fit packing" or docs.columns == columns
        docs = corpus.createDataFrame(docs.collect(), docs.schema)
    assert docs.count() > 0
