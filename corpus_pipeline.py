"""The corpus pipeline: from raw documents to packed training sequences.

Five stages, each one of the corpus operators over all that the stage before it kept. A stage takes
(spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.

1. quality classifier: documents that the compiled rules score below the threshold go;
2. line dedup: lines on more than a twentieth of a source's documents are cut out of them;
3. SimHash near-dedup: of each component the document with the smallest id stays;
4. benchmark decontamination: documents in which a window of a benchmark item stands go;
5. best-fit packing: the rest is tokenised, cut and packed.

An empty table passes through all stages as an empty table. How nulls, empty texts and repeated rows are
treated stands with each operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incidentlens.llm import (
    decontaminate,
    language_mixture,
    line_frequency,
    packing,
    quality_rules,
    simhash_trees,
)
from incidentlens.session import ROWS_BROADCAST, prepare, scratch_folder

#: Sources hold far more pages than a site does, so a line is boilerplate at a smaller share.
SOURCE_RATIO = 0.05
BATCH_ROWS = "1000"
#: SQL has no forests, fingerprints or tokenizers; the stages are tested one by one instead.
ORACLE_SQL = None


def _settings(spark: SparkSession) -> None:
    prepare(spark, ROWS_BROADCAST)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _settings(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.keep_good(docs, labels, language_mixture.remainder("doc_id", 5) != 0)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _settings(spark)
    out = line_frequency.drop_frequent_lines(docs, F.col("source"), F.col("text"), ratio=SOURCE_RATIO)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _settings(spark)
    return simhash_trees.keep_representatives(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _settings(spark)
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _settings(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; the stages' tables go to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_folder(spark, name.replace(" ", "-"))
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
