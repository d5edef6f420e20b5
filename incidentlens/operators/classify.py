"""Offense classifier on position, its report per class, and importance from a fitted model."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stats

#: Training rows that one task of a forest takes.
ROWS_PER_TASK = 100_000


def split_by_hash(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 42):
    """Train and test rows by a hash of the key: the same split on every run and cluster."""
    bucket = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000))
    cut = int(test_share * 1_000)
    return df.filter(bucket >= cut), df.filter(bucket < cut)


def only_top(df: DataFrame, value: str, k: int) -> DataFrame:
    # k rows at most on the right side.
    return df.join(F.broadcast(stats.top_overall(df, value, k)), value, "left_semi")


def dealt(rows: DataFrame, order, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Rows in equal parts, sorted within each; as they are, if one task can take them all.

    A forest keeps the parts its rows come in through all passes, and files may come as a few large ones.
    """
    parts = -(-rows.count() // rows_per_task)
    return rows if parts <= 1 else rows.repartition(parts).sortWithinPartitions(*order)


def fit_offense_model(incidents: DataFrame, features=("latitude", "longitude"),
                      label: str = "crime_type", top: int = 5, key: str = "incident_id",
                      trees: int = 100, depth: int = 10, seed: int = 42):
    """(model, test predictions) of a random forest for the commonest offenses."""
    rows = only_top(incidents.na.drop(subset=[*features, label]), label, top)
    train, test = split_by_hash(rows, key, seed=seed)
    used = [key, *features, label]
    train = dealt(train.select(*used), used)
    stages = [
        StringIndexer(inputCol=label, outputCol="label", stringOrderType="frequencyDesc",
                      handleInvalid="skip"),
        VectorAssembler(inputCols=list(features), outputCol="features"),
        RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed),
    ]
    model = Pipeline(stages=stages).fit(train)
    return model, model.transform(test)


def class_report(predictions: DataFrame, labels) -> DataFrame:
    """Precision, recall, F1 and support of each class."""
    names = F.array(*[F.lit(v) for v in labels])
    pairs = predictions.groupBy("label", "prediction").agg(F.count("*").alias("n"))
    sides = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("actual"),
                 F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
                 .alias("right")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("actual"),
                 F.col("n").alias("predicted"), F.lit(0).cast("long").alias("right")))
    sums = pairs.select(F.inline(sides)).groupBy("class").agg(
        F.sum("actual").alias("support"), F.sum("predicted").alias("predicted"),
        F.sum("right").alias("right"))
    precision = F.when(F.col("predicted") > 0, F.col("right") / F.col("predicted")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("right") / F.col("support")).otherwise(0.0)
    out = sums.select(F.get(names, F.col("class").cast("int")).alias("crime_type"),
                      precision.alias("precision"), recall.alias("recall"), "support")
    total = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(
        total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0))


def tree_importance(incidents: DataFrame, categorical, numeric, label: str = "crime_category",
                    trees: int = 20, depth: int = 5, seed: int = 42) -> DataFrame:
    """Importance of each feature in a random forest for the label, largest first."""
    rows = incidents.na.drop(subset=[*numeric, label]).fillna("MISSING", list(categorical))
    indexed = [f"{c}_index" for c in categorical]
    # A tree needs as many bins as the longest list of values.
    longest = rows.agg(*[F.count_distinct(c) for c in categorical]).first() if categorical else [0]
    stages = [
        StringIndexer(inputCols=[*categorical, label], outputCols=[*indexed, "label"]),
        VectorAssembler(inputCols=[*numeric, *indexed], outputCol="features"),
        RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, maxBins=max(256, *longest)),
    ]
    model = Pipeline(stages=stages).fit(rows)
    weights = model.stages[-1].featureImportances.toArray()
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(float(w)).alias("importance"))
                      for n, w in zip([*numeric, *categorical], weights)])
    # One row per feature, next to the number of rows the model was fitted on.
    return rows.agg(F.count("*").alias("rows")).select("rows", F.inline(pairs))
