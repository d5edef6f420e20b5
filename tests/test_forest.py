import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler, StringIndexer
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from incidentlens.operators import forest

FEATURES = ["x", "y", "kind_index"]


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(2)
    at = np.round(rng.uniform(0, 1, (900, 2)), 2)
    kind = rng.integers(0, 5, 900)
    label = np.where(kind > 2, 2, (at[:, 0] + at[:, 1] > 1) * 1) * (rng.uniform(size=900) > 0.1)
    rows = spark.createDataFrame([(float(a), float(b), f"k{k}", float(c)) for (a, b), k, c in zip(at, kind, label)],
                                 "x DOUBLE, y DOUBLE, kind STRING, label DOUBLE")
    model = Pipeline(stages=[
        StringIndexer(inputCol="kind", outputCol="kind_index"), VectorAssembler(inputCols=FEATURES, outputCol="features"),
        RandomForestClassifier(numTrees=7, maxDepth=4, seed=3)]).fit(rows)
    return model, model.transform(rows).drop("features")


def test_exported_forest_scores_alike(spark, fitted):
    model, rows = fitted
    last = model.stages[-1]
    nodes = forest.exported(last)
    assert nodes.count() == last.totalNumNodes
    assert nodes.filter("left_values IS NOT NULL").count() > 0 and nodes.filter("cut IS NOT NULL").count() > 0
    twice = rows.select("x", "y", "kind_index", F.col("prediction").alias("want")).unionByName(
        rows.select("x", "y", "kind_index", F.col("prediction").alias("want")))
    made = forest.predictions(twice, nodes, FEATURES, 4, 3)
    assert made.count() == 1800 and made.filter("NOT prediction <=> want").count() == 0


def test_importance_of_an_exported_forest(spark, fitted):
    last = fitted[0].stages[-1]
    got = {r.feature: r.importance for r in forest.importance(forest.exported(last), FEATURES).collect()}
    assert [got[f] for f in FEATURES] == pytest.approx(last.featureImportances.toArray().tolist(), abs=1e-9)


def given(spark):
    rows = [(0, 0, 0, 0.5, None, 1, 2), (0, 1, None, None, None, None, None), (0, 2, 1, None, [0.0, 2.0], 3, 4),
            (0, 3, None, None, None, None, None), (0, 4, None, None, None, None, None)]
    return spark.createDataFrame(rows, "tree INT, node INT, feature INT, cut DOUBLE, left_values ARRAY<DOUBLE>, left INT, right INT")


def test_given_nodes_routes_votes_and_importance(spark):
    data = [(0.1, 0.0, 0), (0.5, 1.0, 0), (0.9, 0.0, 1), (0.9, 2.0, 1), (0.9, 2.0, 0), (0.8, 1.0, 0), (None, None, 1)]
    rows = spark.createDataFrame(data, "a DOUBLE, b DOUBLE, label INT")
    nodes = given(spark)
    paths = {(r.a, r.b): r.path for r in forest.routed(rows, nodes, ["a", "b"], 2).collect()}
    assert paths == {(0.1, 0.0): [0, 1], (0.5, 1.0): [0, 1], (0.9, 0.0): [0, 2, 3], (0.9, 2.0): [0, 2, 3],
                     (0.8, 1.0): [0, 2, 4], (None, None): [0, 2, 4]}
    counts = forest.node_counts(rows, nodes, ["a", "b"], 2, "label")
    assert {(r.node, r.label): r.n for r in counts.collect()} == {
        (0, 0): 4, (0, 1): 3, (1, 0): 2, (2, 0): 2, (2, 1): 3, (3, 0): 1, (3, 1): 2, (4, 0): 1, (4, 1): 1}
    voting = forest.with_votes(nodes, counts, 2)
    assert {r.node: r.n for r in voting.collect()} == {0: 7, 1: 2, 2: 5, 3: 3, 4: 2}
    made = forest.predictions(rows, voting, ["a", "b"], 2, 2).collect()
    # Node 4 holds one row of each class: the lower class wins the tie.
    assert [r.prediction for r in sorted(made, key=lambda r: data.index((r.a, r.b, r.label)))] == [0, 0, 1, 1, 1, 0, 0]
    gini = lambda *n: sum(n) - sum(v * v for v in n) / sum(n)
    drops = [gini(4, 3) - gini(2) - gini(2, 3), gini(2, 3) - gini(1, 2) - gini(1, 1)]
    got = {r.feature: r.importance for r in forest.importance_for(rows, nodes, ["a", "b"], 2, "label").collect()}
    assert [got["a"], got["b"]] == pytest.approx([v / sum(drops) for v in drops])
    assert {r.feature: r.importance for r in forest.importance(voting, ["a", "b"]).collect()} == pytest.approx(got)


def test_empty_rows_and_empty_forests(spark):
    rows = spark.createDataFrame([], "a DOUBLE, b DOUBLE, label INT")
    nodes = given(spark)
    assert forest.predictions(rows, forest.with_votes(nodes, forest.node_counts(rows, nodes, ["a", "b"], 2, "label"), 2),
                              ["a", "b"], 2, 2).count() == 0
    one = spark.createDataFrame([(0.1, 0.2, 1)], "a DOUBLE, b DOUBLE, label INT")
    assert forest.routed(one, nodes.limit(0), ["a", "b"], 2).count() == 0
    assert {r.importance for r in forest.importance_for(one, nodes, ["a", "b"], 2, "label").collect()} == {0.0}
