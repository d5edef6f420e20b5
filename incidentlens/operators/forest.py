"""Forests as tables of nodes: exported, applied, given votes and weighed with joins.

A forest has one row per node: (tree, node, feature, cut, left_values, left, right, votes, gain, n). Node 0 is a
tree's root and trees count from 0. A split sends a row left if the value of its feature, the number of a name
in the list of features, is at most `cut`, or is among `left_values` where there are some; a missing value goes
right. A leaf has no children. `votes` are the shares of the classes among the rows a node was made from.

Rows are collapsed to distinct feature values before they meet a tree. They go down all trees at once by one join
a level; the splits are broadcast if they are few (checked), so that rows are shuffled for their sums only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_folder, stored
from .skew import is_small

NODES = ("tree int, node int, feature int, cut double, left_values array<double>, left int, right int, "
         "votes array<double>, gain double, n bigint")
MANY_SPLITS = 200_000


def exported(model) -> DataFrame:
    """Nodes of a fitted random forest, read back from what the library saves."""
    spark = SparkSession.getActiveSession()
    path = scratch_folder(spark, "forest")
    model.write().overwrite().save(path)
    node = F.col("nodeData")
    split, leaf = node["split"], node["leftChild"] < 0
    listed = split["numCategories"] >= 0
    total = F.aggregate(node["impurityStats"], F.lit(0.0), lambda a, v: a + v)
    inner = lambda c: F.when(~leaf, c)
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").cast("int").alias("tree"), node["id"].alias("node"),
        inner(split["featureIndex"]).alias("feature"),
        F.when(~leaf & ~listed, F.get(split["leftCategoriesOrThreshold"], F.lit(0))).alias("cut"),
        F.when(~leaf & listed, split["leftCategoriesOrThreshold"]).alias("left_values"),
        inner(node["leftChild"]).alias("left"), inner(node["rightChild"]).alias("right"),
        F.transform(node["impurityStats"], lambda v: v / total).alias("votes"),
        inner(node["gain"]).alias("gain"), F.round(total).cast("bigint").alias("n"))


def routed(rows: DataFrame, nodes: DataFrame, features, depth: int) -> DataFrame:
    """Rows with `tree` and `path`, the nodes from the root down: one row per row and tree.

    `depth` is the number of levels of splits; a row that has reached a leaf stays there.
    """
    trees = nodes.agg(F.max("tree") + 1).first()[0] or 0
    splits = nodes.filter(F.col("left").isNotNull()).select(
        F.col("tree").alias("_tree"), F.col("node").alias("_node"), "feature", "cut", "left_values", "left", "right")
    splits = F.broadcast(splits) if is_small(splits, MANY_SPLITS) else splits.hint("merge")
    names = list(rows.columns)
    values = F.array(*[F.col(f).cast("double") for f in features])
    # One entry per tree of the forest.
    down = rows.withColumn("_x", values).withColumn(
        "tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)) if trees else F.array().cast("array<int>")))
    down = down.withColumns({"_at": F.lit(0), "path": F.array(F.lit(0))})
    for _ in range(depth):
        x = F.get("_x", F.col("feature"))
        goes_left = F.coalesce(F.when(F.col("left_values").isNotNull(), F.array_contains("left_values", x))
                               .otherwise(x <= F.col("cut")), F.lit(False))
        met = down.join(splits, (F.col("tree") == F.col("_tree")) & (F.col("_at") == F.col("_node")), "left")
        to = F.when(goes_left, F.col("left")).otherwise(F.col("right"))
        down = met.select(*names, "_x", "tree", F.coalesce(to, "_at").alias("_at"), F.when(
            to.isNotNull(), F.array_append("path", to)).otherwise(F.col("path")).alias("path"))
    return down.select(*names, "tree", "path")


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def predictions(rows: DataFrame, nodes: DataFrame, features, depth: int, classes: int,
                out: str = "prediction") -> DataFrame:
    """Rows with the class of most votes, the lowest class on ties."""
    features = list(features)
    leaf = routed(rows.select(*features).distinct(), nodes, features, depth).withColumn("node", F.element_at("path", -1))
    votes = nodes.select("tree", "node", "votes")
    votes = F.broadcast(votes) if is_small(votes, 2 * MANY_SPLITS) else votes.hint("merge")
    sums = leaf.join(votes, ["tree", "node"]).groupBy(*features).agg(F.array(*[
        F.sum(F.get("votes", F.lit(i))) for i in range(classes)]).alias("_votes"))
    best = (F.array_position("_votes", F.array_max("_votes")) - 1).cast("double")
    found = sums.select(*[F.col(f).alias(f"_{f}") for f in features], best.alias(out))
    return rows.join(found, [_same(f, f"_{f}") for f in features], "left").select(*rows.columns, out)


def node_counts(rows: DataFrame, nodes: DataFrame, features, depth: int, label: str) -> DataFrame:
    """(tree, node, label, n): how many rows of each class pass each node."""
    few = rows.groupBy(*features, F.col(label).alias("_label")).agg(F.count("*").alias("_n"))
    return routed(few, nodes, features, depth).select(
        "tree", F.explode("path").alias("node"), F.col("_label").alias("label"), "_n").groupBy(
        "tree", "node", "label").agg(F.sum("_n").alias("n"))


def with_votes(nodes: DataFrame, counts: DataFrame, classes: int) -> DataFrame:
    """Nodes with votes, Gini gain and number of rows by `counts`, whose labels are 0 to classes - 1."""
    per = [F.sum(F.when(F.col("label") == i, F.col("n")).otherwise(0)) for i in range(classes)]
    found = counts.groupBy("tree", "node").agg(
        F.array(*[p / F.sum("n") for p in per]).alias("votes"), F.sum("n").alias("n"))
    kept = nodes.drop("votes", "gain", "n").join(found, ["tree", "node"], "left")
    gains = _gains(nodes, counts).select("tree", "node", (F.col("drop") / F.col("n")).alias("gain"))
    return kept.join(gains, ["tree", "node"], "left").select(
        "tree", "node", "feature", "cut", "left_values", "left", "right", "votes", "gain",
        F.coalesce("n", F.lit(0)).alias("n"))


def _gains(nodes: DataFrame, counts: DataFrame) -> DataFrame:
    """(tree, node, feature, n, drop): the fall in rows times Gini impurity at each split that rows pass."""
    n = F.sum("n")
    mass = stored(counts.groupBy("tree", "node").agg(
        n.alias("n"), (n - F.sum(F.col("n") * F.col("n")) / n).alias("mass")))
    child = lambda side: mass.select("tree", F.col("node").alias(side), F.col("mass").alias(f"_{side}"))
    splits = nodes.filter(F.col("left").isNotNull()).select("tree", "node", "feature", "left", "right")
    both = splits.join(mass, ["tree", "node"]).join(child("left"), ["tree", "left"], "left").join(
        child("right"), ["tree", "right"], "left")
    return both.select("tree", "node", "feature", "n", (F.col("mass") - F.coalesce("_left", F.lit(0.0))
                                                         - F.coalesce("_right", F.lit(0.0))).alias("drop"))


def _importance(drops: DataFrame, features) -> DataFrame:
    """(feature, importance) of (tree, feature, drop): shares within a tree, averaged and made to add up to 1."""
    whole = drops.groupBy("tree").agg(F.sum("drop").alias("_all")).filter(F.col("_all") > 0)
    shares = drops.join(whole, "tree").groupBy("feature").agg(F.sum(F.col("drop") / F.col("_all")).alias("s"))
    every = drops.sparkSession.createDataFrame(list(enumerate(features)), "feature int, name string")
    total = shares.agg(F.sum("s")).scalar()
    return every.join(shares, "feature", "left").select(
        F.col("name").alias("feature"), F.coalesce(F.col("s") / total, F.lit(0.0)).alias("importance"))


def importance(nodes: DataFrame, features) -> DataFrame:
    """Importance of each feature by the gains the forest was made with."""
    return _importance(nodes.filter(F.col("left").isNotNull()).select(
        "tree", "feature", (F.col("gain") * F.col("n")).alias("drop")), features)


def importance_for(rows: DataFrame, nodes: DataFrame, features, depth: int, label: str) -> DataFrame:
    """Importance of each feature by how much the forest's splits part the classes of these rows."""
    return _importance(_gains(nodes, node_counts(rows, nodes, features, depth, label)), features)
