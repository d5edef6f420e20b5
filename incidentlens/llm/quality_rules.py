"""Quality classifier: a sparse ensemble of rules, compiled to column expressions.

Statistics of each text are column expressions. A random forest of shallow trees is grown on labelled
rows; every path from a root to a node is a conjunction of thresholds, a rule. A lasso logistic
regression on the rules keeps few of them, and these become one Spark expression: scoring needs no
model object, no Python and no shuffle.

The fit reads at most about `MAX_LABELLED` labelled rows, chosen by a hash of the id; all else covers
every row.

Defined results: a null text counts as empty; empty texts get a score like any other; labels other than
0 and 1 are not learned from; with no labelled rows the score is 0.5, with one class only its share;
repeated rows are scored each, equal texts alike; a repeated label row counts twice. A text is one value; its
statistics take a few copies of it.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

MAX_LABELLED = 20_000
N_TREES = 16
DEPTH = 3
LASSO = 0.0005
THRESHOLD = 0.3
SEED = 7


def statistics(text: Column) -> dict[str, Column]:
    """Numbers that describe a text; all are defined for empty texts."""
    text = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda s: s != "")

    def share(pattern):
        return F.length(F.regexp_replace(text, pattern, "")) / n

    n_words = F.greatest(F.size(words), F.lit(1)).cast("double")
    return {
        "length": F.log1p(F.length(text).cast("double")),
        "words": F.log1p(F.size(words).cast("double")),
        "word_length": F.length(text) / n_words,
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "distinct_lines": F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)),
        "words_per_line": n_words / F.greatest(F.size(lines), F.lit(1)),
        "upper": share(r"[^\p{Lu}]+"),
        "symbols": share(r"[\p{L}\p{M}\p{N}\s.,;:'\"()\-]+"),
        "digits": share(r"[^0-9]+"),
        "stops": share(r"[^.,;:]+"),
    }


FEATURES = ["length", "words", "word_length", "distinct_words", "distinct_lines", "words_per_line",
            "upper", "symbols", "digits", "stops"]


@dataclass(frozen=True)
class Rule:
    """Conditions (feature number, is_above, threshold) that all have to hold."""

    conditions: tuple[tuple[int, bool, float], ...]

    def column(self, value) -> Column:
        """The rule as a condition; value(feature number) is that statistic's column."""
        out = F.lit(True)
        for feature, above, threshold in self.conditions:
            out = out & (value(feature) > threshold if above else value(feature) <= threshold)
        return out


def rules_of(tree_text: str) -> list[Rule]:
    """Every path of the trees in Spark's description of a forest, without the empty one."""
    path: list[tuple[int, bool, float]] = []
    found = []
    for line in tree_text.splitlines():
        m = re.match(r"(\s*)(If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if re.match(r"\s*Tree \d+", line):
            path, base = [], None
        elif m:
            indent = len(m[1])
            base = indent if base is None else base
            del path[indent - base:]
            path.append((int(m[3]), m[4] == ">", float(m[5])))
            found.append(Rule(_tightest(path)))
    return list(dict.fromkeys(found))


def _tightest(path):
    """Conditions on one feature and side merged into the strictest."""
    limits: dict[tuple[int, bool], float] = {}
    for feature, above, threshold in path:
        key = feature, above
        limits[key] = (max if above else min)(limits.get(key, threshold), threshold)
    return tuple((f, a, t) for (f, a), t in sorted(limits.items()))


@dataclass
class RuleModel:
    rules: list[Rule]
    weights: list[float]
    intercept: float

    def score(self, value) -> Column:
        """Probability of label 1 as a column expression."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            total = total + F.when(rule.column(value), F.lit(weight)).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


def fit(labelled: DataFrame, n_trees: int = N_TREES, depth: int = DEPTH, lasso: float = LASSO) -> RuleModel:
    """A model for (stats array<double>, label) rows, already bounded."""
    counts = {r.label: r["count"] for r in labelled.groupBy("label").count().collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        share = counts.get(1.0, 0) / total if total else 0.5
        return RuleModel([], [], math.log((share + 1e-6) / (1 - share + 1e-6)))
    rows = labelled.select(array_to_vector("stats").alias("features"), "label", "stats")
    forest = RandomForestClassifier(numTrees=n_trees, maxDepth=depth, seed=SEED, maxBins=64,
                                    subsamplingRate=0.8, minInstancesPerNode=10).fit(rows)
    rules = rules_of(forest.toDebugString)
    if not rules:
        share = counts.get(1.0, 0) / total
        return RuleModel([], [], math.log(share / (1 - share)))
    held = F.array(*[F.when(r.column(lambda f: F.col("stats")[f]), 1.0).otherwise(0.0) for r in rules])
    table = stored(rows.select(held.alias("held"), "label"))
    lasso_fit = LogisticRegression(featuresCol="held_vector", regParam=lasso, elasticNetParam=1.0,
                                   standardization=False, maxIter=200).fit(
        table.select(array_to_vector("held").alias("held_vector"), "label"))
    kept = [(r, float(w)) for r, w in zip(rules, lasso_fit.coefficients.toArray(), strict=True) if abs(w) > 1e-9]
    return RuleModel([r for r, _ in kept], [w for _, w in kept], float(lasso_fit.intercept))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stats): the only pass over the texts."""
    values = statistics(F.col(text_col))
    return docs.select(F.col(id_col).alias("doc_id"), F.array(
        *[values[name].cast("double") for name in FEATURES]).alias("stats"))


def fit_on(stats: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id",
           label_col: str = "quality", max_labelled: int = MAX_LABELLED, **options) -> RuleModel:
    """Fit on labelled rows for which `learn` (over the id, named doc_id) holds; `stats` is stored."""
    labels = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("label")).filter(
        "doc_id is not null and label in (0, 1)").filter(learn)
    n = labels.count()
    parts = 1 << 20
    share = max(1, int(parts * min(1.0, max_labelled / max(n, 1))))
    picked = labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) < share)
    return fit(stored(stats.join(picked, "doc_id").select("stats", "label")), **options)


def score_documents(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id",
                    text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD,
                    **options) -> DataFrame:
    """(doc_id, score, predicted) for every document."""
    stats = stored(measured(docs, id_col, text_col))
    model = fit_on(stats, labels, learn, id_col, label_col, **options)
    score = model.score(lambda f: F.col("stats")[f])
    return stats.select("doc_id", score.alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id",
              text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD,
              **options) -> DataFrame:
    """The documents whose score reaches the threshold; all columns as they are. The compiled model
    filters in the scan, so the texts are not shuffled."""
    stats = stored(measured(docs, id_col, text_col))
    model = fit_on(stats, labels, learn, id_col, label_col, **options)
    values = statistics(F.col(text_col))
    measures = F.array(*[values[name].cast("double") for name in FEATURES])
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), measures.alias("stats"))
    chosen = row.filter(model.score(lambda f: F.col("stats")[f]) >= threshold)
    return chosen.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
