"""Exact quantiles and ranks that never sort a whole column in one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .ranking import running_total

MAX_DISTINCT = 200_000
SPLITS = 256
SKETCH_ACCURACY = 10_000


def exact_quantiles(df: DataFrame, columns, probs, max_distinct: int = MAX_DISTINCT):
    """Quantiles with linear interpolation: {column: [value, ...]}, None where there are no rows.

    Values are first collapsed to (column, value, count), once for all columns, so copies cost
    nothing and the input is read once. Columns with at most `max_distinct` distinct values are
    finished in one grouped aggregate. For longer ones a mergeable sketch proposes split points, the
    rows between them are counted, and only the part that holds the wanted rank is looked at again,
    until it is short enough; the sketch's error costs at most time, never exactness.
    """
    columns, probs = list(columns), [float(p) for p in probs]
    pairs = F.array(*[F.struct(F.lit(i).alias("c"), F.col(name).cast("double").alias("v"))
                      for i, name in enumerate(columns)])
    counts = stored(df.select(F.inline(pairs)).filter("v IS NOT NULL")
                    .groupBy("c", "v").agg(F.count("*").alias("n")))
    sizes = {r["c"]: r for r in counts.groupBy("c").agg(
        F.sum("n").alias("rows"), F.count("*").alias("values")).collect()}
    short = [c for c, r in sizes.items() if r["values"] <= max_distinct]
    found = {}
    if short:
        wanted = F.percentile("v", F.array(*[F.lit(p) for p in probs]), F.col("n"))
        found = {r["c"]: list(r["q"]) for r in counts.filter(F.col("c").isin(short))
                 .groupBy("c").agg(wanted.alias("q")).collect()}
    for c in sizes.keys() - found.keys():
        mine = counts.filter(F.col("c") == c).select("v", "n")
        found[c] = [_interpolated(mine, p * (sizes[c]["rows"] - 1), max_distinct) for p in probs]
    return {name: found.get(i, [None] * len(probs)) for i, name in enumerate(columns)}


def _interpolated(counts: DataFrame, position: float, max_distinct: int) -> float:
    low = _value_at(counts, math.floor(position), max_distinct)
    if position == math.floor(position):
        return low
    high = _value_at(counts, math.ceil(position), max_distinct)
    return low + (high - low) * (position - math.floor(position))


def _value_at(counts: DataFrame, rank: int, max_distinct: int) -> float:
    """Value at a 0-based rank of the column that (v, n) pairs stand for."""
    window = counts
    while True:
        distinct = window.count()
        if distinct <= max_distinct:
            break
        edges = window.agg(F.percentile_approx(
            "v", [i / SPLITS for i in range(1, SPLITS)], SKETCH_ACCURACY)).first()[0]
        bucket = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < F.col("v")))
        sizes = {r["b"]: r["n"] for r in window.groupBy(bucket.alias("b"))
                 .agg(F.sum("n").alias("n")).collect()}
        for b in sorted(sizes):
            if rank < sizes[b]:
                window = window.filter(bucket == b)
                break
            rank -= sizes[b]
    upto = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("v"))
    return window.select("v", upto.alias("upto")).filter(F.col("upto") > rank).agg(
        F.min("v")).first()[0]


def percent_rank_by(df: DataFrame, group: str, value: str, out: str) -> DataFrame:
    """`percent_rank()` of a score within its group, whatever the group's size.

    Ranks are running totals over the (group, value) counts, taken over the whole table by range partitions,
    and reach the rows by a join on those two columns.
    """
    counts = running_total(df.groupBy(group, value).agg(F.count("*").alias("_n")), [group, value], "_n", "_before")
    sizes = counts.groupBy(group).agg(F.min("_before").alias("_start"), F.sum("_n").alias("_total"))
    rank = (F.col("_before") - F.col("_start")) / (F.col("_total") - 1)
    ranks = counts.join(sizes, group).select(
        group, value, F.when(F.col("_total") > 1, rank).otherwise(0.0).alias(out))
    return df.join(ranks, [group, value], "left")
