"""Counts, shares, modes and matrices. Values are counted before anything is ranked or gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import rules


def value_counts(df: DataFrame, keys, value, out="count") -> DataFrame:
    """Count of each non-null value per key."""
    return (df.filter(F.col(value).isNotNull()).groupBy(*keys, value)
            .agg(F.count("*").alias(out)))


def sorted_counts(value: str, count: str = "count") -> Column:
    """Aggregate: (value, count) pairs as a map in value order."""
    return F.map_from_entries(F.sort_array(F.collect_list(F.struct(value, count))))


def counts_map(df: DataFrame, keys, value, out="counts") -> DataFrame:
    return (value_counts(df, keys, value).groupBy(*keys)
            .agg(sorted_counts(value).alias(out)))


def mode_from_counts(counts: DataFrame, keys, value, count="count", out=None) -> DataFrame:
    """Commonest value per key, smallest value on ties."""
    return counts.groupBy(*keys).agg(
        F.min_by(value, F.struct(-F.col(count), F.col(value))).alias(out or value))


def modes(df: DataFrame, keys, values: dict) -> DataFrame:
    """Row count and the commonest value of several columns per key (smallest on ties).

    Columns are turned into (attribute, value) rows and counted, so one shuffle of counts serves all
    of them. `values` maps output names to columns; results are text.
    """
    keys = list(keys)
    pairs = F.array(*[
        F.struct(F.lit(name).alias("attribute"), F.col(c).cast("string").alias("value"))
        for name, c in [("", "_one"), *values.items()]])
    long = (df.withColumn("_one", F.lit("")).select(*keys, F.inline(pairs))
            .filter("value IS NOT NULL").groupBy(*keys, "attribute", "value")
            .agg(F.count("*").alias("n")))
    is_value = lambda name: F.col("attribute") == name
    order = F.struct(-F.col("n"), F.col("value"))
    return long.groupBy(*keys).agg(
        F.sum(F.when(is_value(""), F.col("n"))).alias("count"),
        *[F.min_by(F.when(is_value(name), F.col("value")),
                   F.when(is_value(name), order)).alias(name) for name in values])


def top_values(df: DataFrame, keys, value, k: int) -> DataFrame:
    """The `k` commonest values per key with rank; count first, then value."""
    ranked = Window.partitionBy(*keys).orderBy(F.desc("count"), value)
    return (value_counts(df, keys, value).withColumn("rank", F.row_number().over(ranked))
            .filter(F.col("rank") <= k))


def top_list(df: DataFrame, keys, value, k: int, out="common") -> DataFrame:
    """The `k` commonest values per key as an ordered array of (value, count)."""
    item = F.struct("rank", F.col(value).alias("value"), "count")
    pairs = F.transform(F.sort_array(F.collect_list(item)),
                        lambda x: F.struct(x["value"].alias("value"), x["count"].alias("count")))
    return top_values(df, keys, value, k).groupBy(*keys).agg(pairs.alias(out))


def top_overall(df: DataFrame, value, k: int) -> DataFrame:
    return value_counts(df, [], value).orderBy(F.desc("count"), value).limit(k)


def matrix(df: DataFrame, key, value, values) -> DataFrame:
    """Key × value counts with zeros; the column list is fixed, so there is no discovery pass."""
    counted = df.groupBy(key).pivot(value, list(values)).count()
    return counted.na.fill(0).select(
        key, *[F.col(f"`{v}`").cast("long").alias(f"{value}_{v}") for v in values])


def counts_by_each(df: DataFrame, names) -> DataFrame:
    """Counts by each of several columns, in one scan, as (attribute, value, count)."""
    pairs = F.array(*[F.struct(F.lit(n).alias("attribute"),
                               F.col(n).cast("string").alias("value")) for n in names])
    return (df.select(F.inline(pairs)).groupBy("attribute", "value")
            .agg(F.count("*").alias("count")))


def null_counts(df: DataFrame) -> DataFrame:
    """Number of nulls of every column as (column, nulls), from one pass."""
    counted = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("nulls"))
                      for c in df.columns])
    return counted.select(F.inline(pairs))


def describe(df: DataFrame, names) -> DataFrame:
    """count, mean, std, min, quartiles, max per numeric column; quartiles are exact."""
    from .quantiles import exact_quantiles

    moments = df.agg(*[
        F.struct(F.count(c).alias("count"), F.mean(c).alias("mean"),
                 F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"),
                 F.max(c).cast("double").alias("max")).alias(c) for c in names])
    rows = []
    quantiles = exact_quantiles(df, names, [0.25, 0.5, 0.75])
    for c in names:
        quartiles = quantiles[c]
        rows.append(F.struct(
            F.lit(c).alias("column"), F.col(f"{c}.count"), F.col(f"{c}.mean"),
            F.col(f"{c}.std"), F.col(f"{c}.min"),
            *[F.lit(q).cast("double").alias(n) for q, n in zip(quartiles, ("q25", "q50", "q75"))],
            F.col(f"{c}.max")))
    return moments.select(F.inline(F.array(*rows)))


def shares(df: DataFrame, key, value, above: float = 0.0) -> DataFrame:
    """Share of each value within its key, kept when greater than `above`."""
    total = F.sum("count").over(Window.partitionBy(key))
    return (value_counts(df, [key], value).withColumn("share", F.col("count") / total)
            .filter(F.col("share") > above))


def peak_bucket(*counts: Column) -> Column:
    """(bucket, share of all) of the largest bucket, first on ties; null when all are zero."""
    names = [n for n, _, _ in rules.TIME_BUCKETS]
    best = F.array_max(F.array(*[
        F.struct(c.alias("count"), F.lit(-i).alias("order"), F.lit(n).alias("bucket"))
        for i, (c, n) in enumerate(zip(counts, names))]))
    total = sum(counts[1:], counts[0])
    return F.when(total > 0, F.struct(
        best["bucket"].alias("bucket"), (best["count"] * 100.0 / total).alias("percent")))


def yates_chi_square(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Chi-square of a 2×2 table with continuity correction; null when a margin is empty."""
    n = a + b + c + d
    product = (a + b) * (c + d) * (a + c) * (b + d)
    gap = F.greatest(F.abs(a * d - b * c) - n / 2.0, F.lit(0.0))
    return F.when(product > 0, n * gap * gap / product)


def chi_square_tail(x: Column) -> Column:
    """P(chi-square with one degree of freedom > x), by the complementary error function.

    Rational approximation 7.1.26 of Abramowitz and Stegun, absolute error below 1.5e-7.
    """
    z = F.sqrt(x / 2)
    t = 1 / (1 + 0.3275911 * z)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (
        1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-z * z)


def percentile_rank(value: Column, ordered: Column) -> Column:
    """Share (in %) of an array's values that are strictly smaller."""
    below = F.size(F.filter(ordered, lambda x: x < value))
    return F.when(F.size(ordered) > 0, below * 100.0 / F.size(ordered)).otherwise(0.0)


def share_below(table: DataFrame, value: str, out: str) -> DataFrame:
    """Share (in %) of all rows whose value is strictly smaller; a null value has none below it."""
    from .ranking import running_total

    counts = running_total(table.groupBy(value).agg(F.count("*").alias("_n")), [value], "_n", "_before")
    total = counts.agg(F.sum("_n")).scalar()
    below = counts.select(value, (F.col("_before") * 100.0 / total).alias(out))
    return table.join(below, value, "left").na.fill(0.0, [out]).select(*table.columns, out)


def facets(df: DataFrame, names, keep) -> DataFrame:
    """Long form (`keep` columns, attribute, value), nulls left out."""
    pairs = F.array(*[F.struct(F.lit(n).alias("attribute"),
                               F.col(n).cast("string").alias("value")) for n in names])
    return df.select(*keep, F.inline(pairs)).filter("value IS NOT NULL")
