"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

ROWS_PER_TASK = 2_000_000
SMALL_ROWS = 20_000


def is_small(df: DataFrame, rows: int = SMALL_ROWS) -> bool:
    """True when the table has at most `rows` rows.

    Partitions are read a few at a time until one row too many is found, and only constants are
    brought back, so the check is cheap on a table of any size.
    """
    return len(df.select(F.lit(1)).take(rows + 1)) <= rows


def hot_keys(df: DataFrame, keys, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Every key with more rows than one task should take, and the number of parts to cut it into."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > rows_per_task)
    return counts.select(*keys, F.ceil(F.col("_n") / rows_per_task).cast("int").alias("_parts"))


def salted_join(many: DataFrame, few: DataFrame, keys, spread=None, many_rows: int | None = None,
                rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Inner equi-join; hot keys of `many` are cut into parts and `few` is copied to each part.

    `spread` names columns that tell rows of `many` apart; without them all columns are used. A part
    follows from a row's content only, so a task that runs again deals the same rows to the same
    parts; rows equal in all of these columns stay together. `many_rows` is the length of `many` where
    it is known: a table shorter than one task's share has no hot keys. The list of hot keys is stored
    and broadcast if it is short (checked).
    """
    keys = list(keys)
    if many_rows is not None and many_rows <= rows_per_task:
        return many.join(few, keys)
    hot = stored(hot_keys(many, keys, rows_per_task))
    if hot.isEmpty():
        return many.join(few, keys)
    if is_small(hot):
        hot = F.broadcast(hot)
    part = F.xxhash64(*(spread or many.columns))
    left = (many.withColumn("_spread", part).join(hot, keys, "left")
            .withColumn("_salt", F.when(F.col("_parts").isNull(), F.lit(0))
                        .otherwise(F.pmod(F.col("_spread"), F.col("_parts"))).cast("int"))
            .drop("_spread", "_parts"))
    right = (few.join(hot, keys, "left")
             .withColumn("_salt", F.explode(
                 F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1)))
             .drop("_parts"))
    return left.join(right, [*keys, "_salt"]).drop("_salt")
