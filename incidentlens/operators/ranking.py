"""Ranks over a whole table, and samples of fixed size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .skew import is_small


def global_rank(df: DataFrame, order, out: str) -> DataFrame:
    """Position (from 0) of each row in a total order, without sorting in one task.

    Rows are range-partitioned, numbered inside their partition, and shifted by the sizes of the
    partitions before; only those sizes (one row per partition) meet in one place.
    """
    order = list(order)
    parts = stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (parts.withColumn("_pos", inside).join(F.broadcast(shift), "_part")
            .withColumn(out, F.col("_pos") + F.col("_shift") - 1)
            .drop("_part", "_pos", "_shift"))


def running_total(df: DataFrame, order, value: str, out: str) -> DataFrame:
    """Sum of `value` over all rows before each row in a total order, by range partitions and prefix sums."""
    order = list(order)
    parts = stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sums = parts.groupBy("_part").agg(F.sum(value).alias("_sum"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition.
    return (parts.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
            .join(F.broadcast(shift), "_part").withColumn(out, F.col("_inside") + F.col("_shift"))
            .drop("_part", "_inside", "_shift"))


def rank_within(df: DataFrame, group, order, out: str, short_groups: bool = False,
                in_order: bool = False) -> DataFrame:
    """Position (from 1) of each row in its group; `order` must tell all rows of a group apart.

    Taken from the position in the whole table, so a group of any size is ranked by many tasks. With
    `short_groups` each group is ranked by one task, in the partitions that `df` has if they hold whole groups; where
    no other columns are to be kept, as a list (the quickest one is of a single number that is never null). With
    `in_order`, such lists are put in order of their groups before they are unrolled, and so rows come in order.
    Null groups are left out.
    """
    group, order = list(group), list(order)
    if short_groups and sorted(df.columns) == sorted([*group, *order]):
        number = len(order) == 1 and not df.schema[order[0]].nullable
        item = F.col(order[0]) if number else F.struct(*order)
        # The rows of a short group.
        lists = df.dropna(subset=group).groupBy(*group).agg(F.sort_array(F.collect_list(item)).alias("_items"))
        if in_order:
            lists = lists.orderBy(*group)
        rows = lists.select(*group, F.posexplode("_items").alias("_at", "_item"))
        fields = {c: F.col("_item") if number else F.col(f"_item.{c}") for c in order}
        return rows.withColumns(fields).withColumn(out, F.col("_at") + 1).select(*df.columns, out)
    if short_groups:
        place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
        ranked = df.dropna(subset=group).withColumn(out, place)
        return ranked.orderBy(*group, out) if in_order else ranked
    ranked = global_rank(df, [*group, *order], "_at")
    starts = ranked.groupBy(*group).agg(F.min("_at").alias("_start"))
    return (ranked.join(starts, group)
            .withColumn(out, (F.col("_at") - F.col("_start") + 1).cast("int"))
            .drop("_at", "_start"))


def sample_rows(df: DataFrame, n: int, key, seed: int = 42) -> DataFrame:
    """`n` rows without replacement, the same ones for the same seed: those of lowest key hash (MD5, so that
    any engine can draw the same ones).

    On a long table only hashes in the lowest share that should hold 4·n rows are ordered; when
    they turn out too few, all rows are.
    """
    rank = F.md5(F.concat_ws("/", F.col(key).cast("string"), F.lit(str(seed))))
    total = df.count()
    if total > 100 * n:
        low = df.filter(rank < F.lit(f"{int(2 ** 128 * 4 * n / total):032x}"))
        if not is_small(low, n - 1):
            df = low
    return df.orderBy(rank, key).limit(n)
