"""Gapless ranks within keys, without a task per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PARTS = 512


def ranked(table: DataFrame, keys: list[str], order: list[str], name: str, parts: int = PARTS) -> DataFrame:
    """`table` with a rank from 0 without gaps within `keys`.

    Rows are dealt to `parts` by a hash of `order`; they are numbered within key and part, and the
    counts of a key's earlier parts are added. A key that holds most rows is thus spread over all
    parts. `table` has to give the same rows when read again (a stored table), and `order` should tell
    rows apart; rows equal in it take any order among themselves. Keys are not null.
    """
    dealt = table.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    counts = dealt.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    local = Window.partitionBy(*keys, "_part").orderBy(*order)
    numbered = dealt.withColumn("_local", F.row_number().over(local) - 1)
    return (numbered.join(before, [*keys, "_part"])
            .withColumn(name, (F.col("_local") + F.col("_before")).cast("long"))
            .select(*table.columns, name))
