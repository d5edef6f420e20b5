"""Short identifiers of long contents, verified: equal identifiers stand for equal contents only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import is_small
from ..session import discard, stored

BITS = 64


def content_hash(columns: list[str], bits: int = BITS):
    """The identifier that a content gets unless another one has it too."""
    h = F.xxhash64(*columns)
    return h if bits == 64 else h.bitwiseAND(F.lit((1 << bits) - 1))


def clashing(contents: DataFrame, columns: list[str], bits: int = BITS) -> DataFrame | None:
    """(_h, *columns, _id): all contents whose hash another content has too; None where there are none.

    Every content is moved once at most: copies are dropped before the shuffle, and it is the contents
    that are compared, not a second hash. Of the contents of one hash the first in order keeps it; the
    others get values that no content has. The columns are not null.
    """
    distinct = contents.select(content_hash(columns, bits).alias("_h"), *columns).distinct()
    shared = stored(distinct.groupBy("_h").agg(F.count("*").alias("_n")).filter("_n > 1").select("_h"))
    if shared.isEmpty():
        discard(shared)
        return None
    order = Window.partitionBy("_h").orderBy(*columns)
    rows = stored(distinct.join(shared, "_h").withColumn("_k", F.row_number().over(order) - 1))
    attempt = 0
    while True:
        fresh = rows.filter("_k > 0").select(F.xxhash64("_h", "_k", F.lit(attempt)).alias("_id"))
        twice = fresh.groupBy("_id").agg(F.count("*").alias("_n")).filter("_n > 1").select("_id")
        taken = fresh.join(distinct.select(F.col("_h").alias("_id")), "_id", "left_semi")
        if twice.unionByName(taken).isEmpty():
            break
        attempt += 1
    return rows.select("_h", *columns, F.when(F.col("_k") == 0, F.col("_h")).otherwise(
        F.xxhash64("_h", "_k", F.lit(attempt))).alias("_id"))


def with_identifier(table: DataFrame, columns: list[str], out: str, clashes: DataFrame | None,
                    bits: int = BITS) -> DataFrame:
    """`table` with the identifier of `columns`, given what `clashing` found for the same contents."""
    h = content_hash(columns, bits)
    if clashes is None:
        return table.withColumn(out, h)
    if is_small(clashes):
        clashes = F.broadcast(clashes)
    return (table.withColumn("_h", h).join(clashes, ["_h", *columns], "left")
            .withColumn(out, F.coalesce("_id", "_h")).drop("_h", "_id"))
