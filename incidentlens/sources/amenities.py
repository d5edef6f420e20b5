"""Amenity table: a CSV where there is one, otherwise generated places around borough centres."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules

SCHEMA = "name STRING, type STRING, borough STRING, latitude DOUBLE, longitude DOUBLE"


def read_amenities(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(SCHEMA).csv(path)


def offset(key, salt: int):
    """Repeatable offset in ±0.05 degrees, spread by modular arithmetic instead of a random call."""
    steps = F.pmod(key * F.lit(7919) + F.lit(salt * 104729), F.lit(100001))
    return (steps / F.lit(100000.0) * 2 - 1) * F.lit(rules.AMENITY_SPREAD_DEG)


def generated_amenities(spark: SparkSession, seed: int = 42) -> DataFrame:
    """Twenty places around each of five borough centres, types in turn."""
    per = rules.AMENITIES_PER_BOROUGH
    centres = F.array(*[
        F.struct(F.lit(n).alias("borough"), F.lit(a).alias("lat"), F.lit(o).alias("lon"))
        for n, a, o in rules.BOROUGH_CENTRES])
    types = F.array(*[F.lit(t) for t in rules.AMENITY_TYPES])
    i = F.col("id") % per
    centre = F.get(centres, (F.col("id") / per).cast("int"))
    kind = F.get(types, (i % len(rules.AMENITY_TYPES)).cast("int"))
    key = F.col("id") + F.lit(seed)
    return spark.range(per * len(rules.BOROUGH_CENTRES)).select(
        F.concat(centre["borough"], F.lit(" "), F.initcap(kind), F.lit(" "),
                 (i + 1).cast("string")).alias("name"),
        kind.alias("type"),
        centre["borough"].alias("borough"),
        (centre["lat"] + offset(key, 1)).alias("latitude"),
        (centre["lon"] + offset(key, 2)).alias("longitude"))


def load_amenities(spark: SparkSession, path: str | None = None, seed: int = 42) -> DataFrame:
    return read_amenities(spark, path) if path else generated_amenities(spark, seed)
