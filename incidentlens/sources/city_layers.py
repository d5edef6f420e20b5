"""Optional city sources: service requests and street lights, as point tables for `layer_counts`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules


def read_service_requests(spark: SparkSession, path: str, kinds=tuple(rules.SERVICE_REQUEST_KINDS)) -> DataFrame:
    """(request_id, kind, created_at, latitude, longitude) of a service-request CSV.

    Only the columns used are parsed. `kinds` keeps the given complaint types (compared without case),
    None keeps all. Rows without coordinates are left out; a date that can't be read is null.
    """
    rows = _text_columns(spark, path)
    created = F.coalesce(*[F.try_to_timestamp(F.col("created_date"), F.lit(f)) for f in rules.SERVICE_DATE_FORMATS])
    out = rows.select(F.col("unique_key").alias("request_id"), F.trim("complaint_type").alias("kind"),
                      created.alias("created_at"), *_position())
    if kinds is not None:
        out = out.filter(F.lower("kind").isin([k.lower() for k in kinds]))
    return out.filter("latitude IS NOT NULL AND longitude IS NOT NULL")


def read_street_lights(spark: SparkSession, path: str, id_column: str = "objectid") -> DataFrame:
    """(light_id, latitude, longitude) of a street-light CSV with point coordinates."""
    rows = _text_columns(spark, path)
    return rows.select(F.col(id_column).alias("light_id"), *_position()).filter(
        "latitude IS NOT NULL AND longitude IS NOT NULL")


def _text_columns(spark: SparkSession, path: str) -> DataFrame:
    """The file's columns as text, their names in lower case with underscores."""
    rows = spark.read.option("header", True).option("escape", '"').csv(path)
    return rows.toDF(*[c.strip().lower().replace(" ", "_") for c in rows.columns])


def _position():
    return [F.expr(f"try_cast({c} AS DOUBLE)").alias(c) for c in ("latitude", "longitude")]
