"""Result files: CSV of places, JSON of analyses, JSON records of any result table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def json_record(*columns) -> Column:
    """One JSON object per row, null fields kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
