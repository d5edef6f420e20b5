"""Reading complaint records and storing cleaned incidents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules

RAW_COLUMNS = [
    "cmplnt_num", "cmplnt_fr_dt", "cmplnt_fr_tm", "rpt_dt", "ofns_desc", "pd_desc", "law_cat_cd",
    "boro_nm", "prem_typ_desc", "vic_age_group", "vic_race", "vic_sex", "latitude", "longitude",
]
CORRUPT = "_corrupt_record"


def read_complaints(spark: SparkSession, path: str, columns=None) -> DataFrame:
    """Complaint CSV as text columns; types come from the cleaning rules.

    Pass the file's own header as `columns` when it differs from the documented one. With
    `columns=None` the header line decides, and every column stays text (no inference pass).
    """
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option(
        "multiLine", False).option("escape", '"')
    if columns is not None:
        schema = ", ".join(f"`{c}` STRING" for c in [*columns, CORRUPT])
        reader = reader.schema(schema).option("columnNameOfCorruptRecord", CORRUPT)
    return reader.csv(path)


def normalise_columns(df: DataFrame) -> DataFrame:
    """Add each standard column from its first alias present; existing columns stay as they are.

    Names are compared by case, as a file may hold both `Latitude` and `latitude`.
    """
    present = set(df.columns)
    added = []
    for target, aliases in rules.COLUMN_ALIASES.items():
        if target in present:
            continue
        alias = next((a for a in aliases if a in present), None)
        if alias is not None:
            added.append(F.col(f"`{alias}`").alias(target))
    return df.select("*", *added) if added else df


def storage_columns(df: DataFrame) -> DataFrame:
    """The stored columns that exist, in fixed order."""
    return df.select(*[c for c in rules.STORAGE_COLUMNS if c in df.columns])


def write_incidents(df: DataFrame, path: str, rows_per_file: int = 5_000_000) -> None:
    """Cleaned incidents as parquet, one folder per borough, files of bounded length.

    Within a task rows are ordered by tenth-degree cell, so a file's row groups cover narrow ranges of
    coordinates and a filter on a box skips most of them.
    """
    cell = [F.floor(F.col(c) * 10) for c in ("latitude", "longitude")]
    (df.sortWithinPartitions("borough", *cell).write.mode("overwrite").partitionBy("borough")
       .option("maxRecordsPerFile", rows_per_file).parquet(path))


def read_incidents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
