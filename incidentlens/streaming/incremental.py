"""Daily ingest as a stream: duplicates dropped, counts per cell and window, stale cells marked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.risk import KEYS, cell_id, day_rows


def deduplicated(stream: DataFrame, delay: str = "2 days") -> DataFrame:
    """Each incident once, as long as its copies arrive within the delay."""
    return (stream.filter(F.col("occurred_at").isNotNull())
            .withWatermark("occurred_at", delay)
            .dropDuplicatesWithinWatermark(["incident_id"]))


def cell_counts(stream: DataFrame, window: str = "1 day", digits: int = 2) -> DataFrame:
    """Incidents per cell and tumbling window."""
    cell = cell_id(F.col("latitude"), F.col("longitude"), digits)
    return (stream.groupBy(F.window("occurred_at", window).alias("w"), cell.alias("grid_cell_id"))
            .agg(F.count("*").alias("count"))
            .select("grid_cell_id", F.col("w.start").alias("window_start"), "count"))


def mark_stale(batch: DataFrame, batch_id: int, path: str, digits: int = 3) -> None:
    """`foreachBatch` sink: cells touched by the batch, one folder per batch.

    Writing a folder named by the batch and replacing it makes a repeated batch harmless. It is fed
    before the watermark, so late rows mark their cell too.
    """
    cell = cell_id(F.col("latitude"), F.col("longitude"), digits)
    (batch.select(cell.alias("grid_cell_id")).distinct()
     .write.mode("overwrite").parquet(f"{path}/batch={batch_id}"))


def run_counts(stream: DataFrame, path: str, checkpoint: str, window: str = "1 day",
               digits: int = 2, delay: str = "2 days") -> None:
    """Process all input there is and write finished windows."""
    query = (cell_counts(deduplicated(stream, delay), window, digits).writeStream
             .format("parquet").outputMode("append").option("path", path)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def run_marking(stream: DataFrame, path: str, checkpoint: str, digits: int = 3) -> None:
    query = (stream.writeStream
             .foreachBatch(lambda batch, i: mark_stale(batch, i, path, digits))
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


COUNT_KEYS = [*KEYS, "crime_category", "day"]
COUNT_BUCKETS = 64


def write_totals(batch: DataFrame, batch_id: int, path: str, buckets: int = COUNT_BUCKETS) -> None:
    """`foreachBatch` sink: the totals that a batch changed, one folder per batch, by a hash of the cell.

    The state store holds the totals, so what is written replaces older totals of the same keys and is not
    added to them: a batch that is repeated is harmless.
    """
    bucket = F.pmod(F.xxhash64("grid_cell_id"), F.lit(buckets)).cast("int")
    (batch.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket")
     .parquet(f"{path}/batch={batch_id}"))


def run_day_counts(stream: DataFrame, path: str, checkpoint: str, digits: int = 3) -> None:
    """Keep day counts of a stream of incidents: additive totals in the state store, changed ones written.

    Totals never decay, so they have no end; decay is applied when they are read (`risk_from_counts`).
    """
    totals = day_rows(stream, digits).groupBy(*COUNT_KEYS).agg(F.count("*").alias("n"))
    query = (totals.writeStream.outputMode("update")
             .foreachBatch(lambda batch, i: write_totals(batch, i, path))
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def written_totals(spark, path: str) -> DataFrame:
    """All totals that were written, with their batch and bucket."""
    kinds = ", ".join(f"{k} {'DATE' if k == 'day' else 'STRING'}" for k in COUNT_KEYS)
    return spark.read.schema(f"{kinds}, n BIGINT, batch BIGINT, bucket INT").parquet(path)


def current_totals(spark, path: str, touched: DataFrame | None = None, buckets: int = COUNT_BUCKETS) -> DataFrame:
    """The latest total of every key; with `touched` (grid_cell_id), only of partitions that hold such a cell."""
    rows = written_totals(spark, path)
    if touched is not None:
        bucket = F.pmod(F.xxhash64("grid_cell_id"), F.lit(buckets)).cast("int").alias("bucket")
        wanted = [r.bucket for r in touched.select(bucket).distinct().collect()]  # one per partition at most
        rows = rows.filter(F.col("bucket").isin(wanted)).join(
            touched.select("grid_cell_id").distinct(), "grid_cell_id", "left_semi")
    return rows.groupBy(*COUNT_KEYS).agg(F.max_by("n", "batch").alias("n"))


def changed_cells(spark, path: str, after: int) -> DataFrame:
    """(grid_cell_id): cells with totals that changed in batches later than `after`."""
    return written_totals(spark, path).filter(F.col("batch") > after).select("grid_cell_id").distinct()


def last_batch(spark, path: str) -> int:
    row = written_totals(spark, path).agg(F.max("batch").alias("b")).first()
    return -1 if row.b is None else row.b
