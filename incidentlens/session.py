"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes of files, and of rows as counted in a shuffle, up to which a table is broadcast.
FILE_BROADCAST, ROWS_BROADCAST = "512k", "10m"
#: Short rows that fill a file of a stored table.
FILE_ROWS = 1 << 16
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Cell joins turn few bytes into much work, so small shuffles keep their parallelism.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k",
    # A stored list of cells takes one byte a row on disk and a hundred as a broadcast: only short files are
    # broadcast by their bytes, other tables by their rows.
    "spark.sql.autoBroadcastJoinThreshold": FILE_BROADCAST,
    "spark.sql.adaptive.autoBroadcastJoinThreshold": ROWS_BROADCAST,
}
# Read once at start: no call-site capture for every column expression.
START_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def build_session(cpus: int | str = "*", memory: str = "8g", **extra: str) -> SparkSession:
    """Local session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName("incidentlens")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8" if cpus == "*" else str(cpus)))
    for key, value in {**SETTINGS, **START_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession, file_broadcast: str = FILE_BROADCAST) -> SparkSession:
    """Settings that results depend on (time zone), or that skew handling and the driver's memory need.

    Files of up to `file_broadcast` bytes are broadcast without a look at their rows; texts, which do not
    shrink a hundredfold, can do with more.
    Python workers get this package's folder on their path; on a cluster it has to be installed there
    or sent along with --py-files.
    """
    for key, value in {**SETTINGS, "spark.sql.autoBroadcastJoinThreshold": file_broadcast}.items():
        spark.conf.set(key, value)
    home, known = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if home not in known.get("PYTHONPATH", "").split(":"):
        known["PYTHONPATH"] = ":".join(filter(None, [home, known.get("PYTHONPATH", "")]))
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Folder for checkpoints: the one the cluster names, or a temporary one in local mode only."""
    context = spark.sparkContext
    named = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a shared folder")
        named = tempfile.mkdtemp(prefix="incidentlens-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def scratch_folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark).rstrip('/')}/incidentlens/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Cut the lineage through a table in the shared folder; survives lost executors.

    `rows` is how many short rows the table has at most, if that is known: then no more files are written than
    such a table fills, whatever the number of shuffle partitions.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    path = scratch_folder(spark, "stage")
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that no later action reads; other tables are left alone."""
    for table in tables:
        path = getattr(table, "_stored_path", None)
        if path:
            spark = table.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
