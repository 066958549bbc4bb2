"""Where lineage is cut and which small sides may be broadcast."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL_ROWS = 10_000


def shared_dir(spark: SparkSession) -> str:
    """Folder for written intermediate tables: spark.checkpoint.dir, else the checkpoint folder already set in code.

    Only a local session without either gets a folder of its own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tabspark-"))
    return context.getCheckpointDir()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable by Python workers wherever they run: once per application, as a zip in the shared folder."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    package = os.path.dirname(os.path.abspath(__file__))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as out:
        for folder, _, names in os.walk(package):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                out.write(path, os.path.relpath(path, os.path.dirname(package)))
    place, files = _file_system(spark, f"{shared_dir(spark)}/{os.path.basename(package)}-{uuid.uuid4().hex}.zip")
    stream = files.create(place)
    stream.write(bytearray(held.getvalue()))
    stream.close()
    context.addPyFile(files.makeQualified(place).toString())


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Give Spark ML a checkpoint folder unless one is set already."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = shared_dir(spark)
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(folder)


def staged(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write a table that several later jobs read, and read it back: computed once, columnar, prunable."""
    path = f"{shared_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    place, files = _file_system(spark, path)
    return files.exists(place)


def opened_folder(spark: SparkSession, name: str) -> str | None:
    """Path of a new folder in the shared one by which Python opens it on any machine; None where only Hadoop reaches that."""
    place, files = _file_system(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    uri = files.makeQualified(place).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def discard(df: DataFrame) -> None:
    """Delete the files of a table that staged() returned, once nothing reads it any more."""
    place, files = _file_system(df.sparkSession, df.staged_path)
    files.delete(place, True)


def small(df: DataFrame) -> DataFrame:
    """A local copy to broadcast if the table has at most SMALL_ROWS rows, else the table itself (joined by shuffle)."""
    # With an order the limit is one job over all partitions; without, Spark probes partitions in several jobs.
    rows = df.orderBy(df.columns[0]).limit(SMALL_ROWS + 1).collect()
    if len(rows) > SMALL_ROWS:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


#: Rows that one task orders.
RANGE_ROWS = 200_000


def in_ranges(df: DataFrame, *order, rows: int | None = None) -> DataFrame:
    """The table, written once and cut by the order columns into ranges of about equal size, numbered in order as `__r`.

    What needs a running number over the whole order then adds the totals of the lower ranges to a number inside the range,
    so that no task orders more than one range. The number of ranges follows from the counted rows.
    """
    whole = staged(df)
    parts = max(1, -(-whole.count() // (rows or RANGE_ROWS)))
    if parts == 1:
        return whole.withColumn("__r", F.lit(0))
    return staged(whole.repartitionByRange(parts, *order).withColumn("__r", F.spark_partition_id()))


def packed(df: DataFrame) -> DataFrame:
    """A written table in partitions of about RANGE_ROWS rows: hundreds of small jobs over it then start few tasks each."""
    return df.coalesce(max(1, -(-df.count() // RANGE_ROWS)))
