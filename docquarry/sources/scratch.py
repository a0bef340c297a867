"""Tables that a job writes once and reads again, in a folder that all executors share."""

from __future__ import annotations

import gc
import re
import time
import uuid
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the one that all executors share: spark.checkpoint.dir, else the warehouse.

    It is deleted when the driver's JVM ends. Without spark.checkpoint.dir a warehouse on a local disk is taken
    only where all tasks run on this machine; on a cluster that is an error, as each executor would write to a
    disk of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    root = (found or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master) and urlsplit(root).scheme in ("", "file"):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors share; the warehouse, {root}, is a local one")
    folder = f"{root}/docquarry-{spark.sparkContext.applicationId}"
    fs, path = _file_system(spark, folder)
    if not fs.exists(path):  # only what is there can be marked
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return folder


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage, so that a lost executor costs a re-read and not a re-computation, and lets
    several consumers read a narrow result that was expensive to make.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _tidy(spark)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_at = path
    return found


def _tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps, every 10 seconds at most.

    Its cleaner deletes what the driver's JVM has found to be unreachable, and a driver with little to do may
    not collect garbage for long while a job of many steps fills the disks.
    """
    if time.monotonic() - _tidied[0] > _TIDY_SECONDS:
        _collect(spark)


def _collect(spark: SparkSession) -> None:
    _tidied[0] = time.monotonic()
    gc.collect()
    spark._jvm.java.lang.System.gc()


def tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of all finished steps now, those of the last one too.

    Spark's listeners hold on to the last query until they are told of another, so an empty one is run first.
    """
    spark.range(0).collect()
    _collect(spark)


_TIDY_SECONDS = 10.0
_tidied = [time.monotonic()]


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that no frame reads any more."""
    for table in tables:
        fs, path = _file_system(table.sparkSession, table.written_at)
        fs.delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if it lies in fewer than half as many filled partitions; else as it is.

    A file of one row group is read by one task. Large tables have more partitions than cores and stay put: the
    plan tells that, and only where there are few partitions are the filled ones counted.
    """
    from pyspark.sql import functions as F

    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().executedPlan()
    if plan.nodeName() != "AdaptiveSparkPlan" and plan.execute().getNumPartitions() > 4 * cores:
        return df
    filled = df.select(F.spark_partition_id().alias("p")).distinct().count()
    return df.repartition(cores) if 0 < 2 * filled <= cores else df
