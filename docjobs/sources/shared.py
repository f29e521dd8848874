"""The folder that the driver and all executors share, for tables and files that are written and read back; the size of Arrow batches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the file system that Spark would read it on."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder (URI) below the one that the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder takes its place if Spark runs in this process alone; on a cluster it is an
    error, as executors would write where others can't read.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="docjobs-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{qualified(spark, base).rstrip('/')}/docjobs-{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, folder: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def folder_exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at))


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Bounds the bytes of the session's Arrow batches from here on, since the rows here are whole documents."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(str(spark.conf.get(key)))  # such as 64m
    if not 0 < now <= size:  # none or less: no bound
        spark.conf.set(key, str(size))
