"""A cache that a stream keeps as one compacted version and the deltas since, for caches much larger than a batch.

A batch appends its users' last records as one delta, so it writes as much as it brings, whatever the cache holds. Reading
takes the last record of each user over version and deltas. After ``every`` deltas the cache is compacted into a new
version; what the new one holds is dropped then. A batch that is repeated after a failure overwrites its delta, or finds
that a version has it. A version counts once it is whole, so a failed compaction leaves the former one and its deltas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from docjobs.operators.store import cache_upsert
from docjobs.sources.shared import drop_folder, folder_exists
from docjobs.streaming.jobs import CACHE

#: Deltas that reading may have to merge.
EVERY = 16


def _numbers(spark: SparkSession, base: str, kind: str) -> list[int]:
    """The whole folders of a kind, ascending."""
    at = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n.split("-")[1]) for n in names if n.startswith(f"{kind}-") and folder_exists(spark, f"{base}/{n}/_SUCCESS"))


def _folder(base: str, kind: str, n: int) -> str:
    return f"{base}/{kind}-{n:012d}"


def _parts(spark: SparkSession, base: str) -> tuple[int, list[int]]:
    """The number of the last batch that the version holds (0 for the rows it started from), and the deltas since."""
    version = (_numbers(spark, base, "version") or [0])[-1]
    return version, [n for n in _numbers(spark, base, "delta") if n > version]


def read_cache(spark: SparkSession, base: str) -> DataFrame:
    """user_id, ts, id, record: the last record of each user."""
    version, deltas = _parts(spark, base)
    rows = spark.read.schema(CACHE).parquet(_folder(base, "version", version))
    if not deltas:
        return rows
    new = spark.read.schema(CACHE).parquet(*(_folder(base, "delta", n) for n in deltas))
    return cache_upsert(rows, new.selectExpr("*", "100 AS confidence"))


def compact(spark: SparkSession, base: str) -> None:
    """Writes a version that holds all deltas, and drops what it has replaced."""
    version, deltas = _parts(spark, base)
    if deltas:
        read_cache(spark, base).write.mode("overwrite").parquet(_folder(base, "version", deltas[-1]))
    newest = (deltas or [version])[-1]
    for kind in ("version", "delta"):
        for n in _numbers(spark, base, kind):
            if n < newest or (kind == "delta" and n == newest):
                drop_folder(spark, _folder(base, kind, n))


def append_batch(batch: DataFrame, n: int, base: str, initial: DataFrame | None = None, every: int = EVERY) -> None:
    """Adds the n-th batch (user_id, ts, id, record, confidence) to the cache below base, which starts from initial."""
    spark, number = batch.sparkSession, n + 1
    none = spark.createDataFrame([], CACHE)
    if not _numbers(spark, base, "version"):
        (none if initial is None else initial.select("user_id", "ts", "id", "record")).write.mode("overwrite").parquet(_folder(base, "version", 0))
    version, _ = _parts(spark, base)
    if number <= version:
        return
    cache_upsert(none, batch).write.mode("overwrite").parquet(_folder(base, "delta", number))
    if len(_parts(spark, base)[1]) >= every:
        compact(spark, base)


def stream_cache_append(results: DataFrame, base: str, initial: DataFrame | None = None, every: int = EVERY) -> DataStreamWriter:
    """A writer that runs ``append_batch`` on each batch; base belongs to the stream and its checkpoint."""
    return results.writeStream.foreachBatch(lambda batch, n: append_batch(batch, n, base, initial, every))
