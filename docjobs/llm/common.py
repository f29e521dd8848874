"""What the operators of this subpackage share: the shared folder, written tables, row keys and batch sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docjobs.sources.shared import drop_folder, shared_folder, small_batches  # noqa: F401  (operators take it from here)

#: The two ASCII white-space classes that the operators name: what separates words, and what may be deleted.
SPACES = " \t\n\x0b\x0c\r"

_made: list[str] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder (URI) below the folder that the driver and all executors share; see ``shared_folder``."""
    folder = shared_folder(spark, name)
    _made.append(folder)
    return folder


def drop(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of ``shared_dir`` that nothing reads any more."""
    drop_folder(spark, folder)
    if folder in _made:
        _made.remove(folder)


def drop_written(spark: SparkSession, since: int = 0, but: str | tuple[str, ...] | None = None) -> None:
    """Deletes what this process has written into the shared folder, from its since-th folder on; call it when results have been stored."""
    kept = (but,) if isinstance(but, str) else but or ()
    for folder in _made[since:]:
        if folder not in kept:
            drop(spark, folder)


def n_written() -> int:
    """How many folders this process has in the shared folder."""
    return len(_made)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``written``, and the folder, for tables that are dropped before the end."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet into the shared folder and read back.

    Cuts the lineage: a lost executor costs no recomputation of what stands before it, and a table that is used more
    than once is computed once. Spark knows the size of what it reads back, and sends it to all executors in a join
    only below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    return stored(df, name)[0]


def checkpoint_dir(spark: SparkSession) -> None:
    """Sees to it that checkpoint() writes to the folder that the cluster names in ``spark.checkpoint.dir``."""
    folder = shared_folder(spark, "checkpoints")  # an error on a cluster that names none
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)


def columns(df: DataFrame, *but: str) -> list[Column]:
    """The columns of df, whatever their names hold."""
    return [F.col(f"`{c}`") for c in df.columns if c not in but]


def valid(text: str) -> Column:
    """The text with bytes that are no UTF-8 as U+FFFD, which is what the operators' Python sees of it."""
    return F.make_valid_utf8(F.col(text))


def row_key(doc_id: str, text: str) -> Column:
    """The id and a hash of the text: what tells documents apart where ids repeat."""
    return F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.xxhash64(F.col(text)))


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """key (``row_key``) and doc (a struct of the row), so that no name of the user's can clash with the operator's."""
    return docs.select(row_key(doc_id, text).alias("key"), F.struct(*columns(docs)).alias("doc"))


def without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of ``keyed`` whose key is not among those dropped: few, narrow, and written first, so texts move only if they are many."""
    return rows.join(written(dropped.select("key").distinct(), "dropped"), "key", "left_anti")


def one_of_each(docs: DataFrame, rows: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The row of docs with the smallest id (null last, then by key) of each root; rows (id, key, root) has one row for each of docs."""
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key"))
    least = rows.groupBy("root").agg(first.alias("first"), F.count("*").alias("n")).filter("n > 1").select("root", F.col("first.key").alias("stays"))
    kept = without(keyed(docs, doc_id, text), rows.join(least, "root").filter("key <> stays"))
    again = written(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "repeated")
    if not again.isEmpty():  # rows that are alike in id and text
        kept = kept.join(again, "key", "left_anti").unionByName(kept.join(again, "key", "left_semi").dropDuplicates(["key"]))
    return kept.select("doc.*")
