"""Merging of batches whose pages arrive over time.

Keyed state holds the times of a batch alone, as session windows; its pages are written as they come. When no page has
come for ``gap``, the batch closes: its pages are read and merged by the batch operator in the sink, as one revision. A
page that comes after that reopens the batch, which closes again, with all its pages, as the next revision;
``read_merged`` reads the last one of each. A batch that gets no page for ``keep`` begins anew.

Times are arrival times, so a page is never behind the watermark because its batch has closed. A sink's epoch is
overwritten when it is repeated after a failure, and reads no later one. A page is known by its pos; one that comes again
replaces the former. Pages without a batch are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from docjobs.operators.merge import merge_results

#: The first of the keys of pages without a batch, and how many there are.
NO_BATCH, SPREAD = -(1 << 63), 256


def pages_and_closings(pages: DataFrame, gap: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """pages (batch_id, arrived_at, any other columns), a stream -> batch_id, page (the row), or start, end and n (pages) of a batch's stay that has closed."""
    came = pages.filter("batch_id is not null").select("batch_id", F.struct(*pages.columns).alias("page"))
    # keys of pages without a batch hang on the time, so that Spark can't leave them out before the watermark: they move the clock
    key = F.coalesce("batch_id", F.lit(NO_BATCH) + F.pmod(F.xxhash64("arrived_at"), F.lit(SPREAD)))
    timed = pages.withWatermark("arrived_at", late).select(key.alias("batch_id"), "arrived_at")
    stays = timed.groupBy("batch_id", F.session_window("arrived_at", gap).alias("w")).agg(F.max("arrived_at").alias("end"), F.count("*").alias("n"))
    closed = stays.filter(F.col("batch_id") >= NO_BATCH + SPREAD).select("batch_id", F.col("w.start").alias("start"), "end", "n")
    return came.unionByName(closed, allowMissingColumns=True).withColumn("closes", F.col("page").isNull())


def _chains(closings: DataFrame, keep: str) -> DataFrame:
    """Closings (batch_id, start, end, epoch) with since (the start of the first that no pause of keep parts from it) and revision."""
    by_time = Window.partitionBy("batch_id").orderBy("end", "start")
    anew = F.coalesce(F.col("start") > F.lag("end").over(by_time) + F.expr(f"interval {keep}"), F.lit(True))
    out = closings.withColumn("_anew", F.when(anew, F.col("start")))
    return out.withColumns({"since": F.last("_anew", ignorenulls=True).over(by_time), "revision": F.dense_rank().over(Window.partitionBy("batch_id").orderBy("epoch"))}).drop("_anew")


def closed_pages(spark: SparkSession, came: str, schema, epoch: int, keep: str = "30 days") -> tuple[DataFrame, DataFrame]:
    """The batches that close in an epoch (batch_id, since, end, revision, n), and all their pages up to that."""
    rows = spark.read.schema(schema).option("basePath", came).parquet(f"{came}/epoch=*").filter(F.col("epoch") <= epoch)
    closings = rows.filter("closes").select("batch_id", "start", "end", "n", "epoch")
    now = closings.filter(F.col("epoch") == epoch).select("batch_id").distinct()
    chains = _chains(closings.join(now, "batch_id", "left_semi"), keep)
    last = chains.groupBy("batch_id").agg(F.max(F.struct("end", "since")).alias("m"), F.max("revision").cast("int").alias("revision"), F.sum("n").alias("n"))
    last = last.select("batch_id", "m.since", "m.end", "revision", "n")
    pages = rows.filter("not closes").select("batch_id", "epoch", "page").join(last.select("batch_id", "since", "end"), "batch_id")
    own = pages.filter((F.col("page.arrived_at") >= F.col("since")) & (F.col("page.arrived_at") <= F.col("end")))
    again = own.groupBy("batch_id", F.col("page.pos").alias("pos")).agg(F.max_by("page", F.struct("epoch", "page.arrived_at")).alias("page"))
    return last, again.select("page.*").drop("arrived_at")


def stream_merge(pages: DataFrame, base: str, gap: str = "10 minutes", keep: str = "30 days", late: str = "1 minute") -> DataStreamWriter:
    """A writer that merges batches as they close and writes an epoch's records below base, and what came below base/came."""
    rows, came = pages_and_closings(pages, gap, late), f"{base}/came"
    schema = rows.withColumn("epoch", F.lit(0).cast("long")).schema

    def write(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").partitionBy("closes").parquet(f"{came}/epoch={n}")
        closed, own = closed_pages(df.sparkSession, came, schema, n, keep)
        n_pages = closed.agg(F.sum("n")).first()[0] or 0
        merge_results(own, n_pages).join(closed.select("batch_id", "revision"), "batch_id").write.mode("overwrite").parquet(f"{base}/epoch={n}")

    return rows.writeStream.outputMode("append").foreachBatch(write)


def read_merged(spark: SparkSession, base: str) -> DataFrame:
    """The records of each batch's last revision."""
    rows = spark.read.option("basePath", base).parquet(f"{base}/epoch=*")
    last = rows.groupBy("batch_id").agg(F.max("revision").alias("revision"))
    return rows.join(last, ["batch_id", "revision"], "left_semi").drop("epoch")
