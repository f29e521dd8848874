"""Streaming forms of extraction, figures and dedupe. State is bounded by watermarks; sinks are idempotent by batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from docjobs.operators.invoices import extract_invoices
from docjobs.operators.store import cache_upsert
from docjobs.sources.shared import drop_folder, folder_exists

CACHE = "user_id bigint, ts timestamp, id bigint, record string"
#: Buckets of users in a cache that a stream keeps: a batch rewrites those of its users.
BUCKETS = 64
#: Size of the quantile sketches (rank error some 0.4 %).
SKETCH_K = 800


def stream_extract(docs: DataFrame) -> DataFrame:
    """The batch projection on a stream of texts: stateless, for an append sink with a checkpoint."""
    return extract_invoices(docs)


def stream_results_metrics(log: DataFrame, window: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """log (timestamp, model, duration_seconds, confidence_score) -> a row per window and model; late rows are dropped.

    Windows slide by ``slide``, or follow one another. Percentiles come from a sketch (``sketch``) of bounded size, whose rank
    error is below one in a hundred; rows of windows merge into longer ones by ``rollup_metrics``. A window without a duration has
    null percentiles.
    """
    timed = log.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", late)
    at = F.window("timestamp", window) if slide is None else F.window("timestamp", window, slide)
    took = timed.groupBy(at.alias("window"), "model").agg(
        F.count("*").alias("n"), F.count_if(F.col("confidence_score") > 0).alias("good"), F.avg("duration_seconds").alias("avg_s"), F.max("duration_seconds").alias("max_s"),
        F.avg("confidence_score").alias("avg_confidence"), F.sum("duration_seconds").alias("total_s"), F.count("duration_seconds").alias("timed"), F.kll_sketch_agg_double("duration_seconds", F.lit(SKETCH_K)).alias("sketch"),
    )
    return took.select(F.col("window.start").alias("window_start"), "model", "n", "avg_s", "max_s", "avg_confidence", (F.col("good") / F.col("n")).alias("success_rate"), *_quantiles(F.col("sketch"), F.col("timed")), "good", "total_s", "timed", "sketch")


def _quantiles(sketch: Column, n: Column) -> list[Column]:
    return [F.when(n > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(p))).alias(name) for name, p in (("median_s", 0.5), ("p95_s", 0.95))]


def rollup_metrics(windows: DataFrame) -> DataFrame:
    """Rows of ``stream_results_metrics`` (windows that follow one another) -> model, day, hour, and the same figures of each hour, of each day (hour is null) and of all (day is null too).

    Sketches are merged, so no duration is read again; the shuffle carries one row per window, model and level.
    """
    rows = windows.withColumns({"day": F.to_date("window_start"), "hour": F.hour("window_start")})
    keys = [F.col("model"), F.col("day"), F.col("hour")]
    out = rows.groupingSets([keys, keys[:2], keys[:1]], *keys).agg(
        F.sum("n").alias("n"), (F.sum("good") / F.sum("n")).alias("success_rate"), (F.sum("total_s") / F.nullif(F.sum("timed"), F.lit(0))).alias("avg_s"), F.max("max_s").alias("max_s"),
        F.sum("timed").alias("timed"), F.kll_merge_agg_double(F.when(F.col("timed") > 0, F.col("sketch"))).alias("sketch"),
    )
    return out.select("model", "day", "hour", "n", "success_rate", "avg_s", "max_s", *_quantiles(F.col("sketch"), F.col("timed")))


def stream_cache_lookup(requests: DataFrame, cache: DataFrame, valid: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """requests (request_id, user_id, ts), cache (user_id, ts, record), both streams -> each request once, with record and source.

    A request takes the last record of its user of at most ``valid`` before it (of equal times, the greatest); requests
    without one have source ``ocr`` and go to extraction, once, when the watermark says that no record can come any more.
    State is dropped by the watermark on both sides. Empty records don't count; request_id is unique.
    """
    asked = requests.select("request_id", F.col("user_id").alias("asked_by"), F.col("ts").cast("timestamp").alias("asked_at")).withWatermark("asked_at", late)
    known = cache.filter(F.coalesce("record", F.lit("")) != "").select("user_id", F.col("ts").cast("timestamp").alias("known_at"), "record").withWatermark("known_at", late)
    near = (F.col("asked_by") == F.col("user_id")) & (F.col("known_at") <= F.col("asked_at")) & (F.col("known_at") >= F.col("asked_at") - F.expr(f"interval {valid}"))
    met = asked.join(known, near, "left")
    last = met.groupBy("request_id", "asked_by", "asked_at").agg(F.max(F.when(F.col("record").isNotNull(), F.struct("known_at", "record"))).alias("last"))
    return last.select("request_id", F.col("asked_by").alias("user_id"), F.col("asked_at").alias("ts"), F.col("last.record").alias("record"), F.when(F.col("last").isNotNull(), "cache").otherwise("ocr").alias("source"))


def stream_dedupe(chunks: DataFrame, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """The first row per fingerprint within the watermark's reach."""
    return chunks.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(["fp"])


def read_cache(spark: SparkSession, base: str) -> DataFrame:
    """The cache that ``stream_cache_upsert`` keeps below base."""
    return spark.read.schema(f"{CACHE}, bucket int").parquet(f"{base}/cache").drop("bucket")


def create_cache(rows: DataFrame, base: str, buckets: int = BUCKETS) -> None:
    """Writes rows (user_id, ts, id, record) as the cache below base, in buckets of users."""
    dealt = rows.withColumn("bucket", _bucket(buckets)).repartition(buckets, "bucket")
    dealt.write.partitionBy("bucket").parquet(f"{base}/cache")


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int")


def upsert_batch(batch: DataFrame, n: int, base: str, initial: DataFrame | None = None, buckets: int = BUCKETS) -> None:
    """Upserts the n-th batch into the cache below base, which starts from initial if there is none yet.

    A batch rewrites the buckets of its users alone. What they become is staged first, as they can't be overwritten while
    they are read; a batch that is repeated after a failure finds its stage whole, and the stage goes when the buckets
    stand, so one version of the cache is kept.
    """
    spark = batch.sparkSession
    if not folder_exists(spark, f"{base}/cache/_SUCCESS"):
        drop_folder(spark, f"{base}/cache")
        create_cache(spark.createDataFrame([], CACHE) if initial is None else initial.select("user_id", "ts", "id", "record"), base, buckets)
    stage = f"{base}/stage-{n}"
    if not folder_exists(spark, f"{stage}/_SUCCESS"):
        touched = [r["bucket"] for r in batch.filter(F.col("user_id").isNotNull()).select(_bucket(buckets).alias("bucket")).distinct().collect()]  # one of `buckets` each
        old = spark.read.schema(f"{CACHE}, bucket int").parquet(f"{base}/cache").filter(F.col("bucket").isin(touched))
        cache_upsert(old, batch).withColumn("bucket", _bucket(buckets)).write.mode("overwrite").parquet(stage)
    staged = spark.read.schema(f"{CACHE}, bucket int").parquet(stage)
    staged.repartition(buckets, "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{base}/cache")
    drop_folder(spark, stage)


def stream_cache_upsert(results: DataFrame, base: str, initial: DataFrame | None = None, buckets: int = BUCKETS) -> DataStreamWriter:
    """A writer that runs ``upsert_batch`` on each batch; base belongs to the stream and its checkpoint."""
    return results.writeStream.foreachBatch(lambda batch, n: upsert_batch(batch, n, base, initial, buckets))
