"""Cache, retention, and figures over results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Results of more than this confidence are cached; session folders that stay.
CACHE_ABOVE, KEEP_SESSIONS = 50, 3


def cache_lookup(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """requests (request_id, user_id, ...) -> those with a cached record (plus record), and the rest."""
    known = cache.filter(F.col("record").isNotNull() & (F.col("record") != "")).select("user_id", "record")
    asked = requests.filter(F.col("user_id").isNotNull())
    hits = asked.join(known, "user_id")
    rest = requests.join(known, "user_id", "left_anti")
    return hits.withColumn("source", F.lit("cache")), rest.withColumn("source", F.lit("ocr"))


def cache_upsert(cache: DataFrame, results: DataFrame) -> DataFrame:
    """The cache after results: the last record of each user by (ts, id). max_by combines in the map tasks."""
    new = results.filter(F.col("user_id").isNotNull() & (F.col("confidence") > CACHE_ABOVE)).select("user_id", "ts", "id", "record")
    both = cache.select("user_id", "ts", "id", "record").unionByName(new)
    return both.groupBy("user_id").agg(F.max_by(F.struct("ts", "id", "record"), F.struct("ts", "id")).alias("r")).select("user_id", "r.*")


def retain_latest(sessions: DataFrame, keep: int = KEEP_SESSIONS) -> DataFrame:
    """sessions (base, session, unique) plus kept: the latest names of each base stay.

    Only the first `keep` of each base are ranked, which Spark limits in the map tasks; the rest compare with the last of them.
    """
    order = Window.partitionBy("base").orderBy(F.desc("session"))
    latest = sessions.select("base", "session").withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= keep)
    oldest = latest.groupBy("base").agg(F.min("session").alias("_oldest"))
    return sessions.join(oldest, "base", "left").withColumn("kept", F.coalesce(F.col("session") >= F.col("_oldest"), F.lit(False))).drop("_oldest")


def extraction_summary(results: DataFrame) -> DataFrame:
    """processed, found (results with a confidence over 0)."""
    return results.agg(F.count("*").alias("processed"), F.count_if(F.col("confidence") > 0).alias("found"))


def results_metrics(log: DataFrame, digits: int = 4) -> DataFrame:
    """log (model, duration_seconds, confidence_score) -> a row per model.

    Durations have so many decimals in the log, so equal ones are counted first; the exact percentiles then see each
    value once, however many results a model has.
    """
    counted = log.groupBy("model", F.round("duration_seconds", digits).alias("d")).agg(F.count("*").alias("c"), F.count_if(F.col("confidence_score") > 0).alias("good"), F.sum("confidence_score").alias("conf"), F.count("confidence_score").alias("n_conf"))
    known = F.when(F.col("d").isNotNull(), F.col("c")).otherwise(0)
    return counted.groupBy("model").agg(
        F.sum("c").alias("n"), (F.sum("good") / F.sum("c")).alias("success_rate"),
        (F.sum(F.col("d") * F.col("c")) / F.nullif(F.sum(known), F.lit(0))).alias("avg_s"), F.percentile("d", F.lit(0.5), known).alias("median_s"), F.percentile("d", F.lit(0.95), known).alias("p95_s"), F.max("d").alias("max_s"),
        (F.sum("conf") / F.nullif(F.sum("n_conf"), F.lit(0))).alias("avg_confidence"),
    )


def ocr_page_stats(words: DataFrame, pages: DataFrame) -> DataFrame:
    """words (doc_id, page_no, conf as text or number), pages (doc_id, page_no, text) -> avg_conf and chars per page.

    Confidences that are no integers as text, or negative, don't count; blank pages go.
    """
    text = F.col("conf").cast("string")
    whole = F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), F.expr("try_cast(trim(cast(conf as string)) as bigint)"))
    value = whole if dict(words.dtypes)["conf"] == "string" else F.expr("try_cast(conf as bigint)")
    conf = words.withColumn("_v", value).groupBy("doc_id", "page_no").agg(F.avg(F.when(F.col("_v") >= 0, F.col("_v"))).alias("avg_conf"))
    kept = pages.filter(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)[\s\x1c-\x1f]", "") != "")
    return kept.join(conf, ["doc_id", "page_no"], "left").select("doc_id", "page_no", F.length("text").alias("chars"), "avg_conf")
