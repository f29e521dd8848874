"""The log of extraction results: JSON, one record per extraction, in a folder per model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docjobs.schemas import INVOICE, LOG_RECORD


def read_results_log(spark: SparkSession, path: str) -> DataFrame:
    """metadata, extraction, model_dir, file_time; reads both pretty-printed files and what write_results_log writes."""
    raw = spark.read.schema(LOG_RECORD).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    file = F.col("_metadata.file_path")
    folder = F.url_decode(F.regexp_replace(F.regexp_extract(file, r"/(?:model=)?([^/]+)/[^/]+$", 1), r"\+", "%2B"))  # paths come percent-encoded
    stamp = F.try_to_timestamp(F.nullif(F.regexp_extract(file, r"/(\d{8}_\d{6})_[^/]*$", 1), F.lit("")), F.lit("yyyyMMdd_HHmmss"))
    return raw.select("metadata", "extraction", folder.alias("model_dir"), stamp.alias("file_time"))


def log_record(filename: Column, timestamp: Column, model: Column, duration: Column, confidence: Column, extraction: Column) -> list[Column]:
    """metadata and extraction; durations have four decimals."""
    metadata = F.struct(filename.alias("filename"), F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), model.alias("model"), F.round(duration, 4).alias("duration_seconds"), confidence.cast("double").alias("confidence_score"))
    return [metadata.alias("metadata"), extraction.alias("extraction")]


def write_results_log(df: DataFrame, path: str) -> None:
    """Appends records (metadata, extraction) below path, by model; a file holds many records, one a line."""
    df.withColumn("model", F.col("metadata.model")).write.mode("append").partitionBy("model").option("multiLine", False).json(path)


def parse_model_json(df: DataFrame, col: str = "content", method: str = "vision_model") -> DataFrame:
    """df plus data, confidence, method, error: a model's answer, with or without code fences, as a record."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.col(col), "```json", ""), "```", ""), F.lit(" \t\n\r\f\x0b"))
    parsed = df.withColumn("_bare", bare).withColumn("_ok", F.coalesce(F.try_parse_json("_bare").isNotNull(), F.lit(False)))
    ok = F.col("_ok")
    out = parsed.withColumns({
        "data": F.when(ok, F.from_json("_bare", INVOICE)),
        "confidence": F.when(ok, 95).otherwise(0),
        "method": F.when(ok, method),
        "error": F.when(~ok, "the answer is not JSON"),
    })
    return out.drop("_bare", "_ok")


def conform_results(df: DataFrame, flat: str = "data") -> DataFrame:
    """Flat results (of patterns or of an older model) as the nested record; df plus conformed."""
    names = {f.name for f in df.schema[flat].dataType.fields}
    get = lambda *cs: F.coalesce(*(F.col(f"{flat}.{c}") for c in cs if c in names), F.lit(None))
    nothing = F.from_json(F.lit("{}"), INVOICE)
    total = F.expr(f"try_cast({flat}.total_amount as double)") if "total_amount" in names else F.lit(None).cast("double")
    vendor = F.struct(get("vendor_name", "vendor_name_guess").cast("string").alias("name"), *(F.lit(None).cast("string").alias(k) for k in ("phone", "address", "website")))
    details = F.struct(get("invoice_number").cast("string").alias("number"), get("invoice_date").cast("string").alias("date"), *(F.lit(None).cast("string").alias(k) for k in ("due_date", "po_number")))
    money = F.struct(total.alias("total_amount"), *(F.lit(None).cast("double").alias(k) for k in ("subtotal", "tax", "credits", "balance_due")))
    return df.withColumn("conformed", nothing.withField("doc_type", get("doc_type", "detected_type").cast("string")).withField("vendor", vendor).withField("invoice_details", details).withField("financials", money))
