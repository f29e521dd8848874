"""Texts, manifests, claims and analysis answers as tables; the chunk index on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docjobs.schemas import ANALYSIS, CLAIMS

# Suffixes by what reads them, and those that chat loads.
ROUTES = {".jpg": "image", ".jpeg": "image", ".png": "image", ".bmp": "image", ".tiff": "image", ".pdf": "pdf", ".docx": "docx"}
CHAT_SUFFIXES = (".pdf", ".docx", ".txt")


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per UTF-8 file: source, text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, length, modificationTime of files, without reading them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")


def route_by_suffix(files: DataFrame, path: str = "path") -> DataFrame:
    """files plus suffix, route and chat_loads."""
    suffix = F.lower(F.regexp_extract(F.col(path), r"[^/](\.[^./]+)$", 1))
    route = F.lit("unsupported")
    for s, r in ROUTES.items():
        route = F.when(F.col("suffix") == s, r).otherwise(route)
    return files.withColumn("suffix", suffix).withColumns({"route": route, "chat_loads": F.col("suffix").isin(*CHAT_SUFFIXES)})


def parse_claims(df: DataFrame, col: str = "claims_json") -> tuple[DataFrame, DataFrame]:
    """Claims as rows to check (doc_id, ord, id, type, value), and the rows of df whose JSON is not an object.

    Unknown keys are ignored; clauses keep the number they have in their list.
    """
    ok = F.coalesce(F.col(col).rlike(r"^[ \t\n\r]*\{") & F.try_parse_json(col).isNotNull(), F.lit(False))
    good = df.filter(ok).withColumn("_c", F.from_json(col, CLAIMS))
    one = lambda ord_, id_, type_, value: F.struct(F.lit(ord_).cast("int").alias("ord"), F.lit(id_).alias("id"), F.lit(type_).alias("type"), value.alias("value"))
    parties = F.array(
        one(0, "party_a_name", "party_name", F.col("_c.party_a.name")), one(1, "party_a_address", "address", F.col("_c.party_a.address")),
        one(2, "party_b_name", "party_name", F.col("_c.party_b.name")), one(3, "party_b_address", "address", F.col("_c.party_b.address")),
    )
    value = lambda x: F.coalesce(F.nullif(x["expected_text"], F.lit("")), x["clause"])
    clauses = F.transform(F.coalesce("_c.expected_changes", F.array()), lambda x, i: F.struct((i + 4).cast("int").alias("ord"), F.concat(F.lit("clause_"), i.cast("string")).alias("id"), F.lit("clause_change").alias("type"), value(x).alias("value")))
    rows = good.select("doc_id", F.explode(F.concat(parties, clauses)).alias("r")).select("doc_id", "r.*").filter("coalesce(value, '') <> ''")
    return rows, df.filter(~ok)


def conform_metadata(df: DataFrame, col: str = "answer") -> DataFrame:
    """df plus meta (the fixed schema) and page_count (null where it is no number)."""
    out = df.withColumn("meta", F.from_json(col, ANALYSIS))
    return out.withColumn("page_count", F.expr("try_cast(meta.PageCount as int)"))


def write_chunk_index(chunks: DataFrame, path: str, mode: str = "append") -> None:
    chunks.write.mode(mode).partitionBy("session_id").parquet(path)


def read_chunk_index(spark: SparkSession, path: str, session_id: str | None = None) -> DataFrame:
    """The index, or the chunks of one session (a partition of the files)."""
    df = spark.read.parquet(path)
    return df if session_id is None else df.filter(F.col("session_id") == session_id)
