"""Inputs of the core operators drawn from the star schema, by expressions that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_K = "o_orderkey"
_MONEY = "cast(cast(o_totalprice as decimal(12,2)) as string)"
_TWO = "lpad(cast({} as string), 2, '0')"
_US_DATE = f"{_TWO.format('month(o_orderdate)')} || '/' || {_TWO.format('day(o_orderdate)')} || '/' || cast(year(o_orderdate) as string)"

INVOICE_TEXT = (
    f"'  ' || chr(10) || ' Vendor ' || cast(o_custkey as string) || ' ' || chr(10)"
    f" || case when {_K} % 5 <> 0 then 'Invoice No: INV-' || cast({_K} as string) || chr(10) when {_K} % 10 = 0 then 'Inv: 7' || cast({_K} as string) || chr(10) else '' end"
    f" || case when {_K} % 7 <> 0 then 'Invoice Date: ' || {_US_DATE} || chr(10) else '' end"
    f" || case when {_K} % 11 = 0 then 'shift 2' || chr(10) when {_K} % 13 = 0 then 'Loto' || chr(10) else '' end"
    f" || case when {_K} % 3 = 0 then 'Amount Due: ' || {_MONEY} when {_K} % 3 = 1 then 'Grand Total $ 1,' || {_MONEY} else 'no sum' end"
)
ID_TEXT = (
    "case when c_custkey % 4 <> 0 then 'DL: ' || lpad(cast(c_custkey as string), 8, '0') || ' ' else 'Notification ' end"
    " || case when c_custkey % 5 <> 0 then 'Exp: ' || lpad(cast(1 + c_custkey % 12 as string), 2, '0') || '/' || lpad(cast(1 + c_custkey % 30 as string), 2, '0') || '/' || cast(2015 + c_custkey % 20 as string) || ' ' else '' end"
    " || case when c_custkey % 6 <> 0 then 'dob ' || lpad(cast(1 + c_custkey % 13 as string), 2, '0') || '-' || lpad(cast(1 + c_custkey % 28 as string), 2, '0') || '-' || cast(1950 + c_custkey % 80 as string) || ' ' else '' end"
    " || case when c_custkey % 2 = 0 then 'Sex: F' else 'Gender m' end || case when c_custkey % 3 = 0 then ' HGT: 5-10' else '' end"
)

#: Columns of page results, flat: batches of eight pages with numbers, totals, shift details and gaps.
PAGE_COLUMNS = {
    "batch_id": f"cast(floor({_K} / 8) as bigint)",
    "pos": f"cast({_K} % 8 as int)",
    "filename": f"'f' || cast({_K} as string) || '.png'",
    "empty": "o_custkey % 17 = 0",
    "number": f"case when {_K} % 8 < 2 then 'A' || cast(cast(floor({_K} / 8) as bigint) as string) when {_K} % 8 = 2 then ' B' || cast(o_custkey % 3 as string) || ' ' when {_K} % 8 = 3 then '' end",
    "total": f"case when {_K} % 8 <> 7 then cast(floor({_K} / 8) % 97 + {_K} % 2 * 0.5 + o_custkey % 2 as double) end",
    "doc_type": f"case {_K} % 5 when 0 then 'Shift Report' when 1 then 'invoice' when 3 then 'Lottery Report' when 4 then 'Other' end",
    "vendor": "case when o_custkey % 3 = 0 then 'V' || cast(o_custkey % 2 as string) when o_custkey % 3 = 1 then '' end",
    "day": f"case when {_K} % 4 < 2 then '2025-01-01' end",
    "phone": f"case when {_K} % 4 = 1 then '' when {_K} % 4 = 2 then 'P' || cast({_K} as string) end",
    "fuel": "case when o_custkey % 3 = 0 then cast(o_custkey as double) end",
    "merch": "case when o_custkey % 5 = 0 then cast(o_custkey as double) end",
    "n_items": "cast(o_custkey % 3 as int)",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows of a scan anew where its files make fewer partitions than there are cores, for work that weighs on each row.

    Files of a large table make more, and then nothing is moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def select_sql(columns: dict[str, str], source: str) -> str:
    return "SELECT " + ", ".join(f"{v} AS {k}" for k, v in columns.items()) + f" FROM {source}"


def invoice_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "orders").selectExpr("o_orderkey as doc_id", f"{INVOICE_TEXT} as text"))


def id_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "customer").selectExpr("c_custkey as doc_id", f"{ID_TEXT} as text"))


def page_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = table(spark, sf_dir, "orders").selectExpr(*(f"{v} as {k}" for k, v in PAGE_COLUMNS.items()))
    none, money = F.lit(None).cast("string"), F.lit(None).cast("double")
    items = F.when(F.col("n_items") > 0, F.transform(F.sequence(F.lit(1), F.greatest("n_items", F.lit(1))), lambda i: F.struct(F.concat_ws("-", "filename", i).alias("description"), i.cast("double").alias("quantity"), money.alias("unit_price"), money.alias("total_price"), none.alias("product_code"))))
    data = F.struct(
        F.col("doc_type").alias("doc_type"),
        F.struct(F.col("vendor").alias("name"), F.col("phone").alias("phone"), none.alias("address"), none.alias("website")).alias("vendor"),
        F.struct(F.col("number").alias("number"), F.col("day").alias("date"), none.alias("due_date"), none.alias("po_number")).alias("invoice_details"),
        F.struct(F.col("total").alias("total_amount"), *(money.alias(k) for k in ("subtotal", "tax", "credits", "balance_due"))).alias("financials"),
        items.alias("line_items"),
        F.struct(money.alias("total_sales"), F.col("fuel").alias("fuel_sales"), F.col("merch").alias("merch_sales"), money.alias("cash_drop")).alias("shift_report_details"),
    )
    return flat.select("batch_id", "pos", "filename", F.lit("patterns").alias("model_used"), F.when(F.col("empty"), "{}").alias("data_json"), F.struct(F.lit(60).alias("confidence"), data.alias("data")).alias("extracted"))


def line_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, a page per line: doc_id, page_no, text."""
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text")).select("doc_id", (F.col("n") + 1).alias("page_no"), "text")
