"""Page-marked texts, their parts, and page-wise comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docjobs.functions.text import strip

#: What stands before and after a page's number, and whether blank pages are left out.
STYLES = {"analysis": ("\n--- Page ", " ---\n", False), "compare": ("\n --- Page ", " --- \n", True)}


def _in_order(order: Column, text: Column, between: str) -> Column:
    """The group's texts in order, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x["t"]), between)


def assemble_pages(pages: DataFrame, style: str = "analysis") -> DataFrame:
    """pages (doc_id, page_no, text) -> doc_id, text with a marker before each page."""
    before, after, skip = STYLES[style]
    text = F.coalesce("text", F.lit(""))
    marked = F.concat(F.lit(before), F.col("page_no").cast("string"), F.lit(after), text)
    if skip:
        marked = F.when(strip(text) != "", marked)  # nulls are left out when joined, and blank documents stay
    return pages.groupBy("doc_id").agg(_in_order(F.col("page_no"), marked, "\n").alias("text"))


def split_pages(docs: DataFrame, style: str = "analysis") -> DataFrame:
    """The inverse: doc_id, page_no, text; texts without a marker give no pages."""
    before, after, _ = STYLES[style]
    number = before.strip("\n") + r"(\d+)" + after
    # the line feed that joins pages is not part of a page
    parts = F.split(F.concat(F.lit("\n"), "text"), "\n\n" + number, -1)
    numbers = F.regexp_extract_all(F.concat(F.lit("\n"), "text"), F.lit("\n\n" + number), 1)
    zipped = F.arrays_zip(numbers.alias("page_no"), F.slice(parts, F.lit(2), F.size(parts)).alias("text"))
    return docs.select("doc_id", F.explode(zipped).alias("p")).select("doc_id", F.col("p.page_no").cast("int").alias("page_no"), F.col("p.text").alias("text"))


def combine_documents(files: DataFrame) -> DataFrame:
    """files (session_id, name, text) -> session_id, text: PDF files by name, each under its name."""
    pdf = files.filter(F.lower("name").endswith(".pdf"))
    part = F.concat(F.lit("Document: "), "name", F.lit("\n"), F.coalesce("text", F.lit("")))
    return pdf.groupBy("session_id").agg(_in_order(F.col("name"), part, "\n\n").alias("text"))


def concat_for_analysis(docs: DataFrame, key: str = "group_id") -> DataFrame:
    """docs (key, ord, source, file_path, text) -> key, text: each document under its source."""
    empty = lambda c: F.nullif(F.col(c), F.lit(""))
    source = F.coalesce(empty("source"), empty("file_path"), F.lit("unknown"))
    part = F.concat(F.lit("\n--- SOURCE: "), source, F.lit(" ---\n"), F.coalesce("text", F.lit("")))
    return docs.groupBy(key).agg(_in_order(F.col("ord"), part, "\n").alias("text"))


def concat_for_comparison(ref: DataFrame, act: DataFrame, key: str = "pair_id") -> DataFrame:
    """key, text: the reference documents, then the actual ones."""
    left, right = concat_for_analysis(ref, key).withColumnRenamed("text", "l"), concat_for_analysis(act, key).withColumnRenamed("text", "r")
    both = left.join(right, key, "full")
    return both.select(key, F.concat(F.lit("<<REFERENCE_DOCUMENTS>>\n"), F.coalesce("l", F.lit("")), F.lit("\n\n<<ACTUAL_DOCUMENTS>>\n"), F.coalesce("r", F.lit(""))).alias("text"))


def compare_pages(ref: DataFrame, act: DataFrame) -> DataFrame:
    """ref, act (pair_id, page_no, text) -> pair_id, page_no, status, added, removed (distinct lines).

    Lines are only split where the texts differ.
    """
    left, right = ref.select("pair_id", "page_no", F.coalesce("text", F.lit("")).alias("l"), F.lit(True).alias("in_l")), act.select("pair_id", "page_no", F.coalesce("text", F.lit("")).alias("r"), F.lit(True).alias("in_r"))
    both = left.join(right, ["pair_id", "page_no"], "full")
    status = F.when(F.col("in_r").isNull(), "REMOVED").when(F.col("in_l").isNull(), "ADDED").when(F.col("l") == F.col("r"), "NO CHANGE").otherwise("CHANGED")
    lines = lambda c: F.when(F.col(c).isNotNull(), F.split(c, "\n")).otherwise(F.array().cast("array<string>"))
    out = both.withColumn("status", status)
    same = F.col("status") == "NO CHANGE"
    none = F.array().cast("array<string>")
    return out.select("pair_id", "page_no", "status", F.when(same, none).otherwise(F.array_except(lines("r"), lines("l"))).alias("added"), F.when(same, none).otherwise(F.array_except(lines("l"), lines("r"))).alias("removed"))
