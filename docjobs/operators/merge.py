"""Merging of page results into one record per document.

All rules are local to a batch, so the pages are dealt by batch once; every window and aggregate below includes
batch_id and reuses that exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docjobs.functions.text import strip
from docjobs.schemas import SHIFT_FIELDS

INVOICE_GROUP, SHIFT_GROUP, SINGLE = 0, 1, 2
#: Pages that a task is meant to hold; each of its windows sorts them.
ROWS = 1 << 17
#: The key of the group that headerless shift pages form where no page has both date and vendor.
SYNTHETIC = ("Unknown Date", "Shift Report")

_DATA = "extracted.data"


def _truthy(c):
    return F.coalesce(c, F.lit("")) != ""


def deal(pages: DataFrame, n_pages: int | None = None) -> DataFrame:
    """The pages dealt by batch over as many tasks as their number asks for (they are counted if it is not given)."""
    n = pages.count() if n_pages is None else n_pages
    return pages.repartition(max(pages.sparkSession.sparkContext.defaultParallelism, -(-n // ROWS)), "batch_id")


def group_by_invoice_number(pages: DataFrame) -> DataFrame:
    """Pages with data, plus num_key, first_pos and total. A number of white space alone groups under ''."""
    raw = F.trim(F.coalesce(F.col("data_json"), F.lit("")))
    empty = F.when(F.col("data_json").isNotNull(), raw.rlike(r"^(\{\s*\}|null)?$")).otherwise(F.col(_DATA).isNull())
    number = F.col(f"{_DATA}.invoice_details.number")
    kept = pages.filter(~empty).withColumn("num_key", F.when(_truthy(number), strip(number))).withColumn("total", F.col(f"{_DATA}.financials.total_amount"))
    return kept.withColumn("first_pos", F.when(F.col("num_key").isNotNull(), F.min("pos").over(Window.partitionBy("batch_id", "num_key"))))


def attach_orphans_by_total(pages: DataFrame) -> DataFrame:
    """Plus hit_key, hit_pos: the first-seen number whose first page has exactly the orphan's total."""
    founder = F.col("num_key").isNotNull() & (F.col("pos") == F.col("first_pos"))
    hit = F.min(F.when(founder, F.struct("pos", "num_key"))).over(Window.partitionBy("batch_id", "total"))
    orphan = F.col("num_key").isNull() & F.col("total").isNotNull() & ~F.isnan("total")
    return pages.withColumn("_hit", F.when(orphan, hit)).withColumns({"hit_key": F.col("_hit.num_key"), "hit_pos": F.col("_hit.pos")}).drop("_hit")


def group_shift_reports(pages: DataFrame) -> DataFrame:
    """Plus unmatched, ord1 (where its total was first seen), has_shift, strong (a shift page with date and vendor)."""
    unmatched = F.col("num_key").isNull() & F.col("hit_key").isNull()
    known = F.when(~F.isnan("total"), F.col("total"))
    # Not a number never equals itself, so each such page keeps a place of its own.
    place = F.when(F.isnan("total"), F.col("pos")).otherwise(F.min(F.when(F.col("unmatched"), F.col("pos"))).over(Window.partitionBy("batch_id", "unmatched", known, F.coalesce(F.isnan("total"), F.lit(False)))))
    kind = F.lower(F.coalesce(F.col(f"{_DATA}.doc_type"), F.lit("")))
    has_shift = F.coalesce(F.greatest(*(F.col(f"{_DATA}.shift_report_details.{k}").isNotNull() for k in SHIFT_FIELDS)), F.lit(False))
    vendor, date = F.col(f"{_DATA}.vendor.name"), F.col(f"{_DATA}.invoice_details.date")
    out = pages.withColumn("unmatched", unmatched).withColumn("ord1", place).withColumn("has_shift", has_shift)
    like = kind.contains("shift") | kind.contains("audit") | kind.contains("report") | F.col("has_shift")
    return out.withColumn("strong", F.col("unmatched") & like & _truthy(vendor) & _truthy(date)).withColumns({"shift_date": F.when(F.col("strong"), date), "shift_vendor": F.when(F.col("strong"), vendor)})


def attach_headerless_pages(pages: DataFrame) -> DataFrame:
    """Plus kind, group_key, seq (a page's place in its group).

    With one shift group in the batch, all other pages with shift details join it; with none and more than one such
    page, these form a group.
    """
    batch = Window.partitionBy("batch_id")
    key = F.when(F.col("strong"), F.struct("shift_date", "shift_vendor"))
    weak = F.col("unmatched") & ~F.col("strong") & F.col("has_shift")
    # the batch has one strong key where its least and its greatest are equal
    out = pages.withColumns({"_low": F.min(key).over(batch), "_high": F.max(key).over(batch), "_weak": F.sum(weak.cast("int")).over(batch)})
    one = F.col("_low").isNotNull() & (F.col("_low") == F.col("_high"))
    joins = weak & (one | (F.col("_low").isNull() & (F.col("_weak") > 1)))
    kind = F.when(~F.col("unmatched"), INVOICE_GROUP).when(F.col("strong") | joins, SHIFT_GROUP).otherwise(SINGLE)
    synthetic = F.struct(F.lit(SYNTHETIC[0]).alias("shift_date"), F.lit(SYNTHETIC[1]).alias("shift_vendor"))
    shift_key = F.when(F.col("strong"), key).when(joins, F.coalesce("_low", synthetic))
    none = F.lit(None).cast("string")
    out = out.withColumn("kind", kind).withColumn("_shift", shift_key)
    group = F.struct(
        F.when(F.col("kind") == INVOICE_GROUP, F.coalesce("num_key", "hit_key")).otherwise(none).alias("number"),
        F.when(F.col("kind") == SHIFT_GROUP, F.col("_shift.shift_date")).otherwise(none).alias("date"),
        F.when(F.col("kind") == SHIFT_GROUP, F.col("_shift.shift_vendor")).otherwise(none).alias("vendor"),
        F.when(F.col("kind") == SINGLE, F.col("pos")).alias("pos"),
    )
    late = F.when(F.col("kind") == INVOICE_GROUP, F.col("num_key").isNull()).otherwise(joins).cast("int")
    seq = F.struct(late.alias("stage"), F.when(F.col("unmatched"), F.col("ord1")).otherwise(F.lit(0)).alias("ord1"), F.col("pos").alias("pos"))
    return out.withColumn("group_key", group).withColumn("seq", seq).drop("_low", "_high", "_weak", "_shift")


def merge_group(pages: DataFrame) -> DataFrame:
    """One record per group: the first page, with all line items in order, the first phone, and blanks of the shift details filled."""
    data = F.col(_DATA)
    first = lambda c, cond: F.min(F.when(cond, F.struct(F.col("seq").alias("s"), c.alias("v"))))
    phone = F.col(f"{_DATA}.vendor.phone")
    out = pages.groupBy("batch_id", "kind", "group_key").agg(
        F.min_by(F.struct("filename", "model_used", F.col("extracted.confidence").alias("confidence"), data.alias("data")), "seq").alias("m"),
        F.count("*").cast("int").alias("n"),
        F.min("seq").alias("start"),
        F.array_sort(F.collect_list(F.struct("seq", F.col("filename").alias("f"), F.coalesce(F.col(f"{_DATA}.line_items"), F.array()).alias("items")))).alias("parts"),
        first(phone, _truthy(phone)).alias("phone"),
        F.bool_or(F.col(f"{_DATA}.shift_report_details").isNotNull()).alias("any_shift"),
        *(first(F.col(f"{_DATA}.shift_report_details.{k}"), F.col(f"{_DATA}.shift_report_details.{k}").isNotNull()).alias(k) for k in SHIFT_FIELDS),
    )
    merged = F.col("n") > 1
    vendor = F.when(F.col("phone.v").isNotNull(), F.coalesce(F.col("m.data.vendor"), F.struct(*(F.lit(None).cast("string").alias(k) for k in ("name", "phone", "address", "website")))).withField("phone", F.col("phone.v"))).otherwise(F.col("m.data.vendor"))
    shift = F.when(F.col("any_shift"), F.struct(*(F.col(f"{k}.v").alias(k) for k in SHIFT_FIELDS)))
    full = F.col("m.data").withField("line_items", F.flatten(F.transform("parts", lambda p: p["items"]))).withField("vendor", vendor).withField("shift_report_details", shift)
    return out.select(
        "batch_id", "kind", "group_key", "start", F.col("m.filename").alias("filename"), F.col("m.model_used").alias("model_used"), F.col("m.confidence").alias("confidence"),
        F.when(merged, full).otherwise(F.col("m.data")).alias("data"),
        F.when(merged, True).alias("is_merged"), F.when(merged, F.col("n")).alias("merged_page_count"), F.when(merged, F.transform("parts", lambda p: p["f"])).alias("original_filenames"),
    )


def merge_results(pages: DataFrame, n_pages: int | None = None) -> DataFrame:
    """One record per document; out_pos gives the order in a batch: invoice groups, shift groups, single pages."""
    grouped = attach_headerless_pages(group_shift_reports(attach_orphans_by_total(group_by_invoice_number(deal(pages, n_pages)))))
    # invoice groups stand in the order of their first pages, the others in that of their totals
    place = Window.partitionBy("batch_id").orderBy("kind", F.col("start.stage"), F.col("start.ord1"), F.col("start.pos"))
    return merge_group(grouped).withColumn("out_pos", F.row_number().over(place) - 1).drop("start", "group_key")


def merge_counts(pages: DataFrame, merged: DataFrame) -> DataFrame:
    """batch_id, batch_count (pages that came in), merged_count (records that came out)."""
    came = pages.groupBy("batch_id").agg(F.count("*").alias("batch_count"))
    left = merged.groupBy("batch_id").agg(F.count("*").alias("merged_count"))
    return came.join(left, "batch_id", "full").select("batch_id", F.coalesce("batch_count", F.lit(0).cast("long")).alias("batch_count"), F.coalesce("merged_count", F.lit(0).cast("long")).alias("merged_count"))
