"""Fields of invoices from page text: one projection of built-in expressions, no shuffle."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docjobs.functions.text import LINE_END, first_match, strip

# The patterns of the fields and their groups, tried in this order on upper-cased text.
TOTAL_PATTERNS = (
    (r"TOTAL\s*SALES\s*[:.]?\s*[\$]?\s*([0-9,]+[.,][0-9]{2})", 1),
    (r"INVOICE\s*TOTAL\s*[:.]?\s*[\$]?\s*([0-9,]+[.,][0-9]{2})", 1),
    (r"AMOUNT\s*DUE\s*[:.]?\s*[\$]?\s*([0-9,]+[.,][0-9]{2})", 1),
    (r"TOTAL\s*(AMOUNT|DUE)?\s*[:.]?\s*[\$]?\s*([0-9,]+[.,][0-9]{2})", 2),
    (r"BALANCE\s*DUE\s*[:.]?\s*[\$]?\s*([0-9,]+[.,][0-9]{2})", 1),
    (r"GRAND\s*TOTAL\s*[:.]?\s*[\$]?\s*([0-9,]+[.,][0-9]{2})", 1),
)
DATE_PATTERNS = (
    (r"(INVOICE|BILL|DUE)\s*DATE\s*[:.]?\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})", 2),
    (r"DATE\s*[:.]?\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})", 1),
    (r"(\d{4}[-]\d{2}[-]\d{2})", 1),
)
NUMBER_PATTERNS = (
    (r"(INVOICE|BILL)\s*(NO|NUMBER|#)?\s*[:.]?\s*([A-Za-z0-9\-]+)", 3),
    (r"INV\s*[:.]?\s*([A-Za-z0-9\-]+)", 1),
)
SHIFT_WORDS = ("TILL", "SHIFT", "PUMP", "REGISTER", "SAFE LOANS")
LOTTERY_WORDS = ("MEGA", "LOTO", "SCRATCH", "JACKPOT")


def classify_doc_type(upper: Column) -> Column:
    """invoice, unless the text holds a word of shift or else of lottery reports anywhere."""
    return F.when(upper.rlike("|".join(SHIFT_WORDS)), "shift_report").when(upper.rlike("|".join(LOTTERY_WORDS)), "lottery_report").otherwise("invoice")


def _any(upper: Column, *words: str) -> Column:
    """Whether the text holds a word without which no pattern matches: found much sooner than that none does."""
    return functools.reduce(Column.__or__, (upper.contains(w) for w in words))


def extract_total_amount(upper: Column) -> Column:
    """The first total, as text: commas become points, and only the last point stays."""
    found = F.when(_any(upper, "TOTAL", "DUE"), F.coalesce(*(first_match(upper, p, g) for p, g in TOTAL_PATTERNS)))
    return F.regexp_replace(F.translate(found, ",", "."), r"\.(?=.*\.)", "")


def extract_invoice_date(upper: Column) -> Column:
    labelled, plain = DATE_PATTERNS[:-1], DATE_PATTERNS[-1]
    return F.coalesce(F.when(upper.contains("DATE"), F.coalesce(*(first_match(upper, p, g) for p, g in labelled))), first_match(upper, *plain))


def extract_invoice_number(upper: Column) -> Column:
    """The first pattern's first match counts if it has a digit; else the next pattern is tried."""
    values = (first_match(first_match(upper, p, g), "[^0-9]*[0-9].*", 0) for p, g in NUMBER_PATTERNS)
    return F.when(_any(upper, "INV", "BILL"), F.coalesce(*values))


def vendor_name_guess(text: Column) -> Column:
    """The first line that is not blank."""
    lines = F.transform(F.split(text, LINE_END), strip)
    return F.get(F.filter(lines, lambda x: x != ""), 0)


def invoice_confidence(total: Column, date: Column, number: Column) -> Column:
    """33 for each field found, 60 at least if the total is among them."""
    n = sum((c.isNotNull().cast("int") for c in (total, date, number)), F.lit(0))
    score = F.least(n * 33, F.lit(100))
    return F.when(total.isNotNull(), F.greatest(score, F.lit(60))).otherwise(score)


def extract_invoices(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without text, plus data (a struct of strings), confidence and doc_type."""
    base = docs.withColumn("_text", F.coalesce(F.col(text), F.lit(""))).withColumn("_upper", F.upper("_text"))
    upper = F.col("_upper")
    fields = base.withColumns({
        "_type": classify_doc_type(upper),
        "_total": extract_total_amount(upper),
        "_date": extract_invoice_date(upper),
        "_number": extract_invoice_number(upper),
        "_vendor": vendor_name_guess(F.col("_text")),
    })
    data = F.struct(F.col("_type").alias("detected_type"), F.col("_total").alias("total_amount"), F.col("_date").alias("invoice_date"), F.col("_number").alias("invoice_number"), F.col("_vendor").alias("vendor_name_guess"))
    kept = [c for c in docs.columns if c not in (text, "data", "confidence", "doc_type")]
    return fields.select(*kept, data.alias("data"), invoice_confidence(F.col("_total"), F.col("_date"), F.col("_number")).alias("confidence"), F.col("_type").alias("doc_type"))
