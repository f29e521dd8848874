"""Fields of identity documents, their validation as of a given day, and a hook for rows of low confidence."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docjobs.functions.text import first_match

# The labelled patterns on upper-cased text; the value is group 2.
ID_PATTERNS = {
    "dob": r"(DOB|BIRTH)\s*[:.]?\s*(\d{2}[-/]\d{2}[-/]\d{4})",
    "expiration_date": r"(EXP|EXPIRES)\s*[:.]?\s*(\d{2}[-/]\d{2}[-/]\d{4})",
    "license_number": r"(DL|LIC|NO)\.?\s*[:#]?\s*([A-Z0-9]{7,})",
    "sex": r"(SEX|GENDER)\s*[:.]?\s*([MF])",
    "height": r"(HGT|HEIGHT)\s*[:.]?\s*(\d+['\-]\d+\"?)",
}
DATE_PATTERN = r"(\d{2}[-/]\d{2}[-/]\d{4})"
FALLBACK_BELOW, FALLBACK_CONFIDENCE = 80, 95
FIELDS = "struct<" + ",".join(f"{k}:string" for k in ID_PATTERNS) + ">"


def extract_id_fields(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs plus data, confidence (20 a field) and method."""
    base = docs.withColumn("_upper", F.upper(F.coalesce(F.col(text), F.lit(""))))
    data = F.struct(*(first_match(F.col("_upper"), p, 2).alias(k) for k, p in ID_PATTERNS.items()))
    out = base.withColumn("data", data)
    found = sum((F.col(f"data.{k}").isNotNull().cast("int") for k in ID_PATTERNS), F.lit(0))
    return out.withColumns({"confidence": F.least(found * 20, F.lit(100)), "method": F.lit("regex_heuristic")}).drop("_upper")


def find_dates(text: Column) -> Column:
    """All strings of the form dd/dd/dddd or dd-dd-dddd."""
    return F.regexp_extract_all(F.upper(F.coalesce(text, F.lit(""))), F.lit(f"(?U){DATE_PATTERN}"), 1)


def parse_us_date(value: Column) -> Column:
    """MM/DD/YYYY or MM-DD-YYYY, or null; one-digit months and days are accepted, two-digit years are not."""
    slashed = F.translate(value, "-", "/")
    return F.when(slashed.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_timestamp(slashed, F.lit("M/d/yyyy")))


def validate_ids(df: DataFrame, as_of: Column | str, data: str = "data") -> DataFrame:
    """df plus validation: valid, errors, warnings, age, is_expired, as of a moment that the caller names."""
    now = (F.lit(as_of) if isinstance(as_of, str) else as_of).cast("timestamp")
    df = df.withColumns({"_dob": parse_us_date(F.col(f"{data}.dob")), "_exp": parse_us_date(F.col(f"{data}.expiration_date"))})
    dob, exp = F.col("_dob"), F.col("_exp")
    given = lambda c: F.coalesce(F.col(f"{data}.{c}"), F.lit("")) != ""
    not_yet = (F.month(now) < F.month(dob)) | ((F.month(now) == F.month(dob)) & (F.dayofmonth(now) < F.dayofmonth(dob)))
    age = F.year(now) - F.year(dob) - not_yet.cast("int")
    expired = F.coalesce(exp < now, F.lit(False))
    reversed_ = F.coalesce(exp < dob, F.lit(False))
    unborn = F.coalesce(age < 0, F.lit(False))
    say = lambda cond, text: F.when(cond, F.lit(text))
    errors = F.array_compact(F.array(say(unborn, "Date of Birth is in the future."), say(expired, "ID is Expired."), say(reversed_, "Expiration Date is before Date of Birth.")))
    warnings = F.array_compact(F.array(
        F.when(given("dob") & dob.isNull(), F.lit("Unparseable DOB format.")).when((age >= 0) & (age < 18), F.lit("Under 18 years old.")).when((age >= 18) & (age < 21), F.lit("Under 21 years old.")),
        say(given("expiration_date") & exp.isNull(), "Unparseable Expiration Date."),
    ))
    validation = F.struct((~(unborn | expired | reversed_)).alias("valid"), errors.alias("errors"), warnings.alias("warnings"), age.alias("age"), expired.alias("is_expired"))
    return df.withColumn("validation", validation).drop("_dob", "_exp")


def id_with_fallback(df: DataFrame, fn: Callable[[str], dict | None] | None, text: str = "text") -> DataFrame:
    """Rows below FALLBACK_BELOW go to fn; what it returns replaces data. An error or no answer keeps the row."""
    if fn is None:
        return df
    low = F.coalesce(F.col("confidence") < FALLBACK_BELOW, F.lit(False))
    names = list(ID_PATTERNS)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, value in enumerate(pdf[text]):
                try:
                    answer = fn(value)
                except Exception:  # noqa: BLE001  a user's function may fail in any way; the row then stays as it is
                    answer = None
                if answer:
                    for k in names:
                        pdf.iat[i, pdf.columns.get_loc(f"_{k}")] = answer.get(k)
                    pdf.iat[i, pdf.columns.get_loc("confidence")] = FALLBACK_CONFIDENCE
                    pdf.iat[i, pdf.columns.get_loc("method")] = "llm_fallback"
            yield pdf

    flat = df.filter(low).select(*(c for c in df.columns if c != "data"), *(F.col(f"data.{k}").alias(f"_{k}") for k in names))
    asked = flat.mapInPandas(ask, flat.schema)
    back = asked.withColumn("data", F.struct(*(F.col(f"_{k}").alias(k) for k in names))).select(*df.columns)
    return df.filter(~low).unionByName(back)
