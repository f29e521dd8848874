import pytest

from docjobs.operators.invoices import extract_invoices
from docjobs.operators.store import extraction_summary

CASES = [
    ("INVOICE NO: A-12\nINVOICE DATE: 01/02/2025\nTOTAL AMOUNT: $1,234.56", ("A-12", "01/02/2025", "1234.56", 99, "invoice")),
    ("SUBTOTAL 5.00\nGRAND TOTAL 9.00", (None, None, "5.00", 60, "invoice")),
    ("STILL OPEN", (None, None, None, 0, "shift_report")),
    ("INVOICE DATE 1/2/25", (None, "1/2/25", None, 33, "invoice")),
    ("INVOICE NOTE 5 / INV: 77", (None, None, None, 0, "invoice")),
    ("Total sales 1,234,567.89", (None, None, "1234567.89", 60, "invoice")),
    ("loto ticket 2024-05-06", (None, "2024-05-06", None, 33, "lottery_report")),
    (None, (None, None, None, 0, "invoice")),
    ("", (None, None, None, 0, "invoice")),
]


@pytest.mark.parametrize("text, expected", CASES)
def test_fields(spark, text, expected):
    r = extract_invoices(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.data.invoice_number, r.data.invoice_date, r.data.total_amount, r.confidence, r.doc_type) == expected


def test_vendor_is_the_first_line_that_is_not_blank(spark):
    r = extract_invoices(spark.createDataFrame([("\f \r\n  Corner Shop \x1c\nTill 4",)], "text string")).first()
    assert r.data.vendor_name_guess == "Corner Shop"


def test_clashing_columns_and_summary(spark):
    df = spark.createDataFrame([(1, "TOTAL 1.00", 7), (2, "x", 8)], "doc_id long, text string, confidence long")
    out = extract_invoices(df)
    assert sorted(out.columns) == ["confidence", "data", "doc_id", "doc_type"]
    assert tuple(extraction_summary(out).first()) == (2, 1)


def test_no_shuffle(spark):
    plan = extract_invoices(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
