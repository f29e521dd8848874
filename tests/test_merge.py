"""Merging against an independent walk over the pages, and the known cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from docjobs.operators.merge import ROWS, deal, merge_counts, merge_results
from docjobs.schemas import PAGE_RESULT


def page(pos, number=None, total=None, items=0, doc_type=None, vendor=None, date=None, phone=None, fuel=None, sales=None, batch=1, empty=False, nothing=False):
    data = None if nothing else {
        "doc_type": doc_type, "vendor": {"name": vendor, "phone": phone}, "invoice_details": {"number": number, "date": date}, "financials": {"total_amount": total},
        "line_items": [{"description": f"{pos}-{i}"} for i in range(items)], "shift_report_details": {"fuel_sales": fuel, "total_sales": sales},
    }
    return {"batch_id": batch, "pos": pos, "filename": f"f{pos}", "model_used": "m", "data_json": "{}" if empty else None, "extracted": {"confidence": 95, "data": data}}


def merged(spark, pages):
    df = spark.read.schema(PAGE_RESULT).json(spark.sparkContext.parallelize([json.dumps(p) for p in pages]))
    rows = merge_results(df).orderBy("batch_id", "out_pos").collect()
    counts = {r.batch_id: (r.batch_count, r.merged_count) for r in merge_counts(df, merge_results(df)).collect()}
    return rows, counts


def names(rows):
    return [r.original_filenames or [r.filename] for r in rows]


CASES = {
    "same number": ([page(0, "INV-100", items=1), page(1, "INV-100", items=1)], [["f0", "f1"]]),
    "orphan by total": ([page(0, "INV-200", 55.55), page(1, None, 55.55, items=1)], [["f0", "f1"]]),
    "shift by date and vendor": ([page(0, doc_type="Shift Report", vendor="V", date="2025-01-01", sales=500.0), page(1, doc_type="Shift Report", vendor="V", date="2025-01-01", fuel=200.0)], [["f0", "f1"]]),
    "headerless page": ([page(0, doc_type="Shift Report", vendor="V", date="2025-01-01"), page(1, doc_type="Other", fuel=50.0)], [["f0", "f1"]]),
    "audit shape": ([page(0, doc_type="x", fuel=1.0), page(1, doc_type="audit", vendor="V", date="1"), page(2, fuel=2.0), page(3, doc_type="audit", vendor="V", date="2")], [["f1"], ["f3"], ["f0"], ["f2"]]),
    "empty data dropped": ([page(0, "A"), page(1, "A", empty=True)], [["f0"]]),
    "blank number": ([page(0, " "), page(1, "  ")], [["f0", "f1"]]),
    "first of equal totals": ([page(0, "A", 5.0), page(1, "B", 5.0), page(2, None, 5.0)], [["f0", "f2"], ["f1"]]),
    "orphans of equal totals stay apart": ([page(0, None, 5.0), page(1, None, 5.0)], [["f0"], ["f1"]]),
    "two weak pages": ([page(0, fuel=1.0), page(1, fuel=2.0)], [["f0", "f1"]]),
    "one weak page": ([page(0, fuel=1.0), page(1)], [["f0"], ["f1"]]),
    "zero total": ([page(0, "A", 0.0), page(1, None, 0.0)], [["f0", "f1"]]),
    "lottery report": ([page(0, doc_type="Lottery Report", vendor="V", date="d"), page(1, doc_type="Lottery Report", vendor="V", date="d")], [["f0", "f1"]]),
    "only later pages' totals": ([page(0, "A", 1.0), page(1, "A", 2.0), page(2, None, 2.0)], [["f0", "f1"], ["f2"]]),
}


@pytest.mark.parametrize("case", CASES)
def test_cases(spark, case):
    pages, expected = CASES[case]
    rows, counts = merged(spark, pages)
    assert names(rows) == expected
    assert counts[1] == (len(pages), len(expected))


def test_contents(spark):
    rows, _ = merged(spark, [page(0, "A", 792.04, items=13, phone=""), page(1, None, 792.04, items=26, phone="p", fuel=3.0)])
    (r,) = rows
    assert len(r.data.line_items) == 39 and r.data.vendor.phone == "p" and r.data.shift_report_details.fuel_sales == 3.0 and r.is_merged and r.merged_page_count == 2
    assert [i.description for i in r.data.line_items][:2] == ["0-0", "0-1"] and r.data.line_items[-1].description == "1-25"


def test_null_structs_and_no_pages(spark):
    assert merged(spark, [page(0, nothing=True)])[0] == []
    assert merged(spark, [])[0] == []


def walk(pages):
    """The rules again, page by page."""
    groups, orphans = {}, []
    for p in pages:
        if p["data_json"] == "{}":
            continue
        d = p["extracted"]["data"]
        n = d["invoice_details"]["number"]
        groups.setdefault(n.strip(), []).append(p) if n else orphans.append(p)
    rest = {}
    total = lambda p: p["extracted"]["data"]["financials"]["total_amount"]
    for p in orphans:
        home = next((g for g in groups.values() if total(p) is not None and total(g[0]) == total(p)), None)
        home.append(p) if home else rest.setdefault("?" if total(p) is None else total(p), []).append(p)
    shifts, single = {}, []
    has = lambda p: any(v is not None for v in p["extracted"]["data"]["shift_report_details"].values())
    for p in (p for ps in rest.values() for p in ps):
        d = p["extracted"]["data"]
        like = any(w in (d["doc_type"] or "").lower() for w in ("shift", "audit", "report")) or has(p)
        key = (d["invoice_details"]["date"], d["vendor"]["name"])
        shifts.setdefault(key, []).append(p) if like and all(key) else single.append(p)
    weak = [p for p in single if has(p)]
    if len(shifts) == 1 or (not shifts and len(weak) > 1):
        shifts.setdefault(next(iter(shifts), "new"), []).extend(weak)
        single = [p for p in single if not has(p)]
    return [[p["filename"] for p in g] for g in [*groups.values(), *shifts.values(), *([p] for p in single)]]


def test_random_batches(spark):
    rnd = random.Random(5)
    pages = []
    for b in range(60):
        for i in range(rnd.randint(1, 9)):
            pages.append(page(i, rnd.choice([None, None, "", "A", "B ", "B"]), rnd.choice([None, 1.0, 2.0, 3.0]), rnd.randint(0, 2), rnd.choice([None, "Shift", "invoice"]), rnd.choice([None, "", "V", "W"]), rnd.choice([None, "d", "e"]), None, rnd.choice([None, None, 1.0]), None, b, rnd.random() < 0.1))
    rows, _ = merged(spark, pages)
    for b in range(60):
        assert names([r for r in rows if r.batch_id == b]) == walk([p for p in pages if p["batch_id"] == b])


def test_tasks_grow_with_the_pages(spark):
    """Few batches and many more pages than a task is meant to hold: no task has more than its share, whatever the session merges."""
    pages = spark.range(1 << 20).selectExpr("id div 8 as batch_id", "cast(id % 8 as int) as pos")
    parts = [r["n"] for r in deal(pages).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(parts) == 1 << 20 and len(parts) >= 8 and max(parts) < 1.2 * ROWS
