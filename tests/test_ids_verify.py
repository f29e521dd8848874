import difflib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from docjobs.functions.text import normalize_text
from docjobs.operators import ids, verify
from docjobs.operators.compliance import check_compliance, compliance_score
from docjobs.sources.documents import parse_claims

AS_OF = "2025-06-15 12:00:00"


def one(spark, value, kind="text string"):
    return spark.createDataFrame([(1, value)], f"doc_id long, {kind}")


def test_id_fields(spark):
    r = ids.extract_id_fields(one(spark, "DL: 12345678  EXP: 05/20/2028\nDOB: 01/15/1985\nGENDER: M  HGT: 5-10")).first()
    assert tuple(r.data) == ("01/15/1985", "05/20/2028", "12345678", "M", "5-10") and r.confidence == 100
    assert ids.extract_id_fields(one(spark, "Notification")).first().data.license_number == "TIFICATION"
    assert ids.extract_id_fields(one(spark, None)).first().confidence == 0


@pytest.mark.parametrize("dob, exp, expected", [
    ("06/15/1995", "06/15/2027", (True, 30, False, [], [])),
    (None, "06/14/2025", (False, None, True, ["ID is Expired."], [])),
    (None, "06/15/2025", (False, None, True, ["ID is Expired."], [])),
    ("06/15/2006", None, (True, 19, False, [], ["Under 21 years old."])),
    ("06/16/2025", None, (False, -1, False, ["Date of Birth is in the future."], [])),
    ("invalid", "12-34-5678", (True, None, False, [], ["Unparseable DOB format.", "Unparseable Expiration Date."])),
    ("01/01/2000", "01/01/1999", (False, 25, True, ["ID is Expired.", "Expiration Date is before Date of Birth."], [])),
])
def test_validation(spark, dob, exp, expected):
    df = spark.createDataFrame([((dob, exp),)], "data struct<dob:string,expiration_date:string>")
    v = ids.validate_ids(df, AS_OF).first().validation
    assert (v.valid, v.age, v.is_expired, v.errors, v.warnings) == expected


def test_dates(spark):
    df = spark.createDataFrame([("1/5/1990",), ("02/30/2000",), ("01-02-2003",), ("01/02/99",), (None,)], "v string")
    assert [r[0] for r in df.select(ids.parse_us_date(F.col("v"))).collect()] == [datetime(1990, 1, 5), None, datetime(2003, 1, 2), None, None]


def test_fallback(spark):
    df = ids.extract_id_fields(spark.createDataFrame([(1, "DOB: 01/15/1985"), (2, "boom"), (3, "")], "doc_id long, text string"))

    def fn(text):
        if text == "boom":
            raise ValueError
        return {"dob": "01/01/2001"} if text else None

    out = {r.doc_id: (r.data.dob, r.confidence, r.method) for r in ids.id_with_fallback(df, fn).collect()}
    assert out == {1: ("01/01/2001", 95, "llm_fallback"), 2: (None, 0, "regex_heuristic"), 3: (None, 0, "regex_heuristic")}
    assert ids.id_with_fallback(df, None) is df


def test_normalize(spark):
    df = spark.createDataFrame([("A - B",), ("  x \ty! ",), (None,)], "v string")
    assert [r[0] for r in df.select(normalize_text(F.col("v"))).collect()] == ["a  b", "x y", ""]


def test_entity(spark):
    text = "This agreement is between Alice Corp and Bob Ltd., for the lease."
    df = spark.createDataFrame([("Alice Corp", text), ("ALICE corp", text), ("??", text), ("IBM", text)], "claim string, text string")
    got = {r.claim: (r.check.result, r.check.score, r.check.method, r.check.excerpt) for r in verify.verify_entity(df).collect()}
    assert got["Alice Corp"] == ("pass", 100.0, "exact", "Alice Corp")
    assert got["ALICE corp"] == ("pass", 95.0, "normalized_exact", None)
    assert got["??"] == ("missing", 0.0, "none", None)
    assert got["IBM"] == ("fail", difflib.SequenceMatcher(None, "IBM", text).ratio() * 100, "fuzzy", None)


def test_clause(spark):
    claim, text = "The tenant pays rent monthly.", "the tenant pays rent monthly, in advance"
    r = verify.verify_clause(spark.createDataFrame([(claim, text)], "claim string, text string")).first().check
    assert (r.result, r.method) == ("warn", "semantic/fuzzy") and r.score == difflib.SequenceMatcher(None, claim, text).ratio() * 100


def test_claims_and_summary(spark):
    good = '{"party_a": {"name": "A"}, "party_b": null, "rent": "1000", "expected_changes": [{"clause": ""}, {"expected_text": "rent is due", "clause": "c"}]}'
    df = spark.createDataFrame([(1, good), (2, "{bad"), (3, '{"rent": "1000"}'), (4, "[1]"), (5, None)], "doc_id long, claims_json string")
    rows, rejected = parse_claims(df)
    assert sorted((r.doc_id, r.id, r.value) for r in rows.collect()) == [(1, "clause_1", "rent is due"), (1, "party_a_name", "A")]
    assert sorted(r.doc_id for r in rejected.collect()) == [2, 4, 5]
    docs = spark.createDataFrame([(1, "A says rent is due"), (3, None)], "doc_id long, text string")
    out = verify.verification_summary(verify.quick_verify(rows, docs), docs)
    assert {r.doc_id: (r.n_checks, r.average_score) for r in out.collect()} == {1: (2, 100.0), 3: (0, 0.0)}


@pytest.mark.parametrize("text, score", [("Landlord will Repair or Remedy. Notice is given. Back in 30 days.", 100.0), ("Use this property as you wish.", 0.0), (None, 0.0), ("notice: thirty days", 200 / 3)])
def test_compliance(spark, text, score):
    df = one(spark, text)
    assert compliance_score(df).first().compliance_score == pytest.approx(score)
    assert check_compliance(df).filter("status = 'pass'").count() == round(score * 3 / 100)
