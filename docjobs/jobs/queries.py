"""Registry of the core operators' queries, each over a whole table, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docjobs.functions.text import normalize_text
from docjobs.jobs import render as R
from docjobs.operators import compliance, edits, excerpts, graph, ids, invoices, merge, pages, retrieve, sessions, split, store, stored_index, vector_index, verify
from docjobs.sources import documents, log_source, results_log
from docjobs.sources.shared import shared_folder
from docjobs.streaming import batches, cache
from docjobs.streaming import jobs as streaming

FLAGSHIP = "d6_merge_results"
AS_OF = "2025-06-15 12:00:00"

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# B: fields of invoices and identity documents

def _first(patterns) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract(u, '{p.replace(chr(39), chr(39) * 2)}', {g}), '')" for p, g in patterns) + ")"


_NUMBER = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(regexp_extract(u, '{p}', {g}), '[0-9]') THEN regexp_extract(u, '{p}', {g}) END" for p, g in invoices.NUMBER_PATTERNS) + ")"
_INVOICES = f"""
WITH t AS (SELECT o_orderkey AS doc_id, {R.INVOICE_TEXT} AS text FROM orders), u AS (SELECT *, upper(text) AS u FROM t),
x AS (SELECT doc_id,
  CASE WHEN regexp_matches(u, '{"|".join(invoices.SHIFT_WORDS)}') THEN 'shift_report' WHEN regexp_matches(u, '{"|".join(invoices.LOTTERY_WORDS)}') THEN 'lottery_report' ELSE 'invoice' END AS doc_type,
  regexp_replace({_first(invoices.TOTAL_PATTERNS)}, ',', '.', 'g') AS dotted, {_first(invoices.DATE_PATTERNS)} AS invoice_date, {_NUMBER} AS invoice_number,
  list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1] AS vendor_name_guess FROM u),
y AS (SELECT *, CASE WHEN contains(dotted, '.') THEN replace(dotted[:length(dotted) - position('.' IN reverse(dotted))], '.', '') || '.' || split_part(dotted, '.', -1) ELSE dotted END AS total_amount,
  33 * ((dotted IS NOT NULL)::INT + (invoice_date IS NOT NULL)::INT + (invoice_number IS NOT NULL)::INT) AS s FROM x)
SELECT {{}} FROM y
"""
def _invoice_sql(columns: str) -> str:
    return _INVOICES.replace("{}", columns)


_CONFIDENCE = "CASE WHEN total_amount IS NOT NULL THEN greatest(least(s, 100), 60) ELSE least(s, 100) END AS confidence"


def _invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invoices.extract_invoices(R.invoice_texts(spark, sf_dir)).select("doc_id", "doc_type", "data.total_amount", "data.invoice_date", "data.invoice_number", "data.vendor_name_guess", "confidence")


for _name, _column in (("b1_classify_doc_type", "doc_type"), ("b2_extract_total_amount", "total_amount"), ("b3_extract_invoice_date", "invoice_date"), ("b4_extract_invoice_number", "invoice_number"), ("b5_vendor_name_guess", "vendor_name_guess"), ("b6_invoice_confidence", "confidence")):
    query(_name, _invoice_sql(f"doc_id, {_CONFIDENCE if _column == 'confidence' else _column}"))(lambda spark, sf_dir, c=_column: _invoices(spark, sf_dir).select("doc_id", c))
query("b7_extract_invoices", _invoice_sql(f"doc_id, doc_type, total_amount, invoice_date, invoice_number, vendor_name_guess, {_CONFIDENCE}"))(_invoices)

_IDS = "WITH t AS (SELECT c_custkey AS doc_id, upper(" + R.ID_TEXT + ") AS u FROM customer), x AS (SELECT doc_id, " + ", ".join(f"nullif(regexp_extract(u, '{p.replace(chr(39), chr(39) * 2)}', 2), '') AS {k}" for k, p in ids.ID_PATTERNS.items()) + " FROM t)"


@query("b8_extract_id_fields", _IDS + " SELECT *, least(20 * (" + " + ".join(f"({k} IS NOT NULL)::INT" for k in ids.ID_PATTERNS) + "), 100) AS confidence FROM x")
def b8(spark, sf_dir):
    return ids.extract_id_fields(R.id_texts(spark, sf_dir)).select("doc_id", "data.*", "confidence")


@query("b9_find_dates", f"SELECT c_custkey AS doc_id, array_to_string(regexp_extract_all(upper({R.ID_TEXT}), '{ids.DATE_PATTERN}', 1), ',') AS dates FROM customer")
def b9(spark, sf_dir):
    return R.id_texts(spark, sf_dir).select("doc_id", F.array_join(ids.find_dates(F.col("text")), ",").alias("dates"))


_PARSED = ", ".join(f"CASE WHEN regexp_matches({c}, '^[0-9]{{1,2}}.[0-9]{{1,2}}.[0-9]{{4}}$') THEN try_strptime(replace({c}, '-', '/'), '%m/%d/%Y') END AS {k}" for c, k in (("dob", "d"), ("expiration_date", "e")))


@query("b10_parse_us_date", _IDS + f" SELECT doc_id, strftime(d, '%Y-%m-%d') AS dob, strftime(e, '%Y-%m-%d') AS expires FROM (SELECT doc_id, {_PARSED} FROM x)")
def b10(spark, sf_dir):
    show = lambda c: F.date_format(ids.parse_us_date(F.col(f"data.{c}")), "yyyy-MM-dd")
    return ids.extract_id_fields(R.id_texts(spark, sf_dir)).select("doc_id", show("dob").alias("dob"), show("expiration_date").alias("expires"))


@query("b11_validate_ids", _IDS + f""",
p AS (SELECT doc_id, dob, expiration_date, TIMESTAMP '{AS_OF}' AS now, {_PARSED} FROM x),
q AS (SELECT *, year(now) - year(d) - ((month(now), day(now)) < (month(d), day(d)))::INT AS age, coalesce(e < now, false) AS is_expired, coalesce(e < d, false) AS back FROM p)
SELECT doc_id, NOT (coalesce(age < 0, false) OR is_expired OR back) AS valid, age::INT AS age, is_expired,
  array_to_string(list_filter([CASE WHEN age < 0 THEN 'Date of Birth is in the future.' END, CASE WHEN is_expired THEN 'ID is Expired.' END, CASE WHEN back THEN 'Expiration Date is before Date of Birth.' END], lambda x: x IS NOT NULL), '|') AS errors,
  array_to_string(list_filter([CASE WHEN dob IS NOT NULL AND d IS NULL THEN 'Unparseable DOB format.' WHEN age BETWEEN 0 AND 17 THEN 'Under 18 years old.' WHEN age BETWEEN 18 AND 20 THEN 'Under 21 years old.' END, CASE WHEN expiration_date IS NOT NULL AND e IS NULL THEN 'Unparseable Expiration Date.' END], lambda x: x IS NOT NULL), '|') AS warnings
FROM q""")
def b11(spark, sf_dir):
    out = ids.validate_ids(ids.extract_id_fields(R.id_texts(spark, sf_dir)), AS_OF)
    return out.select("doc_id", "validation.valid", "validation.age", "validation.is_expired", F.array_join("validation.errors", "|").alias("errors"), F.array_join("validation.warnings", "|").alias("warnings"))


@query("b12_id_with_fallback", _IDS + " , y AS (SELECT *, least(20 * (" + " + ".join(f"({k} IS NOT NULL)::INT" for k in ids.ID_PATTERNS) + "), 100) AS c FROM x) SELECT doc_id, CASE WHEN c < 80 THEN 'X0000000' ELSE license_number END AS license_number, CASE WHEN c < 80 THEN 95 ELSE c END AS confidence, CASE WHEN c < 80 THEN 'llm_fallback' ELSE 'regex_heuristic' END AS method FROM y")
def b12(spark, sf_dir):
    out = ids.id_with_fallback(ids.extract_id_fields(R.id_texts(spark, sf_dir)), lambda text: {"license_number": "X0000000"})
    return out.select("doc_id", "data.license_number", "confidence", "method")


_NORM = "trim(regexp_replace(regexp_replace(lower(coalesce({}, '')), '[\\s\\x0B\\x1c-\\x1f\\x{{85}}\\x{{A0}}\\x{{2028}}]+', ' ', 'g'), '[^a-z0-9 ]', '', 'g'), ' ')"


@query("b13_normalize_text", f"SELECT doc_id, md5({_NORM.format('text')}) AS digest FROM documents")
def b13(spark, sf_dir):
    return R.documents(spark, sf_dir).select("doc_id", F.md5(normalize_text(F.col("text")).cast("binary")).alias("digest"))


@query("b14_fuzzy_score")
def b14(spark, sf_dir):
    from docjobs.functions.text import fuzzy_score

    parts = R.invoice_texts(spark, sf_dir).selectExpr("doc_id", "upper(text) as a", "text as b")
    return parts.select("doc_id", F.round(fuzzy_score("a", "b"), 9).alias("score"))


# C: verification, compliance, figures

#: A claim of each kind for each document; the party is there as written, with other spaces, or has no letters.
_CLAIM = "CASE doc_id % 3 WHEN 0 THEN substring(text, 11, 24) WHEN 1 THEN replace(substring(text, 11, 24), ' ', '  ') ELSE '?! ' END"


@query("c1_verify_entity", f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce({_CLAIM}, '') AS claim FROM documents), n AS (SELECT *, {_NORM.format('claim')} AS nc, {_NORM.format('text')} AS nt FROM d)
SELECT doc_id, claim, CASE WHEN nc = '' THEN 'missing' WHEN contains(nt, nc) THEN 'pass' END AS result, CASE WHEN nc = '' THEN 0.0 WHEN contains(text, claim) THEN 100.0 ELSE 95.0 END::DOUBLE AS score,
  CASE WHEN nc = '' THEN 'none' WHEN contains(text, claim) THEN 'exact' ELSE 'normalized_exact' END AS method, CASE WHEN nc <> '' AND contains(text, claim) THEN claim END AS excerpt
FROM n""")
def c1(spark, sf_dir):
    df = R.documents(spark, sf_dir).selectExpr("doc_id", "coalesce(text, '') as text", f"coalesce({_CLAIM}, '') as claim")
    return verify.verify_entity(df).select("doc_id", "claim", "check.*")


@query("c1_verify_entity_fuzzy")
def c1_fuzzy(spark, sf_dir):
    """Claims that no document holds as they stand, so that all but those without letters reach the score, on whole texts."""
    df = R.documents(spark, sf_dir).selectExpr("doc_id", "coalesce(text, '') as text", "translate(substring(coalesce(text, ''), 1, 200), 'aeo', '043') as claim")
    return verify.verify_entity(df).select("doc_id", "claim", "check.result", F.round("check.score", 9).alias("score"), "check.method")


def _altered(spark, sf_dir) -> DataFrame:
    """Three stretches of each document as a claim may have them: a letter wrong here and there, a word too many, and as they are."""
    docs = R.documents(spark, sf_dir).selectExpr("doc_id", "text", "cast(greatest(length(text) - 120, 0) as int) as room")
    at = lambda k: F.substring("text", (F.col("room") * k / 4).cast("int") + 1, F.lit(100))
    claims = F.array(F.regexp_replace(at(1), "(.{30}).", "$1#"), F.concat(F.substring(at(2), 1, 40), F.lit("et al. "), F.substring(at(2), 41, 60)), at(3))
    return docs.select("doc_id", F.posexplode(claims).alias("ord", "value"))


@query("c2_excerpts")
def c2_excerpts(spark, sf_dir):
    docs = R.documents(spark, sf_dir)
    return excerpts.with_excerpts(_altered(spark, sf_dir), docs.select("doc_id", "text"))


@query("c2_verify_clause")
def c2(spark, sf_dir):
    df = R.invoice_texts(spark, sf_dir).selectExpr("doc_id", "text", "case when doc_id % 2 = 0 then substring(text, 9, 30) else upper(text) end as claim")
    return verify.verify_clause(df).select("doc_id", "claim", "check.result", F.round("check.score", 9).alias("score"), "check.method")


def _claims(spark, sf_dir, doubtful: bool) -> DataFrame:
    """Claims as they come in, files of JSON: a party, an address, a clause without text, a clause that is there and, if doubtful, one that is not."""
    df = R.invoice_texts(spark, sf_dir)
    change = lambda c: F.struct(c.alias("expected_text"), F.lit(None).cast("string").alias("clause"))
    changes = [change(F.lit("")), F.struct(F.lit(None).cast("string").alias("expected_text"), F.substring("text", 12, 10).alias("clause"))]
    if doubtful:
        changes.append(change(F.concat(F.upper("text"), F.lit(" and more"))))
    claims = F.struct(F.struct(F.substring("text", 5, 9).alias("name"), F.when(F.col("doc_id") % 2 == 0, F.upper(F.substring("text", 5, 12))).alias("address")).alias("party_a"), F.array(*changes).alias("expected_changes"), F.lit("x").alias("unknown"))
    came = df.select("doc_id", "text", F.when(F.col("doc_id") % 50 == 49, F.lit("{not json")).otherwise(F.to_json(claims)).alias("claims_json"))
    path = shared_folder(spark, "claims")
    came.write.parquet(path)
    return R.spread(spark.read.schema(came.schema).parquet(path))


_CHECKS = f"""
WITH t AS (SELECT o_orderkey AS doc_id, {R.INVOICE_TEXT} AS text FROM orders), g AS (SELECT * FROM t WHERE doc_id % 50 <> 49),
checks AS (
  SELECT doc_id, 0 AS ord, 'party_a_name' AS id, 'party_name' AS type, substring(text, 5, 9) AS value FROM g
  UNION ALL SELECT doc_id, 1, 'party_a_address', 'address', upper(substring(text, 5, 12)) FROM g WHERE doc_id % 2 = 0
  UNION ALL SELECT doc_id, 5, 'clause_1', 'clause_change', substring(text, 12, 10) FROM g
)"""


@query("a6_parse_claims", _CHECKS + " SELECT * FROM checks")
def a6(spark, sf_dir):
    return documents.parse_claims(_claims(spark, sf_dir, False).drop("text"))[0]


@query("c3_quick_verify")
def c3(spark, sf_dir):
    df = _claims(spark, sf_dir, True)
    out = verify.quick_verify(documents.parse_claims(df.drop("text"))[0], df.select("doc_id", "text"))
    return out.select("doc_id", "ord", "id", "type", "value", "result", F.round("score", 9).alias("score"), "method")


@query("c4_verification_summary", _CHECKS + """,
s AS (SELECT checks.doc_id, count(*) AS n, avg(CASE WHEN contains(text, value) THEN 100.0 ELSE 95.0 END) AS a FROM checks JOIN t USING (doc_id) GROUP BY ALL)
SELECT t.doc_id, coalesce(n, 0) AS n_checks, round(coalesce(a, 0.0), 6)::DOUBLE AS average_score FROM t LEFT JOIN s USING (doc_id)""")
def c4(spark, sf_dir):
    df = _claims(spark, sf_dir, False)
    out = verify.quick_verify(documents.parse_claims(df.drop("text"))[0], df.select("doc_id", "text"))
    return verify.verification_summary(out, df).select("doc_id", "n_checks", F.round("average_score", 6).alias("average_score"))


_RULES = (
    compliance.Rule("r_the", "a frequent word", ("the ",)),
    compliance.Rule("r_worthless", "rare words", ("worthless", "disgusting")),
    compliance.Rule("r_lease", "a lease's words", compliance.LEASE_RULES[0].must_contain + compliance.LEASE_RULES[2].must_contain),
)
_RULE_SQL = "WITH r(ord, rule_id, description, phrases) AS (VALUES " + ", ".join(f"({n}, '{r.id}', '{r.description.replace(chr(39), chr(39) * 2)}', [{', '.join(repr(p) for p in r.must_contain)}])" for n, r in enumerate(_RULES)) + "), c AS (SELECT doc_id, ord, rule_id, description, CASE WHEN len(list_filter(phrases, lambda p: contains(lower(coalesce(text, '')), p))) > 0 THEN 'pass' ELSE 'fail' END AS status FROM documents, r)"


@query("c5_check_compliance", _RULE_SQL + " SELECT * FROM c")
def c5(spark, sf_dir):
    return compliance.check_compliance(R.documents(spark, sf_dir), _RULES)


@query("c6_compliance_score", _RULE_SQL + f" SELECT doc_id, '{compliance.JURISDICTION}' AS jurisdiction, round(count(*) FILTER (status = 'pass') / {len(_RULES)} * 100, 6) AS compliance_score, string_agg(rule_id || '=' || status, ',' ORDER BY ord) AS checks FROM c GROUP BY doc_id")
def c6(spark, sf_dir):
    out = compliance.compliance_score(R.documents(spark, sf_dir), _RULES)
    return out.select("doc_id", "jurisdiction", F.round("compliance_score", 6).alias("compliance_score"), F.array_join(F.transform("checks", lambda c: F.concat_ws("=", c["rule_id"], c["status"])), ",").alias("checks"))


@query("c7_contract_report", _RULE_SQL + f""", n AS (SELECT doc_id, {_NORM.format("substring(text, 11, 24)")} AS nc FROM documents)
SELECT n.doc_id, 1::BIGINT AS n_checks, CASE WHEN nc = '' THEN 0.0 ELSE 100.0 END::DOUBLE AS average_score, round(count(*) FILTER (status = 'pass') / {len(_RULES)} * 100, 6) AS compliance_score FROM n JOIN c USING (doc_id) GROUP BY n.doc_id, nc""")
def c7(spark, sf_dir):
    docs = R.documents(spark, sf_dir)
    checks = docs.select("doc_id", F.lit(0).alias("ord"), F.lit("party_a_name").alias("id"), F.lit("party_name").alias("type"), F.coalesce(F.substring("text", 11, 24), F.lit("")).alias("value"))
    summary = verify.verification_summary(verify.quick_verify(checks, docs), docs)
    out = compliance.contract_report(summary, compliance.compliance_score(docs, _RULES))
    return out.select("doc_id", "n_checks", "average_score", F.round("compliance_score", 6).alias("compliance_score"))


@query("c8_extraction_summary", "SELECT count(*) AS processed, count(*) FILTER (confidence > 0) AS found FROM (" + _invoice_sql(_CONFIDENCE) + ")")
def c8(spark, sf_dir):
    return store.extraction_summary(_invoices(spark, sf_dir))


@query("c9_results_metrics", """
SELECT event_type AS model, count(*) AS n, round(count(*) FILTER (value > 20) / count(*), 6) AS success_rate, round(avg(d), 6) AS avg_s, round(quantile_cont(d, 0.5), 6) AS median_s, round(quantile_cont(d, 0.95), 6) AS p95_s, round(max(d), 6) AS max_s, round(avg(greatest(value - 20, 0)), 6) AS avg_confidence
FROM (SELECT *, round(value, 4) AS d FROM events) GROUP BY event_type""")
def c9(spark, sf_dir):
    log = R.table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), F.col("value").alias("duration_seconds"), F.greatest(F.col("value") - 20, F.lit(0.0)).alias("confidence_score"))
    out = store.results_metrics(log)
    return out.select("model", "n", *(F.round(c, 6).alias(c) for c in out.columns[2:]))


@query("c10_ocr_page_stats", """
WITH c AS (SELECT l_orderkey AS doc_id, l_linenumber AS page_no, CASE l_suppkey % 4 WHEN 0 THEN '-1' WHEN 1 THEN cast(l_partkey % 100 AS VARCHAR) WHEN 2 THEN '9.5' ELSE ' 7 ' END AS conf FROM lineitem),
a AS (SELECT doc_id, page_no, avg(TRY_CAST(trim(conf) AS BIGINT)) FILTER (regexp_matches(conf, '^\\s*[+-]?\\d+\\s*$') AND TRY_CAST(trim(conf) AS BIGINT) >= 0) AS m FROM c GROUP BY ALL)
SELECT DISTINCT doc_id, page_no, 4 AS chars, round(m, 6) AS avg_conf FROM a WHERE page_no % 3 <> 0""")
def c10(spark, sf_dir):
    lines = R.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_no"), "l_suppkey", "l_partkey")
    kind = F.col("l_suppkey") % 4
    words = lines.select("doc_id", "page_no", F.when(kind == 0, "-1").when(kind == 1, (F.col("l_partkey") % 100).cast("string")).when(kind == 2, "9.5").otherwise(" 7 ").alias("conf"))
    texts = lines.select("doc_id", "page_no").distinct().withColumn("text", F.when(F.col("page_no") % 3 == 0, " \f").otherwise("page"))
    return store.ocr_page_stats(words, texts).select("doc_id", "page_no", "chars", F.round("avg_conf", 6).alias("avg_conf"))


# D: merging

_D = f"""
WITH p AS ({R.select_sql(R.PAGE_COLUMNS, 'orders')}),
d1 AS (SELECT *, CASE WHEN coalesce(number, '') <> '' THEN trim(number) END AS num_key FROM p WHERE NOT empty),
d1b AS (SELECT *, CASE WHEN num_key IS NOT NULL THEN min(pos) OVER (PARTITION BY batch_id, num_key) END AS first_pos FROM d1),
d2 AS (SELECT *, CASE WHEN num_key IS NULL AND total IS NOT NULL THEN min(CASE WHEN num_key IS NOT NULL AND pos = first_pos THEN struct_pack(pos := pos, k := num_key) END) OVER (PARTITION BY batch_id, total) END AS hit FROM d1b),
d2b AS (SELECT *, hit.k AS hit_key, num_key IS NULL AND hit IS NULL AS unmatched FROM d2),
d3 AS (SELECT *, CASE WHEN unmatched THEN min(CASE WHEN unmatched THEN pos END) OVER (PARTITION BY batch_id, unmatched, total) END AS ord1, fuel IS NOT NULL OR merch IS NOT NULL AS has_shift,
  regexp_matches(lower(coalesce(doc_type, '')), 'shift|audit|report') AS named FROM d2b),
d3b AS (SELECT *, unmatched AND (named OR has_shift) AND coalesce(vendor, '') <> '' AND coalesce(day, '') <> '' AS strong FROM d3),
d4 AS (SELECT *, min(CASE WHEN strong THEN day || '|' || vendor END) OVER b AS lo, max(CASE WHEN strong THEN day || '|' || vendor END) OVER b AS hi,
  sum((unmatched AND NOT strong AND has_shift)::INT) OVER b AS n_weak FROM d3b WINDOW b AS (PARTITION BY batch_id)),
d4b AS (SELECT *, unmatched AND NOT strong AND has_shift AND (coalesce(lo = hi, false) OR (lo IS NULL AND n_weak > 1)) AS joins FROM d4),
d4c AS (SELECT *, CASE WHEN NOT unmatched THEN 0 WHEN strong OR joins THEN 1 ELSE 2 END AS kind,
  CASE WHEN NOT unmatched THEN coalesce(num_key, hit_key) WHEN strong THEN day || '|' || vendor WHEN joins THEN coalesce(lo, 'Unknown Date|Shift Report') ELSE pos::VARCHAR END AS gk,
  CASE WHEN NOT unmatched THEN (num_key IS NULL)::INT ELSE joins::INT END AS stage, CASE WHEN unmatched THEN ord1 ELSE 0 END AS o1 FROM d4b),
d4d AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY stage, o1, pos) AS seq FROM d4c),
d5 AS (SELECT batch_id, kind, gk, count(*) AS n, min(struct_pack(a := stage, b := o1, c := pos)) AS start, arg_min(filename, seq) AS filename,
  arg_min(coalesce(number, '~'), seq) AS number, arg_min(coalesce(total, -1), seq) AS total, string_agg(filename, ',' ORDER BY seq) AS files,
  arg_min(phone, seq) FILTER (coalesce(phone, '') <> '') AS phone, arg_min(coalesce(phone, '~'), seq) AS own_phone, arg_min(fuel, seq) FILTER (fuel IS NOT NULL) AS fuel, arg_min(merch, seq) FILTER (merch IS NOT NULL) AS merch, sum(n_items) AS n_items,
  string_agg(array_to_string(list_transform(range(1, n_items + 1), lambda i: filename || '-' || i::VARCHAR), ','), ',' ORDER BY seq) FILTER (n_items > 0) AS items FROM d4d GROUP BY ALL),
d6 AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY kind, start.a, start.b, start.c) - 1 AS out_pos FROM d5)
"""


def _grouped(spark, sf_dir, steps: int) -> DataFrame:
    df = merge.deal(R.page_results(spark, sf_dir))
    for f in (merge.group_by_invoice_number, merge.attach_orphans_by_total, merge.group_shift_reports, merge.attach_headerless_pages)[:steps]:
        df = f(df)
    return df


@query("d1_group_by_invoice_number", _D + "SELECT batch_id, pos, num_key, first_pos FROM d1b")
def d1(spark, sf_dir):
    return _grouped(spark, sf_dir, 1).select("batch_id", "pos", "num_key", "first_pos")


@query("d2_attach_orphans_by_total", _D + "SELECT batch_id, pos, hit_key, hit.pos AS hit_pos FROM d2b")
def d2(spark, sf_dir):
    return _grouped(spark, sf_dir, 2).select("batch_id", "pos", "hit_key", "hit_pos")


@query("d3_group_shift_reports", _D + "SELECT batch_id, pos, strong, has_shift, CASE WHEN unmatched THEN ord1 END AS ord1 FROM d3b")
def d3(spark, sf_dir):
    return _grouped(spark, sf_dir, 3).select("batch_id", "pos", "strong", "has_shift", F.when(F.col("unmatched"), F.col("ord1")).alias("ord1"))


@query("d4_attach_headerless_pages", _D + "SELECT batch_id, pos, kind, gk AS group_key, stage FROM d4c")
def d4(spark, sf_dir):
    key = F.coalesce("group_key.number", F.concat_ws("|", "group_key.date", "group_key.vendor", F.col("group_key.pos").cast("string")))
    return _grouped(spark, sf_dir, 4).select("batch_id", "pos", "kind", key.alias("group_key"), F.col("seq.stage").alias("stage"))


def _flat(records: DataFrame, *more) -> DataFrame:
    return records.select(
        "batch_id", "kind", *more, "filename", F.coalesce("merged_page_count", F.lit(1)).alias("n_pages"), F.coalesce(F.array_join("original_filenames", ","), "filename").alias("files"), F.coalesce("data.invoice_details.number", F.lit("~")).alias("number"),
        F.coalesce("data.financials.total_amount", F.lit(-1.0)).alias("total"), F.coalesce("data.vendor.phone", F.lit("~")).alias("phone"), F.col("data.shift_report_details.fuel_sales").alias("fuel"), F.col("data.shift_report_details.merch_sales").alias("merch"),
        F.size(F.coalesce("data.line_items", F.array())).alias("n_items"), F.array_join(F.transform("data.line_items", lambda i: i["description"]), ",").alias("items"),
    )


_FLAT = "filename, n::INT AS n_pages, files, number, total, coalesce(phone, own_phone) AS phone, fuel, merch, n_items::INT AS n_items, coalesce(items, CASE WHEN n > 1 THEN '' END) AS items"


@query("d5_merge_group", _D + f"SELECT batch_id, kind, {_FLAT} FROM d5")
def d5(spark, sf_dir):
    return _flat(merge.merge_group(_grouped(spark, sf_dir, 4)))


@query("d6_merge_results", _D + f"SELECT batch_id, kind, out_pos::INT AS out_pos, {_FLAT} FROM d6")
def d6(spark, sf_dir):
    return _flat(merge.merge_results(R.page_results(spark, sf_dir)), "out_pos")


@query("d7_merge_counts", _D + "SELECT batch_id, count(*) AS batch_count, coalesce(any_value(m), 0) AS merged_count FROM p LEFT JOIN (SELECT batch_id, count(*) AS m FROM d5 GROUP BY 1) USING (batch_id) GROUP BY 1")
def d7(spark, sf_dir):
    df = R.page_results(spark, sf_dir)
    return merge.merge_counts(df, merge.merge_results(df))


# E: entity graph over pairs of documents (2i, 2i + 1)

# DuckDB's \\b knows ASCII only, so its SQL first marks other letters and then drops or cuts what touches them.
_E = """
WITH m AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '[^\\x00-\\x7F\\p{P}\\p{S}\\p{Z}]', 'q0q0q', 'g'), '\\b[A-Z][a-zA-Z0-9_\\-]+\\b')) AS m FROM documents),
e AS (SELECT DISTINCT doc_id, CASE WHEN contains(m, 'q0q0q') THEN regexp_extract(split_part(m, 'q0q0q', 1), '^(.*-)', 1) ELSE m END AS entity FROM m WHERE NOT contains(m, 'q0q0q') OR length(regexp_extract(split_part(m, 'q0q0q', 1), '^(.*-)', 1)) > 1),
n AS (SELECT CAST(floor(doc_id / 2) AS BIGINT) AS pair_id, entity, bool_or(doc_id % 2 = 0) AS in_doc1, bool_or(doc_id % 2 = 1) AS in_doc2 FROM e GROUP BY ALL)
"""


def _nodes(spark, sf_dir) -> DataFrame:
    docs = R.documents(spark, sf_dir).select("doc_id", "text")
    pairs = docs.select(F.floor(F.col("doc_id") / 2).alias("pair_id")).distinct().select("pair_id", (F.col("pair_id") * 2).alias("doc1"), (F.col("pair_id") * 2 + 1).alias("doc2"))
    return graph.entity_nodes(pairs, docs)


@query("e1_extract_entities", _E + "SELECT doc_id, entity FROM e")
def e1(spark, sf_dir):
    return graph.extract_entities(R.documents(spark, sf_dir))


query("e2_entity_nodes", _E + "SELECT * FROM n")(_nodes)
query("e3_common_edges", _E + "SELECT pair_id, entity AS source, entity AS target, 'common' AS relation FROM n WHERE in_doc1 AND in_doc2")(lambda spark, sf_dir: graph.common_edges(_nodes(spark, sf_dir)))


# F: pages

_LINES = "lines AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS page_no, unnest(l) AS text FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))"


def _marked(style: str) -> str:
    before, after, skip = pages.STYLES[style]
    lf = lambda x: "'" + x.replace("\n", "' || chr(10) || '") + "'"
    text = f"string_agg({lf(before)} || page_no || {lf(after)} || text, chr(10) ORDER BY page_no)" + (" FILTER (trim(text) <> '')" if skip else "")
    return f"WITH {_LINES} SELECT doc_id, md5(coalesce({text}, '')) AS digest FROM lines GROUP BY doc_id"


for _style in pages.STYLES:
    query(f"f1_assemble_pages_{_style}", _marked(_style))(lambda spark, sf_dir, s=_style: pages.assemble_pages(R.line_pages(spark, sf_dir), s).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest")))


@query("f2_split_pages", f"WITH {_LINES} SELECT doc_id, page_no::INT AS page_no, text FROM lines")
def f2(spark, sf_dir):
    return pages.split_pages(pages.assemble_pages(R.line_pages(spark, sf_dir)))


@query("f3_combine_documents", """
SELECT CAST(floor(doc_id / 10) AS BIGINT) AS session_id, md5(string_agg('Document: ' || lang || doc_id || '.PDF' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY (lang || doc_id || '.PDF'))) AS digest FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1""")
def f3(spark, sf_dir):
    name = F.concat("lang", F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".txt").otherwise(".PDF"))
    files = R.documents(spark, sf_dir).select(F.floor(F.col("doc_id") / 10).alias("session_id"), name.alias("name"), "text")
    return pages.combine_documents(files).select("session_id", F.md5(F.col("text").cast("binary")).alias("digest"))


_SOURCED = "string_agg(chr(10) || '--- SOURCE: ' || CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN lang ELSE 'unknown' END || ' ---' || chr(10) || coalesce(text, ''), chr(10) ORDER BY doc_id)"


def _sourced(spark, sf_dir, key: str) -> DataFrame:
    kind = F.col("doc_id") % 3
    return R.documents(spark, sf_dir).select(F.floor(F.col("doc_id") / 10).alias(key), F.col("doc_id").alias("ord"), F.when(kind == 0, F.col("source")).when(kind == 1, "").alias("source"), F.when(kind == 1, F.col("lang")).alias("file_path"), "text")


@query("f4_concat_for_analysis", f"SELECT CAST(floor(doc_id / 10) AS BIGINT) AS group_id, md5({_SOURCED}) AS digest FROM documents GROUP BY 1")
def f4(spark, sf_dir):
    return pages.concat_for_analysis(_sourced(spark, sf_dir, "group_id")).select("group_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("f5_concat_for_comparison", f"SELECT CAST(floor(doc_id / 10) AS BIGINT) AS pair_id, md5('<<REFERENCE_DOCUMENTS>>' || chr(10) || coalesce({_SOURCED} FILTER (doc_id % 2 = 0), '') || chr(10) || chr(10) || '<<ACTUAL_DOCUMENTS>>' || chr(10) || coalesce({_SOURCED} FILTER (doc_id % 2 = 1), '')) AS digest FROM documents GROUP BY 1")
def f5(spark, sf_dir):
    df = _sourced(spark, sf_dir, "pair_id")
    return pages.concat_for_comparison(df.filter("ord % 2 = 0"), df.filter("ord % 2 = 1")).select("pair_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("f6_compare_pages", f"""
WITH {_LINES}, s AS (SELECT CAST(floor(doc_id / 2) AS BIGINT) AS pair_id, doc_id % 2 AS side, page_no, text FROM lines),
j AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.page_no, b.page_no)::INT AS page_no, a.text AS l, b.text AS r FROM (SELECT * FROM s WHERE side = 0) a FULL JOIN (SELECT * FROM s WHERE side = 1) b USING (pair_id, page_no))
SELECT pair_id, page_no, CASE WHEN r IS NULL THEN 'REMOVED' WHEN l IS NULL THEN 'ADDED' WHEN l = r THEN 'NO CHANGE' ELSE 'CHANGED' END AS status,
  (r IS NOT NULL AND l IS DISTINCT FROM r)::INT AS n_added, (l IS NOT NULL AND l IS DISTINCT FROM r)::INT AS n_removed FROM j""")
def f6(spark, sf_dir):
    lines = R.line_pages(spark, sf_dir).withColumn("pair_id", F.floor(F.col("doc_id") / 2))
    out = pages.compare_pages(lines.filter("doc_id % 2 = 0"), lines.filter("doc_id % 2 = 1"))
    return out.select("pair_id", "page_no", "status", F.size("added").alias("n_added"), F.size("removed").alias("n_removed"))


_SENTENCES = "s AS (SELECT doc_id, CAST(floor(doc_id / 2) AS BIGINT) AS pair_id, replace(coalesce(text, ''), '. ', '.' || chr(10)) AS text FROM documents)"


@query("f6_edit_scripts", f"""
WITH {_SENTENCES}, j AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, a.text AS l, b.text AS r FROM (SELECT * FROM s WHERE doc_id % 2 = 0) a FULL JOIN (SELECT * FROM s WHERE doc_id % 2 = 1) b USING (pair_id)),
n AS (SELECT *, CASE WHEN l IS NULL THEN 0 ELSE len(string_split(l, chr(10))) END AS ll, CASE WHEN r IS NULL THEN 0 ELSE len(string_split(r, chr(10))) END AS rr FROM j)
SELECT pair_id, (rr - ll)::INT AS grown, coalesce(l IS DISTINCT FROM r, true) AS changed, md5(coalesce(r, '')) AS replayed FROM n""")
def f6_edits(spark, sf_dir):
    docs = R.documents(spark, sf_dir).select("doc_id", F.floor(F.col("doc_id") / 2).alias("pair_id"), F.lit(1).alias("page_no"), F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit(".\n")).alias("text"))
    ref = docs.filter("doc_id % 2 = 0")
    out = edits.edit_scripts(ref, docs.filter("doc_id % 2 = 1")).join(ref.select("pair_id", "page_no", "text"), ["pair_id", "page_no"], "left")
    return out.select("pair_id", (F.col("n_added") - F.col("n_removed")).alias("grown"), (F.size("hunks") > 0).alias("changed"), F.md5(F.coalesce(edits.replay(F.col("text"), F.col("hunks")), F.lit("")).cast("binary")).alias("replayed"))


# G: chunks, retrieval, chat

_CHUNKS = "chunks AS (SELECT doc_id, source, c AS chunk_no, substring(text, c * 800 + 1, 1000) AS text FROM (SELECT *, unnest(range(greatest(1, ceil((length(text) - 200) / 800))::BIGINT)) AS c FROM documents WHERE length(text) > 0))"


def _chunks(spark, sf_dir) -> DataFrame:
    return retrieve.chunk_documents(R.documents(spark, sf_dir))


@query("g1_chunk_documents", f"WITH {_CHUNKS} SELECT doc_id, chunk_no, text FROM chunks")
def g1(spark, sf_dir):
    return _chunks(spark, sf_dir).select("doc_id", "chunk_no", "text")


def _kept(text: str, sep: str) -> str:
    """Pieces of a text that end with the separator."""
    parts = f"string_split({text}, {sep})"
    return f"list_filter(list_transform({parts}, lambda s, i: s || CASE WHEN i < len({parts}) THEN {sep} ELSE '' END), lambda s: s <> '')"


def _cut(text: str, seps: tuple[str, ...], size: int, depth: int = 0) -> str:
    if not seps:
        return f"string_split({text}, '')"
    x = f"x{depth}"
    return f"flatten(list_transform({_kept(text, seps[0])}, lambda {x}: CASE WHEN length({x}) > {size} THEN {_cut(x, seps[1:], size, depth + 1)} ELSE [{x}] END))"


_SPLIT = f"""
WITH RECURSIVE p AS (SELECT doc_id, text, CASE WHEN length(text) > 1000 THEN {_cut('text', ('chr(10) || chr(10)', 'chr(10)', "' '"), 1000)} ELSE [text] END AS parts FROM documents WHERE length(text) > 0),
e AS (SELECT doc_id, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS b FROM (SELECT doc_id, unnest(parts) AS part, unnest(range(len(parts))) AS i FROM p)),
b AS MATERIALIZED (SELECT doc_id, list(b ORDER BY b) AS bs FROM e GROUP BY doc_id),
c AS (
  SELECT doc_id, bs, 0::BIGINT AS a, list_max(list_filter(bs, lambda v: v <= 1000)) AS z, 0::BIGINT AS chunk_no FROM b
  UNION ALL
  SELECT doc_id, bs, s AS a, list_max(list_filter(bs, lambda v: v <= s + 1000)) AS z, chunk_no + 1 FROM (
    SELECT doc_id, bs, chunk_no, list_min(list_filter(list_prepend(0, bs), lambda v: v >= greatest(z - 200, list_min(list_filter(bs, lambda w: w > z)) - 1000))) AS s FROM c WHERE z < bs[-1])
)
SELECT doc_id, chunk_no, a AS start, substring(text, a + 1, z - a) AS text FROM c JOIN p USING (doc_id)
"""


@query("g1_split_documents", _SPLIT)
def g1_split(spark, sf_dir):
    return split.split_documents(R.documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "chunk_no", "start", "text")


_FP = "CASE WHEN doc_id % 2 = 0 THEN source || '::' || doc_id || '-' || chunk_no ELSE sha256(text) END"


def _fingerprinted(spark, sf_dir) -> DataFrame:
    even = F.col("doc_id") % 2 == 0
    none = F.lit(None).cast("string")
    fp = retrieve.fingerprint(F.when(even, F.col("source")), none, F.when(even, F.concat_ws("-", "doc_id", "chunk_no")), F.col("text"))
    return _chunks(spark, sf_dir).select("doc_id", "chunk_no", "text", fp.alias("fp"))


@query("g2_fingerprint", f"WITH {_CHUNKS} SELECT doc_id, chunk_no, {_FP} AS fp FROM chunks")
def g2(spark, sf_dir):
    return _fingerprinted(spark, sf_dir).drop("text")


@query("g3_add_documents", f"WITH {_CHUNKS}, f AS (SELECT *, {_FP} AS fp FROM chunks), n AS (SELECT * FROM f WHERE doc_id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY fp ORDER BY doc_id, chunk_no) = 1) SELECT doc_id, chunk_no, fp FROM n WHERE fp NOT IN (SELECT fp FROM f WHERE doc_id % 3 = 0)")
def g3(spark, sf_dir):
    df = _fingerprinted(spark, sf_dir)
    return retrieve.add_documents(df.filter("doc_id % 3 <> 0"), df.filter("doc_id % 3 = 0"), ["doc_id", "chunk_no"]).drop("text")


@query("g3_stored_index", f"""WITH {_CHUNKS}, f AS (SELECT *, {_FP} AS fp, 1 + doc_id % 3 AS load FROM chunks),
n AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY fp ORDER BY load, doc_id, chunk_no) = 1)
SELECT load::INT AS load, doc_id, chunk_no, fp, sha256(text) AS digest FROM n""")
def g3_stored(spark, sf_dir):
    """All chunks in three appends, then the whole of them once more, which adds nothing; what the index then holds."""
    chunks = _fingerprinted(spark, sf_dir).withColumn("load", (F.col("doc_id") % 3 + 1).cast("int"))
    path = shared_folder(spark, "stored-index")
    for load in (1, 2, 3):
        stored_index.add_to_index(chunks.filter(F.col("load") == load), path, ["doc_id", "chunk_no"])
    again = stored_index.add_to_index(chunks, path, ["doc_id", "chunk_no"])
    return stored_index.read_index(spark, path).unionByName(again).select("load", "doc_id", "chunk_no", "fp", F.sha2("text", 256).alias("digest"))


@query("g4_load_or_create", f"WITH {_CHUNKS} SELECT doc_id, chunk_no, {_FP} AS fp FROM chunks")
def g4(spark, sf_dir):
    path = shared_folder(spark, "index")
    retrieve.load_or_create(spark, path, _fingerprinted(spark, sf_dir).drop("text"))
    return retrieve.load_or_create(spark, path, None)


def letter_vector(texts: list[str]) -> list[list[float]]:
    """A stand-in for a model: how often each of eight letters occurs."""
    return [[float(t.count(c)) for c in "etaoinsr"] for t in texts]


@query("g5_embed_chunks", f"WITH {_CHUNKS} SELECT doc_id, chunk_no, " + " || ',' || ".join(f"(length(text) - length(replace(text, '{c}', '')))::VARCHAR" for c in "etaoinsr") + " AS vector FROM chunks")
def g5(spark, sf_dir):
    out = retrieve.embed_chunks(_chunks(spark, sf_dir), letter_vector)
    return out.select("doc_id", "chunk_no", F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",").alias("vector"))


def _asked(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    vectors = R.table(spark, sf_dir, "embeddings")
    return vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), vectors


def _hits(spark, sf_dir) -> DataFrame:
    return retrieve.similarity_topk(*_asked(spark, sf_dir), 5)


_TOPK = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
d AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.e, v.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist FROM v q, v WHERE q.vec_id % 50 = 0),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM d QUALIFY rank <= 5)
"""


@query("g6_similarity_topk", _TOPK + "SELECT query_id, vec_id, round(dist, 6) AS dist, rank::INT AS rank FROM h")
def g6(spark, sf_dir):
    return _hits(spark, sf_dir).select("query_id", "vec_id", F.round("dist", 6).alias("dist"), "rank")


@query("g6_similarity_score_threshold", _TOPK + "SELECT query_id, vec_id, round(dist, 6) AS dist, rank::INT AS rank FROM h WHERE 1 - dist / sqrt(2.0) >= 0.2")
def g6_threshold(spark, sf_dir):
    out = retrieve.retrieve(*_asked(spark, sf_dir), "similarity_score_threshold", score_threshold=0.2)
    return out.select("query_id", "vec_id", F.round("dist", 6).alias("dist"), "rank")


@query("g6_mmr")
def g6_mmr(spark, sf_dir):
    out = retrieve.retrieve(*_asked(spark, sf_dir), "mmr", k=4)
    return out.select("query_id", "vec_id", F.round("dist", 6).alias("dist"), "rank")


@query("g6_vector_index")
def g6_index(spark, sf_dir):
    asked, vectors = _asked(spark, sf_dir)
    path = shared_folder(spark, "vector-index")
    vector_index.build(vectors, path)
    return vector_index.search(asked, path, 5).select("query_id", "vec_id", F.round("dist", 6).alias("dist"), "rank")


@query("g6_vector_index_all_lists", _TOPK + "SELECT query_id, vec_id, round(dist, 6) AS dist, rank::INT AS rank FROM h")
def g6_index_all(spark, sf_dir):
    asked, vectors = _asked(spark, sf_dir)
    path = shared_folder(spark, "vector-index")
    vector_index.build(vectors, path)
    return vector_index.search(asked, path, 5, probes=vector_index.LISTS).select("query_id", "vec_id", F.round("dist", 6).alias("dist"), "rank")


@query("g7_assemble_context", _TOPK + "SELECT query_id, md5(string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY rank)) AS digest FROM h JOIN documents ON vec_id = doc_id GROUP BY query_id")
def g7(spark, sf_dir):
    texts = R.documents(spark, sf_dir).select(F.col("doc_id").alias("vec_id"), "text")
    return retrieve.assemble_context(_hits(spark, sf_dir), texts).select("query_id", F.md5(F.col("context").cast("binary")).alias("digest"))


_HISTORY = "h AS (SELECT conv_id, turn, role, text AS input, coalesce(string_agg(role || ':' || coalesce(text, ''), '|') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS s FROM conversations)"


def _history(spark, sf_dir) -> DataFrame:
    return retrieve.chat_history(R.table(spark, sf_dir, "conversations"))


def _said():
    return F.md5(F.array_join(F.transform("history", lambda m: F.concat_ws(":", m["role"], F.coalesce(m["text"], F.lit("")))), "|").cast("binary"))


@query("g8_chat_history", f"WITH {_HISTORY} SELECT conv_id, turn, input, md5(s) AS history FROM h WHERE role = 'user'")
def g8(spark, sf_dir):
    return _history(spark, sf_dir).select("conv_id", "turn", "input", _said().alias("history"))


@query("g9_chat_payloads", f"WITH {_HISTORY} SELECT conv_id, turn, input, md5(s) AS history, md5(coalesce(text, '')) AS context FROM h LEFT JOIN documents ON doc_id = conv_id * 10 + turn WHERE role = 'user'")
def g9(spark, sf_dir):
    history = _history(spark, sf_dir)
    wanted = history.select("conv_id", "turn", (F.col("conv_id") * 10 + F.col("turn")).alias("doc_id"))
    contexts = wanted.join(R.documents(spark, sf_dir).select("doc_id", F.col("text").alias("context")), "doc_id").drop("doc_id")
    return retrieve.chat_payloads(history, contexts).select("conv_id", "turn", "input", _said().alias("history"), F.md5(F.col("context").cast("binary")).alias("context"))


_MESSAGES = "m AS (SELECT event_id AS id, user_id, ts, CASE WHEN event_id % 3 = 2 THEN 'assistant' ELSE 'user' END AS role, event_type || event_id AS text FROM events)"
_SESSIONS = f"""WITH {_MESSAGES},
o AS (SELECT *, CASE WHEN coalesce(ts > lag(ts) OVER w + INTERVAL 6 HOUR, true) THEN ts END AS opened FROM m WINDOW w AS (PARTITION BY user_id ORDER BY ts, id)),
s AS (SELECT *, max(opened) OVER (PARTITION BY user_id ORDER BY ts, id) AS session FROM o) """


def _messages(spark, sf_dir) -> DataFrame:
    role = F.when(F.col("event_id") % 3 == 2, "assistant").otherwise("user")
    return R.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", F.col("ts").cast("timestamp").alias("ts"), role.alias("role"), F.concat("event_type", "event_id").alias("text"))


def _second(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query("g8_session_history", _SESSIONS + """, h AS (SELECT *, coalesce(string_agg(role || ':' || text, '|') OVER (PARTITION BY user_id, session ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS said FROM s)
SELECT id, user_id, strftime(session, '%Y-%m-%d %H:%M:%S') AS session, text AS input, md5(said) AS history FROM h WHERE role = 'user'""")
def g8_sessions(spark, sf_dir):
    return sessions.session_history(_messages(spark, sf_dir), "6 hours").select("id", "user_id", _second("session").alias("session"), "input", _said().alias("history"))


@query("g8_stream_sessions", _SESSIONS + """SELECT user_id, strftime(session, '%Y-%m-%d %H:%M:%S') AS session, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, count(*) AS n, md5(string_agg(text, '|' ORDER BY ts, id)) AS said
FROM s GROUP BY user_id, session HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def g8_stream(spark, sf_dir):
    out = _drained(spark, sf_dir, _messages(spark, sf_dir), lambda m: sessions.stream_sessions(m, "6 hours"))
    said = F.md5(F.array_join(F.transform("messages", lambda m: m["text"]), "|").cast("binary"))
    return out.select("user_id", _second("session").alias("session"), _second("last").alias("last"), "n", said.alias("said"))


# H: cache and retention over events: every event asks, and leaves a record

def _events(spark, sf_dir) -> DataFrame:
    return R.table(spark, sf_dir, "events").selectExpr("event_id as id", "case when event_id % 97 <> 0 then user_id end as user_id", "ts", "concat(event_type, event_id) as record", "cast(floor(value) as int) as confidence")


def _cache(spark, sf_dir) -> DataFrame:
    """What two rounds of results leave."""
    events = _events(spark, sf_dir)
    none = events.filter("false").drop("confidence")
    return store.cache_upsert(store.cache_upsert(none, events.filter("confidence <= 75")), events.filter("confidence > 75"))


_CACHE = "e AS (SELECT event_id AS id, CASE WHEN event_id % 97 <> 0 THEN user_id END AS user_id, ts, event_type || event_id AS record, floor(value)::INT AS confidence FROM events), cache AS (SELECT user_id, ts, id, record FROM e WHERE user_id IS NOT NULL AND confidence > 50 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) = 1)"


@query("h1_cache_lookup", f"WITH {_CACHE} SELECT e.id AS request_id, e.user_id, cache.record, CASE WHEN cache.record IS NULL THEN 'ocr' ELSE 'cache' END AS source FROM e LEFT JOIN cache ON e.user_id = cache.user_id")
def h1(spark, sf_dir):
    asked = _events(spark, sf_dir).select(F.col("id").alias("request_id"), "user_id")
    hits, rest = store.cache_lookup(asked, _cache(spark, sf_dir))
    return hits.unionByName(rest, allowMissingColumns=True).select("request_id", "user_id", "record", "source")


@query("h2_cache_upsert", f"WITH {_CACHE} SELECT user_id, id, record FROM cache")
def h2(spark, sf_dir):
    return _cache(spark, sf_dir).select("user_id", "id", "record")


@query("h3_retain_latest", "SELECT base, session, row_number() OVER (PARTITION BY base ORDER BY session DESC) <= 3 AS kept FROM (SELECT DISTINCT event_type AS base, 'session_' || lpad(cast(user_id AS VARCHAR), 8, '0') AS session FROM events)")
def h3(spark, sf_dir):
    sessions = R.table(spark, sf_dir, "events").select(F.col("event_type").alias("base"), F.concat(F.lit("session_"), F.lpad(F.col("user_id").cast("string"), 8, "0")).alias("session")).distinct()
    return store.retain_latest(sessions)


# A: sources, sinks, parsing (written and read back)

_LOG = "SELECT 'f' || event_id || '.png' AS filename, event_type AS model, round(value, 4) AS duration_seconds, CAST(event_id % 100 AS DOUBLE) AS confidence_score, CAST(event_id AS VARCHAR) AS number, event_type AS model_dir FROM events"


def _log(spark, sf_dir) -> DataFrame:
    details = F.struct(F.col("event_id").cast("string").alias("number"), *(F.lit(None).cast("string").alias(k) for k in ("date", "due_date", "po_number")))
    cols = results_log.log_record(F.concat(F.lit("f"), F.col("event_id").cast("string"), F.lit(".png")), F.col("ts").cast("timestamp"), F.col("event_type"), F.col("value"), F.col("event_id") % 100, F.struct(details.alias("invoice_details")))
    return R.table(spark, sf_dir, "events").select(*cols)


def _read_log(spark, sf_dir) -> DataFrame:
    path = shared_folder(spark, "results")
    results_log.write_results_log(_log(spark, sf_dir), path)
    lines = spark.read.schema(results_log.LOG_RECORD).json(path)  # what was written has a record a line
    return lines.select("metadata.filename", "metadata.model", "metadata.duration_seconds", "metadata.confidence_score", F.col("extraction.invoice_details.number").alias("number"), F.regexp_extract(F.col("_metadata.file_path"), r"/model=([^/]+)/", 1).alias("model_dir"))


query("a2_write_results_log", _LOG)(_read_log)


@query("a1_read_results_log", "SELECT o_orderpriority AS model, o_orderpriority AS model_dir, count(*) AS n, round(sum(round(o_totalprice, 4)), 2) AS seconds FROM orders GROUP BY 1")
def a1(spark, sf_dir):
    """Pretty-printed files as an extraction service leaves them, each with the records of some consecutive orders."""
    path = shared_folder(spark, "printed")
    record = F.concat(F.lit('{\n  "metadata": {\n    "filename": "f'), F.col("o_orderkey").cast("string"), F.lit('",\n    "model": "'), "o_orderpriority", F.lit('",\n    "duration_seconds": '), F.round("o_totalprice", 4).cast("decimal(18,4)").cast("string"), F.lit("\n  }\n}"))
    few = R.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("model"), F.floor(F.col("o_orderkey") / 2048)).agg(F.array_join(F.collect_list(record), ",\n").alias("r"))
    few.select("model", F.concat(F.lit("[\n"), "r", F.lit("\n]")).alias("value")).write.option("maxRecordsPerFile", 1).partitionBy("model").text(path)
    out = results_log.read_results_log(spark, path)
    return out.groupBy(F.col("metadata.model").alias("model"), "model_dir").agg(F.count("*").alias("n"), F.round(F.sum("metadata.duration_seconds"), 2).alias("seconds"))


_FROM_LOG = "SELECT event_id::BIGINT AS number, event_type AS model_dir, round(value, 4) AS duration_seconds, NULL::VARCHAR AS unfit FROM events"


def _from_log(df: DataFrame) -> DataFrame:
    return df.select(F.col("extraction.invoice_details.number").cast("long").alias("number"), "model_dir", "metadata.duration_seconds", "unfit")


@query("a1_results_source", f"SELECT *, model_dir = 'error' AS alert FROM ({_FROM_LOG})")
def a1_source(spark, sf_dir):
    """The log read by its own data source, alerts by a pushed filter and the rest by option, which folder names answer."""
    path = shared_folder(spark, "results")
    results_log.write_results_log(_log(spark, sf_dir), path)
    models = [r[0] for r in R.table(spark, sf_dir, "events").select("event_type").distinct().collect()]  # a folder each
    alerts = log_source.results_source(spark, push=True).load(path).filter("model_dir = 'error'")
    rest = log_source.results_source(spark, models=[m for m in models if m != "error"]).load(path)
    return _from_log(alerts).withColumn("alert", F.lit(True)).unionByName(_from_log(rest).withColumn("alert", F.lit(False)))


@query("a1_stream_results", _FROM_LOG)
def a1_stream(spark, sf_dir):
    """The log read by its own data source as a stream that is stopped and started again; each record comes once."""
    path = shared_folder(spark, "results")
    log = _log(spark, sf_dir)
    half = F.pmod(F.xxhash64("metadata.filename"), F.lit(2))
    for part in (0, 1):
        results_log.write_results_log(log.filter(half == part), f"{path}/log")
        stream = _from_log(log_source.results_source(spark, stream=True).option("settleSeconds", 0).load(f"{path}/log"))
        stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


@query("a3_read_text_documents", f"SELECT count(*) AS files, sum(chars)::BIGINT AS chars FROM (SELECT sum(length({R.INVOICE_TEXT})) AS chars FROM orders GROUP BY floor(o_orderkey / 512))")
def a3(spark, sf_dir):
    """Each text file holds the texts of some consecutive orders."""
    path = shared_folder(spark, "texts")
    few = R.invoice_texts(spark, sf_dir).groupBy(F.floor(F.col("doc_id") / 512).alias("part")).agg(F.array_join(F.collect_list("text"), "").alias("value"))
    few.select("value").write.option("maxRecordsPerFile", 1).text(path)
    read = documents.read_text_documents(spark, f"{path}/*.txt")
    return read.filter("text <> ''").agg(F.count("*").alias("files"), F.sum(F.length(F.regexp_replace("text", r"\n\z", ""))).alias("chars"))


_SUFFIX = "CASE o_orderkey % 6 WHEN 0 THEN '.JPG' WHEN 1 THEN '.pdf' WHEN 2 THEN '.docx' WHEN 3 THEN '.txt' WHEN 4 THEN '' ELSE '.tar.gz' END"


@query("a4_route_by_suffix", f"WITH p AS (SELECT 'x/' || o_orderkey || {_SUFFIX} AS path, o_orderkey % 6 AS k FROM orders) SELECT path, ['.jpg', '.pdf', '.docx', '.txt', '', '.gz'][k + 1] AS suffix, ['image', 'pdf', 'docx', 'unsupported', 'unsupported', 'unsupported'][k + 1] AS route, k IN (1, 2, 3) AS chat_loads FROM p")
def a4(spark, sf_dir):
    return documents.route_by_suffix(R.table(spark, sf_dir, "orders").selectExpr(f"concat('x/', o_orderkey, {_SUFFIX}) as path"))


@query("a5_parse_model_json", "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'D' || o_custkey END AS doc_type, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE 95 END AS confidence, o_orderkey % 7 = 0 AS failed FROM orders")
def a5(spark, sf_dir):
    body = "concat('{\"doc_type\": \"D', o_custkey, '\"}')"
    df = R.table(spark, sf_dir, "orders").selectExpr("o_orderkey as doc_id", f"case when o_orderkey % 7 = 0 then concat('sorry, ', {body}) when o_orderkey % 7 = 1 then {body} else concat('```json', chr(10), {body}, chr(10), '```', chr(10)) end as content")
    return results_log.parse_model_json(df).select("doc_id", "data.doc_type", "confidence", F.col("error").isNotNull().alias("failed"))


@query("a7_conform_results", _invoice_sql("doc_id, doc_type, vendor_name_guess AS vendor, invoice_number AS number, TRY_CAST(total_amount AS DOUBLE) AS total"))
def a7(spark, sf_dir):
    out = results_log.conform_results(invoices.extract_invoices(R.invoice_texts(spark, sf_dir)).drop("doc_type"))
    return out.select("doc_id", "conformed.doc_type", F.col("conformed.vendor.name").alias("vendor"), F.col("conformed.invoice_details.number").alias("number"), F.col("conformed.financials.total_amount").alias("total"))


@query("a8_conform_metadata", "SELECT event_id, event_type AS title, CASE WHEN event_id % 3 > 0 THEN event_id::INT END AS page_count FROM events")
def a8(spark, sf_dir):
    answer = F.concat(F.lit('{"Title": "'), "event_type", F.lit('", "Author": ["a"], "PageCount": '), F.when(F.col("event_id") % 3 == 0, '"Not Available"').otherwise(F.col("event_id").cast("string")), F.lit("}"))
    return documents.conform_metadata(R.table(spark, sf_dir, "events").select("event_id", answer.alias("answer"))).select("event_id", F.col("meta.Title").alias("title"), "page_count")


@query("a9_chunk_index", f"WITH {_CHUNKS} SELECT source AS session_id, count(*) AS n, sum(length(text))::BIGINT AS chars FROM chunks GROUP BY 1")
def a9(spark, sf_dir):
    path = shared_folder(spark, "chunks")
    documents.write_chunk_index(_chunks(spark, sf_dir).select(F.col("source").alias("session_id"), "doc_id", "chunk_no", "text"), path)
    return documents.read_chunk_index(spark, path).groupBy("session_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


# I: streams over events, run to their end

def _drained(spark, sf_dir, source: DataFrame, build) -> DataFrame:
    """Writes source as files, streams them through build into a file sink, and reads the sink."""
    path = shared_folder(spark, "stream")
    source.write.parquet(f"{path}/in")
    stream = build(spark.readStream.schema(source.schema).parquet(f"{path}/in"))
    stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


@query("i1_stream_extract", _invoice_sql(f"doc_id, doc_type, total_amount, {_CONFIDENCE}"))
def i1(spark, sf_dir):
    out = _drained(spark, sf_dir, R.invoice_texts(spark, sf_dir), streaming.stream_extract)
    return out.select("doc_id", "doc_type", "data.total_amount", "confidence")


@query("i2_stream_results_metrics", """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type AS model, count(*) AS n, round(avg(value), 6) AS avg_s, round(max(value), 6) AS max_s
FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY ALL""")
def i2(spark, sf_dir):
    source = R.table(spark, sf_dir, "events").select(F.col("ts").alias("timestamp"), F.col("event_type").alias("model"), F.col("value").alias("duration_seconds"), F.lit(95.0).alias("confidence_score"))
    out = _drained(spark, sf_dir, source, streaming.stream_results_metrics)
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "model", "n", F.round("avg_s", 6).alias("avg_s"), F.round("max_s", 6).alias("max_s"))


def _metrics_log(spark, sf_dir) -> DataFrame:
    return R.table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type").alias("model"), F.col("value").alias("duration_seconds"), (F.col("user_id") % 5).cast("double").alias("confidence_score"))


def _within(log: DataFrame, figures: DataFrame, keys: list[str]) -> list[DataFrame]:
    """figures, with p50_close and p95_close: whether at most one in a hundred of the exact ranks lies between."""
    both = log.join(figures, keys)
    share = lambda at, c: (F.count_if(F.col("duration_seconds") < F.col(c)) / F.count("*") <= at + 0.01) & (F.count_if(F.col("duration_seconds") <= F.col(c)) / F.count("*") >= at - 0.01)
    return both.groupBy(*keys).agg(share(0.5, "median_s").alias("p50_close"), share(0.95, "p95_s").alias("p95_close"))


@query("i2_stream_quantiles", """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type AS model, count(*) AS n, round(avg((user_id % 5 > 0)::INT), 6) AS success_rate, true AS p50_close, true AS p95_close
FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY ALL""")
def i2_quantiles(spark, sf_dir):
    log = _metrics_log(spark, sf_dir)
    out = _drained(spark, sf_dir, log, streaming.stream_results_metrics).withColumn("hour", F.date_format("window_start", "yyyy-MM-dd HH"))
    close = _within(log.withColumn("hour", F.date_format("timestamp", "yyyy-MM-dd HH")), out.select("hour", "model", "median_s", "p95_s"), ["hour", "model"])
    return out.join(close, ["hour", "model"]).select("hour", "model", "n", F.round("success_rate", 6).alias("success_rate"), "p50_close", "p95_close")


@query("i2_stream_sliding", """
SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, event_type AS model, count(*) AS n, round(max(value), 6) AS max_s
FROM (SELECT *, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s FROM events)
WHERE s + INTERVAL 2 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY ALL""")
def i2_sliding(spark, sf_dir):
    out = _drained(spark, sf_dir, _metrics_log(spark, sf_dir), lambda s: streaming.stream_results_metrics(s, "2 hours", slide="1 hour"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("start"), "model", "n", F.round("max_s", 6).alias("max_s"))


@query("i2_rollup_metrics", """
WITH w AS (SELECT event_type AS model, ts::DATE AS day, hour(ts) AS hour, value, user_id FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events))
SELECT model, strftime(day, '%Y-%m-%d') AS day, hour::INT AS hour, count(*) AS n, round(avg((user_id % 5 > 0)::INT), 6) AS success_rate, round(avg(value), 6) AS avg_s, true AS p50_close, true AS p95_close
FROM w GROUP BY GROUPING SETS ((model, day, hour), (model, day), (model))""")
def i2_rollup(spark, sf_dir):
    log = _metrics_log(spark, sf_dir)
    windows = _drained(spark, sf_dir, log, streaming.stream_results_metrics)
    closed = log.join(F.broadcast(windows.agg((F.max("window_start") + F.expr("interval 1 hour")).alias("end"))), F.col("timestamp") < F.col("end"))  # one row
    out = streaming.rollup_metrics(windows).withColumns({"day": F.coalesce(F.date_format("day", "yyyy-MM-dd"), F.lit("all")), "hour": F.coalesce("hour", F.lit(-1))})
    hours, days = F.hour("timestamp"), F.date_format("timestamp", "yyyy-MM-dd")
    levels = closed.select("model", "duration_seconds", F.explode(F.array(F.struct(days.alias("day"), hours.alias("hour")), F.struct(days.alias("day"), F.lit(-1).alias("hour")), F.struct(F.lit("all").alias("day"), F.lit(-1).alias("hour")))).alias("l")).select("model", "duration_seconds", "l.*")
    close = _within(levels, out.select("model", "day", "hour", "median_s", "p95_s"), ["model", "day", "hour"])
    return out.join(close, ["model", "day", "hour"]).select("model", F.nullif("day", F.lit("all")).alias("day"), F.nullif("hour", F.lit(-1)).alias("hour"), "n", F.round("success_rate", 6).alias("success_rate"), F.round("avg_s", 6).alias("avg_s"), "p50_close", "p95_close")


@query("h1_stream_cache_lookup", """
WITH
r AS (SELECT event_id AS request_id, user_id, ts FROM events WHERE event_id % 3 = 0),
c AS (SELECT user_id, ts, CASE WHEN event_id % 7 > 0 THEN 'r' || event_id ELSE '' END AS record FROM events WHERE event_id % 3 > 0)
SELECT r.request_id, r.user_id, max(struct_pack(t := c.ts, record := c.record)).record AS record, CASE WHEN count(c.record) > 0 THEN 'cache' ELSE 'ocr' END AS source
FROM r LEFT JOIN c ON c.user_id = r.user_id AND c.ts <= r.ts AND c.ts >= r.ts - INTERVAL 1 DAY AND c.record <> '' GROUP BY ALL""")
def h1_stream(spark, sf_dir):
    events = R.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    path = shared_folder(spark, "stream")
    clock = events.agg((F.max("ts") + F.expr("interval 30 days")).alias("ts"))  # a row that closes all others, on both sides
    asked = events.filter("event_id % 3 = 0").select("event_id", "user_id", "ts").unionByName(clock.select(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("user_id"), "ts"))
    known = events.filter("event_id % 3 > 0").select("user_id", "ts", F.when(F.col("event_id") % 7 > 0, F.concat(F.lit("r"), "event_id")).otherwise("").alias("record")).unionByName(clock.select(F.lit(-2).cast("long").alias("user_id"), "ts", F.lit("-").alias("record")))
    streams = []
    for name, df in (("asked", asked), ("known", known)):
        df.write.parquet(f"{path}/{name}")
        streams.append(spark.readStream.schema(df.schema).parquet(f"{path}/{name}"))
    out = streaming.stream_cache_lookup(streams[0].withColumnRenamed("event_id", "request_id"), streams[1])
    out.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out").filter("request_id >= 0").select("request_id", "user_id", "record", "source")


@query("d6_stream_merge", _D + f"SELECT batch_id, kind, out_pos::INT AS out_pos, {_FLAT} FROM d6")
def d6_stream(spark, sf_dir):
    rows = R.page_results(spark, sf_dir)
    base = shared_folder(spark, "batches")
    # pages of a batch arrive in three loads, the last of them after the batch has closed once; then a page of no batch moves the clock
    arrival = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("load") * 7200 + F.when(F.col("load") == 1, -7000).otherwise(0) + F.col("pos"))
    timed = rows.withColumn("load", F.col("pos") % 3).withColumn("arrived_at", arrival)
    files = spark.sparkContext.defaultParallelism  # of a load, which a trigger takes together
    for load in range(3):
        timed.filter(F.col("load") == load).drop("load").repartition(files).write.mode("append").parquet(f"{base}/in")
    timed.limit(1).withColumns({"batch_id": F.lit(None).cast("long"), "arrived_at": F.timestamp_seconds(F.lit(1_800_000_000))}).drop("load").write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(timed.drop("load").schema).option("maxFilesPerTrigger", files).parquet(f"{base}/in")
    batches.stream_merge(stream, f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return _flat(batches.read_merged(spark, f"{base}/out"), "out_pos")


@query("i3_stream_dedupe", "SELECT DISTINCT user_id || '-' || event_type AS fp FROM events")
def i3(spark, sf_dir):
    source = R.table(spark, sf_dir, "events").select(F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("fp"), "ts")
    return _drained(spark, sf_dir, source, lambda s: streaming.stream_dedupe(s, late="3650 days")).select("fp")


@query("i3_stream_cache_upsert", f"WITH {_CACHE} SELECT user_id, id, record FROM cache")
def i3b(spark, sf_dir):
    path = shared_folder(spark, "cache")
    source = _events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    source.write.parquet(f"{path}/in")
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 4).parquet(f"{path}/in")
    run = streaming.stream_cache_upsert(stream, path).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return streaming.read_cache(spark, path).select("user_id", "id", "record")


@query("i3_stream_cache_deltas", f"WITH {_CACHE} SELECT user_id, id, record FROM cache")
def i3_deltas(spark, sf_dir):
    path = shared_folder(spark, "cache")
    source = _events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    source.repartition(6, "ts").write.parquet(f"{path}/in")
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    run = cache.stream_cache_append(stream, f"{path}/cache", every=4).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return cache.read_cache(spark, f"{path}/cache").select("user_id", "id", "record")
