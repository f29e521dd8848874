"""Verification of claims against document text: exact and normalised matches by built-in expressions, the rest by score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docjobs.functions.text import fuzzy_score, fuzzy_scores, normalize_text
from docjobs.sources.shared import small_batches

#: Scores from which a claim passes or is doubtful: entities, clauses.
ENTITY_PASS, ENTITY_WARN, CLAUSE_PASS, CLAUSE_WARN = 90, 70, 85, 60
#: Claims of one document that are checked in one row.
TOGETHER = 64

_CHECK = "struct<result:string,score:double,method:string,excerpt:string>"


def _check(result: Column | str, score: Column | float, method: str, excerpt: Column | None = None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(result).alias("result"), lit(score).cast("double").alias("score"), F.lit(method).alias("method"), (F.lit(None).cast("string") if excerpt is None else excerpt).alias("excerpt"))


def _graded(score: Column, passes: float, warns: float, method: str) -> Column:
    return _check(F.when(score >= passes, "pass").when(score >= warns, "warn").otherwise("fail"), score, method)


def _decide(entity: Column, none: Column, exact: Column, normal: Column, score: Column, claim: Column) -> Column:
    """The check of a claim; only entities can be missing or match when normalised."""
    return (
        F.when(entity & none, _check("missing", 0.0, "none"))
        .when(exact, _check("pass", 100.0, "exact", claim))
        .when(entity & normal, _check("pass", 95.0, "normalized_exact"))
        .when(entity, _graded(score, ENTITY_PASS, ENTITY_WARN, "fuzzy"))
        .otherwise(_graded(score, CLAUSE_PASS, CLAUSE_WARN, "semantic/fuzzy"))
    )


def _with_scores(df: DataFrame, claim: str, text: str, needs_score: Column) -> DataFrame:
    """Adds _score where neither comparison by built-ins has decided; other rows send nulls to Python."""
    df = df.withColumn("_ask", needs_score)
    return df.withColumn("_score", fuzzy_score(F.when(F.col("_ask"), F.col(claim)), F.when(F.col("_ask"), F.col(text)))).drop("_ask")


def _decided(claim: Column, text: Column) -> dict[str, Column]:
    norm = normalize_text(claim)
    return {"_none": norm == "", "_exact": text.contains(claim), "_normal": normalize_text(text).contains(norm)}


def verify_entity(df: DataFrame, claim: str = "claim", text: str = "text") -> DataFrame:
    """df plus check: missing, exact, normalised or by score."""
    return _verify(df, F.lit(True), claim, text)


def verify_clause(df: DataFrame, claim: str = "claim", text: str = "text") -> DataFrame:
    """df plus check: exact or by score; there is no normalised step."""
    return _verify(df, F.lit(False), claim, text)


def _verify(df: DataFrame, entity: Column, claim: str, text: str) -> DataFrame:
    small_batches(df.sparkSession)
    df = df.withColumn("_entity", entity).withColumns(_decided(F.col(claim), F.col(text)))
    entity, none, exact, normal = (F.col(c) for c in ("_entity", "_none", "_exact", "_normal"))
    df = _with_scores(df, claim, text, ~exact & ~(entity & (none | normal)))
    check = _decide(entity, none, exact, normal, F.col("_score"), F.col(claim))
    return df.withColumn("check", check).drop("_entity", "_none", "_exact", "_normal", "_score")


def quick_verify(checks: DataFrame, docs: DataFrame) -> DataFrame:
    """checks (doc_id, ord, id, type, value; see parse_claims) against docs (doc_id, text).

    The claims of a document go together, ``TOGETHER`` of them at most: its text is moved, normalised and prepared for
    scores once for them all.
    """
    small_batches(docs.sparkSession)
    some = checks.groupBy("doc_id", F.floor(F.col("ord") / TOGETHER).alias("part")).agg(F.collect_list(F.struct("ord", "id", "type", "value")).alias("claims"))
    joined = some.join(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id")
    entity = lambda c: c["type"] != "clause_change"
    exact = lambda c: F.col("text").contains(c["value"])

    def seen(c: Column, normal: Column) -> Column:
        none = ~F.lower(F.coalesce(c["value"], F.lit(""))).rlike("[a-z0-9]")  # an empty text when normalised
        return F.struct(c["ord"].alias("ord"), c["id"].alias("id"), c["type"].alias("type"), c["value"].alias("value"), entity(c).alias("entity"), none.alias("none"), exact(c).alias("exact"), F.when(entity(c) & ~exact(c), normal.contains(normalize_text(c["value"]))).otherwise(False).alias("normal"))

    asks = F.exists("claims", lambda c: entity(c) & ~exact(c))
    once = F.array(F.when(asks, normalize_text(F.col("text"))))  # a plain column would be inlined, and computed for each claim
    looked = joined.select("doc_id", "text", F.get(F.transform(once, lambda normal: F.transform("claims", lambda c: seen(c, normal))), F.lit(0)).alias("claims"))
    open_ = lambda c: ~c["exact"] & ~(c["entity"] & (c["none"] | c["normal"]))
    asked = F.transform("claims", lambda c: F.when(open_(c), c["value"]))
    scored = looked.withColumn("scores", fuzzy_scores(asked, F.when(F.exists("claims", open_), F.col("text"))))
    rows = scored.select("doc_id", F.explode(F.arrays_zip("claims", "scores")).alias("x")).select("doc_id", "x.claims.*", F.col("x.scores").alias("score"))
    check = _decide(*(F.col(c) for c in ("entity", "none", "exact", "normal", "score", "value")))
    return rows.select("doc_id", "ord", "id", "type", "value", check.alias("check")).select("doc_id", "ord", "id", "type", "value", "check.*")


def verification_summary(results: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, n_checks, average_score (0 without checks) for each document."""
    mean = results.groupBy("doc_id").agg(F.count("*").alias("n_checks"), F.avg("score").alias("average_score"))
    return docs.select("doc_id").join(mean, "doc_id", "left").select("doc_id", F.coalesce("n_checks", F.lit(0).cast("long")).alias("n_checks"), F.coalesce("average_score", F.lit(0.0)).alias("average_score"))
