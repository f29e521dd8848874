"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of two lexicons (a short fixed one, and one of word beginnings learned from the
labels), hits near second-person words, capitals, punctuation, and obfuscated spellings. A bounded, documented sample of
labelled rows (``TRAIN_ROWS``, chosen by a hash of the id, never a held-out row) fits the learned lexicon, the trees
(Spark MLlib) and, on rows that the trees have not seen, the calibration; every document is then scored.

Defined results: bytes that are no UTF-8 count as U+FFFD, and come back so; where the rows of the trees or of the calibration hold
one label alone, but all rows both, the trees learn from all rows and the score is their own chance; where all rows have one label, so has every score;
null and empty texts are scored from all-zero features; repeated rows get equal scores; labels that are
null or have no document are not used; a document labelled more than once counts by its highest label; with no labels,
or labels of one value, every score is that value (0 without any); an empty table gives an empty result; further
columns are not looked at, and ``drop_toxic`` keeps them whatever their names.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from docjobs.llm.common import columns, small_batches, valid, written
from docjobs.llm.toxicity_features import feature_rows, term_rows

#: Labelled rows that may train: the bound of the sample.
TRAIN_ROWS = 20_000
#: Entries of the learned lexicon at most, documents that an entry needs, and its least log-likelihood ratio.
LEXICON, LEAST_DOCS, LEAST_RATIO = 2000, 4, 25.0
THRESHOLD = 0.5
#: The part of a score that the trees' own chance has, to order what isotonic regression makes equal.
TIE = 1e-6


def featured(docs: DataFrame, learned: dict[str, float], text: str = "text", keep_text: bool = False) -> DataFrame:
    """rest (a struct of docs' other columns), text (if kept) and x (the features), so that no name of the user's can clash."""
    given = docs.select(valid(text).alias("text"), F.struct(*columns(docs, text)).alias("rest"))
    shape = [given.schema["rest"], *([given.schema["text"]] if keep_text else []), StructField("x", ArrayType(DoubleType()))]
    return given.mapInArrow(feature_rows(learned, keep_text), StructType(shape))


def held_out(doc_id: str = "doc_id") -> Column:
    return (F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0)


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, text, y of at most about so many labelled documents, none of them held out."""
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    share = min(1.0, rows / max(1, usable.count()))
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 32)) / F.lit(float(1 << 32))
    sample = usable.filter(place < share).groupBy("doc_id").agg(F.max("toxic").cast("double").alias("y"))
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # bounded by `rows`


def learn_lexicon(train: DataFrame) -> dict[str, float]:
    """Word beginnings that mark toxic documents, with their log odds; at most LEXICON of them."""
    terms = train.select(valid("text").alias("text"), "y").mapInArrow(term_rows, "term string, neg long, pos long").groupBy("term").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    total = train.agg(F.sum((F.col("y") > 0).cast("long")).alias("p"), F.sum((F.col("y") <= 0).cast("long")).alias("n")).first()
    p, n = float(total["p"] or 0), float(total["n"] or 0)
    if not p or not n:
        return {}
    a, b, all_ = F.col("pos").cast("double"), F.col("neg").cast("double"), p + n
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    has = a + b
    ratio = 2 * (part(a, has * p / all_) + part(b, has * n / all_) + part(p - a, (all_ - has) * p / all_) + part(n - b, (all_ - has) * n / all_))
    odds = F.log((a + 0.5) / (p + 1)) - F.log((b + 0.5) / (n + 1))
    chosen = terms.filter((F.col("term") != "") & (a >= LEAST_DOCS)).withColumn("ratio", ratio).withColumn("odds", odds).filter((F.col("ratio") >= LEAST_RATIO) & (F.col("odds") > 1.5))
    return {r["term"]: r["odds"] for r in chosen.orderBy(F.desc("ratio"), "term").limit(LEXICON).collect()}


class Scorer:
    """What training leaves: the lexicon, the trees and the calibration, or a constant."""

    def __init__(self, docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS):
        small_batches(docs.sparkSession)
        train = written(training_rows(docs, labels, rows).repartition(8), "toxicity-train")
        self.learned = learn_lexicon(train)
        x = written(featured(train, self.learned), "toxicity-features").coalesce(4).withColumn("features", array_to_vector("x"))
        x = x.withColumn("part", F.pmod(F.xxhash64(F.concat(F.lit("part"), F.col("rest.doc_id").cast("string"))), F.lit(10)))
        x = x.select("features", F.col("rest.y").alias("label"), "part").cache()
        try:
            seen = {(r["label"], r["own"]) for r in x.groupBy("label", (F.col("part") < 7).alias("own")).agg(F.count("*").alias("n")).collect()}
            self.constant = None
            if len({y for y, _ in seen}) < 2:
                self.constant = max([y for y, _ in seen], default=0.0)
                return
            both = all(len({y for y, own in seen if own == part}) == 2 for part in (True, False))  # else nothing is left to calibrate with
            self.trees = GBTClassifier(maxIter=20, maxDepth=3, stepSize=0.3, minInstancesPerNode=3, seed=7, cacheNodeIds=False).fit(x.filter("part < 7") if both else x)
            fresh = self.trees.transform(x.filter("part >= 7")).select("label", vector_to_array("probability")[1].alias("p"))
            self.isotonic = IsotonicRegression(featuresCol="p", labelCol="label").fit(fresh) if both else None
            self.least = 1 / (fresh.count() + 2)
        finally:
            x.unpersist()

    def score(self, docs: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
        """rest (a struct of docs' other columns), text (if kept) and score.

        The score is the calibrated chance, to a millionth: so much of the trees' own chance orders documents of one
        step. It is no surer than the rows of the calibration allow (by the rule of succession).
        """
        if self.constant is not None:
            own = docs.select(F.struct(*columns(docs, text)).alias("rest"), *([F.col(text).alias("text")] if keep_text else []))
            return own.withColumn("score", F.lit(float(self.constant)))
        x = featured(docs, self.learned, text, keep_text).withColumn("features", array_to_vector("x"))
        out = self.trees.transform(x).withColumn("p", vector_to_array("probability")[1])
        score = F.col("p")
        if self.isotonic is not None:
            out = self.isotonic.setPredictionCol("calibrated").transform(out)
            score = F.least(F.lit(1 - self.least), F.greatest(F.lit(self.least), F.col("calibrated"))) + TIE * (F.col("p") - 0.5)
        score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
        return out.select("rest", *(["text"] if keep_text else []), score.alias("score"))


def score_toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text)."""
    own = docs.select("doc_id", "text")
    scored = Scorer(own, labels, rows).score(own)
    return scored.select("rest.doc_id", "score").select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents with scores below the threshold; the columns of docs. A text goes through Python once, with no shuffle."""
    scored = Scorer(docs.select("doc_id", "text"), labels, rows).score(docs, keep_text=True)
    return scored.filter(F.col("score") < THRESHOLD).select(*(F.col("text") if c == "text" else F.col("rest")[c].alias(c) for c in docs.columns))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the score of each document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_toxicity(docs, labels)
