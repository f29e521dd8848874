"""Operators that keep the columns of their tables: names that they use themselves, and ids of text."""

import pytest
from pyspark.sql import functions as F

from docjobs.llm import common, decontam, exact_dedup, html_extract, near_copies, packing, secrets, simhash, toxicity, url_filter

NAMES = "_key _text _shared _points _length _hit key doc row rest number points sha body node root n p x features probability rawPrediction prediction calibrated score label part words runs host at a.b".split()
WORDS = "one two three four five six seven eight nine ten eleven twelve"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [("d1", WORDS), ("d2", WORDS.replace(" ", "  ")), ("d3", WORDS + " and some more words that are its own here"), ("d4", ""), ("d5", None), (None, "alone")]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    return df.select("*", *(F.concat(F.lit(f"{n}:"), F.coalesce("doc_id", F.lit("-"))).alias(n) for n in NAMES))


def whole(df, docs):
    """The ids of df, whose columns must be those of docs as they were."""
    assert df.columns == docs.columns
    rows = df.collect()
    for r in rows:
        assert [r[n] for n in NAMES] == [f"{n}:{r['doc_id'] or '-'}" for n in NAMES]
    return sorted(str(r["doc_id"]) for r in rows)


def test_exact_dedup(docs):
    assert whole(exact_dedup.drop_duplicates(docs), docs) == ["None", "d2", "d3", "d4"]
    out = exact_dedup.assign_owners(docs)
    assert out.columns == [*docs.columns, *exact_dedup.ADDED] and {(r["doc_id"], r["keep_id"]) for r in out.collect()} == {("d1", "d2"), ("d2", "d2"), ("d3", "d3"), ("d4", "d4"), ("d5", "d4"), (None, None)}


@pytest.mark.parametrize("dedup", [simhash.near_dedup, near_copies.near_dedup])
def test_near_dedup(docs, dedup):
    left = whole(dedup(docs), docs)
    assert "d1" in left and "d2" not in left and "d3" in left and "d4" in left and "d5" not in left


def test_decontaminate(spark, docs):
    items = spark.createDataFrame([("i", WORDS, "x")], "item_id string, text string, window string")
    assert whole(decontam.decontaminate(docs, items), docs) == ["None", "d4", "d5"]


def test_drop_toxic(spark, docs):
    labels = spark.createDataFrame([("d1", 0, 1), ("d3", 0, 1)], "doc_id string, toxic int, quality int")
    assert whole(toxicity.drop_toxic(docs, labels), docs) == sorted(["None", "d1", "d2", "d3", "d4", "d5"])


def test_drop_toxic_with_trees(spark):
    rows = [(f"t{i}", f"{w} some plain words {i}") for i in range(60) for w in (["you idiot moron scum"] if i % 2 else ["quite nice"])]
    df = spark.createDataFrame(rows, "doc_id string, text string").select("*", *(F.concat(F.lit(f"{n}:"), "doc_id").alias(n) for n in NAMES))
    labels = spark.createDataFrame([(f"t{i}", i % 2) for i in range(60)], "doc_id string, toxic int")
    assert whole(toxicity.drop_toxic(df, labels), df) == sorted(f"t{i}" for i in range(0, 60, 2))


def test_others_take_ids_of_text(spark, docs):
    assert packing.pack(docs).count() == 6 and secrets.find_secrets(docs).count() == 6
    caps = docs.withColumn("url", F.lit("http://h.example/x")).withColumn("fetched_at", F.lit("2024-01-02").cast("timestamp"))
    entries = spark.createDataFrame([("l", False, "domain", "h.example", "add", None)], "list string, allow boolean, kind string, pattern string, action string, dated timestamp").withColumn("dated", F.lit("2024-01-01").cast("timestamp"))
    out = url_filter.filter_urls(caps, entries)
    assert out.columns == [*(c for c in caps.columns if c != "host"), *url_filter.ADDED] and out.filter("blocked").count() == 6


BROKEN = "SELECT 1L AS doc_id, cast(X'FF4142' AS string) AS text, 'h' AS url, 1L AS page_id UNION ALL SELECT 2L, 'plain words', 'h', 2L"


def test_bytes_that_are_no_utf8(spark):
    docs = spark.sql(BROKEN)
    assert simhash.classes(docs).count() == 2 and near_copies.near_dedup(docs).count() == 2
    assert secrets.find_secrets(docs).count() == 2 and exact_dedup.assign_owners(docs).filter("kept").count() == 2
    out = html_extract.extract(docs.withColumnRenamed("text", "html")).collect()
    assert sorted(r.page_id for r in out) == [1, 2]
    labels = spark.createDataFrame([(1, 0, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.score_toxicity(docs, labels).count() == 2


def test_batch_sizes_with_units(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        for given, left in (("64m", 4 << 20), ("1m", 1 << 20), ("1048576b", 1 << 20)):
            spark.conf.set(key, given)
            common.small_batches(spark)
            assert spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) == left
    finally:
        spark.conf.set(key, before)


def test_rows_without_ids_are_packed_in_many_tasks(spark):
    docs = spark.range(90_000).selectExpr("cast(null as long) AS doc_id", "repeat('w ', cast(id % 3 + 1 as int)) AS text")
    out = packing.pack(docs).withColumn("task", F.spark_partition_id())
    assert out.count() == 90_000 and out.select("bucket", "batch", "slot").distinct().count() == 90_000
    stretches = [r.n for r in spark.read.parquet(common._made[-1]).groupBy("stretch").agg(F.count("*").alias("n")).collect()]
    assert len(stretches) >= 4 and max(stretches) < 60_000


@pytest.mark.parametrize("own", [True, False])
def test_trees_where_a_part_of_the_sample_has_one_label(spark, own):
    """own: whether the rows of the trees, or those of the calibration, hold one label alone."""
    ids = spark.range(400).selectExpr("id AS doc_id", "pmod(xxhash64(concat('part', cast(id as string))), 10) < 7 AS tree", "crc32(cast(id as string)) % 5 AS fold").filter("fold <> 0").collect()
    rows = [(r.doc_id, 1 if r.tree != own and i % 2 else 0) for i, r in enumerate(ids)]
    docs = spark.createDataFrame([(i, "you idiot moron scum" if y else "quite nice") for i, y in rows], "doc_id long, text string")
    labels = spark.createDataFrame(rows, "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs, labels).collect()}
    assert got == dict(rows)
