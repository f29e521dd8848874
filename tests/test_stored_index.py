"""Appends to a stored index: the same rows as a plain walk, and which partitions they read."""

import re

import pytest
from pyspark.sql import functions as F

from docjobs.operators import retrieve, stored_index

SHAPE = "fp string, n long, part string, gen string, block int"


def walk(loads):
    """The rows that each load adds."""
    known, out = set(), []
    for load in loads:
        first = {}
        for fp, n, *rest in sorted(load, key=lambda r: r[1]):
            first.setdefault(fp, (fp, n, *rest))
        out.append(sorted((r for fp, r in first.items() if fp not in known), key=str))
        known |= {fp for fp in first if fp is not None}
    return out


def loads():
    row = lambda fp, n: (fp, n, "p", None, n % 3)
    return [
        [row(f"a::{i}", i) for i in range(4000)] + [row(None, 4000), row("hot", 4001)] + [row("hot", 5000 + i) for i in range(2000)],
        [row(f"b::{i}", i) for i in range(3000)] + [row(f"a::{i}", 3000 + i) for i in range(0, 4000, 7)] + [row(None, 9000), row("", 9001), row("hot", 9002)],
        [row(f"a::{i}", i) for i in range(4000)],
        [],
        [row(f"c::{i}", i) for i in range(50)] + [row("b::17", 60), row("x" * 100_000, 61)],
    ]


@pytest.fixture(scope="module")
def grown(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "chunks")
    added = [sorted(map(tuple, stored_index.add_to_index(spark.createDataFrame(load, SHAPE), path, ["n"], 256).collect()), key=str) for load in loads()]
    return path, added


def test_each_append_adds_what_a_walk_adds(spark, grown):
    path, added = grown
    assert added == walk(loads())
    assert sorted(map(tuple, stored_index.read_index(spark, path).select("fp", "n", "part", "gen", "block").collect()), key=str) == sorted(sum(added, []), key=str)
    assert stored_index.generations(spark, path).count() == 3  # loads that add nothing leave no generation


def test_same_rows_as_the_anti_join(spark, grown):
    path, _ = grown
    new = spark.createDataFrame([(f"a::{i}", i) for i in range(3990, 4020)] + [("b::1", 1), ("z", 2), ("z", 1)], "fp string, n long")
    plain = retrieve.add_documents(new, stored_index.read_index(spark, path), ["n"])
    maybe = stored_index.may_be_known(spark, new, path)
    known = maybe.join(stored_index.stored_rows(spark, path, maybe.select("gen", "part").distinct().collect()), ["gen", "part", "fp"], "left_semi")
    assert {r.fp for r in new.collect()} - {r.fp for r in known.collect()} == {r.fp for r in plain.collect()}


def test_filters_rule_out_nearly_all_that_is_new(spark, grown):
    path, _ = grown
    new = spark.range(20_000).select(F.concat(F.lit("new::"), "id").alias("fp"))
    assert stored_index.may_be_known(spark, new, path).select("fp").distinct().count() < 20_000 * 0.005 * 3  # three generations
    old = spark.createDataFrame([(f"a::{i}",) for i in range(4000)], "fp string")
    assert stored_index.may_be_known(spark, old, path).select("fp").distinct().count() == 4000  # none is lost


def test_the_plan_shows_which_partitions_are_read(spark, grown):
    path, _ = grown
    new = spark.createDataFrame([("a::5",), ("a::6",), ("fresh::1",)], "fp string")
    parts = stored_index.may_be_known(spark, new, path).select("gen", "part").distinct().collect()
    rows = stored_index.stored_rows(spark, path, parts)
    n_parts = stored_index.generations(spark, path).agg(F.sum("partitions")).first()[0]
    assert 1 <= len(parts) <= 5 < n_parts
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*part", plan)
    assert len({re.sub(r"/[^/]*$", "", f) for f in rows.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}) == len(parts)


def test_unlisted_generations_and_compaction(spark, tmp_path):
    path = str(tmp_path / "chunks")
    some = lambda a, b: spark.range(a, b).select(F.concat(F.lit("k"), "id").alias("fp"), "id")
    for a, b in ((0, 1000), (500, 1500), (1400, 2000)):
        stored_index.add_to_index(some(a, b), path, ["id"], 300)
    some(5000, 6000).selectExpr("fp", "struct(id) as row", "0L as part").write.partitionBy("part").parquet(f"{path}/rows/gen=failed")  # an append that died before its listing
    assert stored_index.read_index(spark, path).count() == 2000
    stored_index.compact(spark, path, 300)
    assert stored_index.generations(spark, path).count() == 1
    assert sorted(r.id for r in stored_index.read_index(spark, path).collect()) == list(range(2000))
    assert spark.read.parquet(f"{path}/rows").count() == 2000  # what was replaced or never listed is gone
    assert stored_index.add_to_index(some(1990, 2010), path, ["id"]).count() == 10


def test_a_partition_is_written_by_as_many_tasks_as_its_rows_ask_for(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stored_index, "TASK_ROWS", 500, raising=False)
    new = spark.range(8000).select(F.concat(F.lit("a::"), "id").alias("fp"), F.col("id").alias("n"))
    added = stored_index.add_to_index(new, str(tmp_path / "chunks"), ["n"], 2048)
    assert sorted(r.n for r in added.collect()) == list(range(8000))
    (gen,) = stored_index.generations(spark, str(tmp_path / "chunks")).collect()
    of_file = added.groupBy(F.input_file_name().alias("file")).count().collect()
    assert gen.partitions == 4 and len(of_file) == 16 and max(r["count"] for r in of_file) < 600
    assert len({r.file.rsplit("/", 2)[1] for r in of_file}) == 4
    assert stored_index.add_to_index(new, str(tmp_path / "chunks"), ["n"], 2048).count() == 0
