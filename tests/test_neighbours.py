"""Exact nearest neighbours at any offset and scale, and the index of inverted lists, against brute force."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from docjobs.operators import retrieve, vector_index
from tests.oracle import DATA

SHAPE = "vec_id long, embedding array<double>, s string"


def brute(q, x, k):
    d = ((x - q) ** 2).cumsum(1)[:, -1]
    return np.lexsort((np.arange(len(x)), d))[:k].tolist()


@pytest.mark.parametrize("middle, spread", [(0.0, 1.0), (1e6, 1e-2), (-1e8, 1.0), (0.0, 1e-6), (1e-3, 1e-9)])
def test_neighbours_at_any_offset_and_scale(spark, middle, spread):
    rnd = np.random.RandomState(4)
    x = middle + spread * rnd.randn(200, 8)
    x[150:] = x[100:150]  # ties
    df = spark.createDataFrame([(i, v.tolist(), "s") for i, v in enumerate(x)], SHAPE).repartition(3)
    asked = df.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in retrieve.similarity_topk(asked, df, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: brute(x[q], x, 5) for q in range(0, 200, 20)}


def test_queries_far_from_all_rows():
    rnd = np.random.RandomState(1)
    x, q = 1e5 + rnd.randn(300, 16), np.concatenate([rnd.randn(5, 16), 1e9 + rnd.randn(5, 16)])
    got = {}
    for i, j, _ in retrieve.nearest_of(q, x, 7):
        for a, b in zip(i.tolist(), j.tolist()):
            got.setdefault(a, []).append(b)
    assert got == {i: brute(q[i], x, 7) for i in range(10)}


def test_sessions_and_unusable_vectors(spark):
    rnd = np.random.RandomState(2)
    x = rnd.randn(90, 4)
    rows = [(i, v.tolist(), [None, "a", "b"][i % 3]) for i, v in enumerate(x)] + [(90, None, "a"), (91, [float("nan")] * 4, "a"), (92, [float("inf")] * 4, "b"), (93, x[1].tolist(), "c")]
    df = spark.createDataFrame(rows, SHAPE).repartition(4)
    asked = df.filter("vec_id < 12 or vec_id > 89").withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in retrieve.similarity_topk(asked, df, 3, within="s").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = {q: [int(i) for i in np.arange(90)[np.arange(90) % 3 == q % 3][brute(x[q], x[np.arange(90) % 3 == q % 3], 3)]] for q in range(12)}
    assert got == want | {93: [93]}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rnd = np.random.RandomState(6)
    middles = rnd.randn(40, 16) * 2
    x = middles[rnd.randint(0, 40, 3000)] + rnd.randn(3000, 16)
    x[2000:] = x[5]  # a third alike
    df = spark.createDataFrame([(i, v.tolist(), "s") for i, v in enumerate(x)] + [(3000, None, "s"), (3001, [float("nan")] * 16, "s")], SHAPE)
    path = str(tmp_path_factory.mktemp("index"))
    vector_index.build(df, path)
    return x, df, path


def test_index_finds_most_and_reads_few(spark, index):
    x, df, path = index
    asked = df.filter("vec_id % 50 = 0 and vec_id < 2000").withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in vector_index.search(asked, path, 5).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = {q: set(brute(x[q], x, 5)) for q in range(0, 2000, 50)}
    assert sum(len(got[q] & want[q]) for q in want) >= 0.9 * 5 * len(want)
    lists = vector_index.read_lists(spark, path)
    assert lists.count() == 3000 and lists.select("list").distinct().count() == vector_index.LISTS
    some = vector_index.read_lists(spark, path, [3, 4])
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and {r[0] for r in some.select("list").distinct().collect()} == {3, 4}
    assert len({f for f in some.select(F.input_file_name()).distinct().collect()}) < len(lists.select(F.input_file_name()).distinct().collect())


def test_all_lists_are_the_exact_search(spark, index):
    x, df, path = index
    asked = df.filter("vec_id % 500 = 0").withColumnRenamed("vec_id", "query_id")
    rows = lambda out: sorted((r.query_id, r["rank"], r.vec_id, r.dist) for r in out.collect())
    assert rows(vector_index.search(asked, path, 4, probes=vector_index.LISTS)) == rows(retrieve.similarity_topk(asked, df, 4))


def test_a_list_of_a_third_of_the_rows_is_many_tasks_work(spark, index, tmp_path):
    _, df, _ = index
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        vector_index.build(df, str(tmp_path))
    finally:
        spark.conf.unset(key)
    rows = vector_index.read_lists(spark, str(tmp_path)).select("list", F.col("_metadata.file_path").alias("file"))
    largest = rows.groupBy("list").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files")).orderBy(F.desc("n")).first()
    assert largest.n >= 1000 and largest.files == 4  # as many as the session's shuffles have tasks


def test_an_index_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], SHAPE)
    vector_index.build(empty, str(tmp_path))
    asked = spark.createDataFrame([(1, [0.5], "s")], SHAPE).withColumnRenamed("vec_id", "query_id")
    assert vector_index.search(asked, str(tmp_path)).collect() == []


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
def test_recall_over_the_given_vectors(spark):
    from docjobs.jobs.queries import QUERIES

    big = DATA.replace("sf0.001", "sf0.1")
    path = big if os.path.isdir(big) else DATA
    hits = lambda name: {(r.query_id, r.vec_id) for r in QUERIES[name](spark, path).collect()}
    exact = hits("g6_similarity_topk")
    recall = len(hits("g6_vector_index") & exact) / len(exact)
    print("recall", recall)
    assert recall >= 0.9


def test_distances_of_a_block_are_held_in_two_arrays_at_most():
    import tracemalloc

    from docjobs.operators.retrieve import TILE, nearest_of

    rnd = np.random.default_rng(3)
    x, q = rnd.normal(size=(4096, 8)), rnd.normal(size=(TILE // 4096, 8))
    tracemalloc.start()
    try:
        (i, j, dist), = nearest_of(q, x, 3)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    whole = ((q[:50, None] - x) ** 2).sum(2)
    assert (j.reshape(-1, 3)[:50] == whole.argsort(1, kind="stable")[:, :3]).all() and len(dist) == 3 * len(q)
    assert peak < 3 * 8 * TILE
