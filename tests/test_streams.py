"""Streams with state: late rows, sketches and their roll-up, batches that close and reopen, requests that take cached records."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docjobs.jobs import render as R
from docjobs.operators.merge import merge_results
from docjobs.streaming import batches, cache, jobs
from tests.oracle import DATA

START = datetime(2025, 3, 1)
LOG = "timestamp timestamp, model string, duration_seconds double, confidence_score double"


class Feed:
    """A folder that a stream reads one file at a time; each call adds a file and runs a new query from the checkpoint."""

    def __init__(self, spark, base, shape):
        self.spark, self.base, self.shape = spark, str(base), shape

    def add(self, rows):
        self.spark.createDataFrame(rows, self.shape).coalesce(1).write.mode("append").parquet(f"{self.base}/in")

    def stream(self):
        return self.spark.readStream.schema(self.shape).option("maxFilesPerTrigger", 1).parquet(f"{self.base}/in")

    def run(self, df):
        df.writeStream.format("parquet").option("checkpointLocation", f"{self.base}/state").trigger(availableNow=True).start(f"{self.base}/out").awaitTermination()
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/out")


def test_late_rows_are_dropped_and_sketches_are_close(spark, tmp_path):
    rnd, feed = random.Random(1), Feed(spark, tmp_path, LOG)
    hour = [(START + timedelta(seconds=i), "m", rnd.lognormvariate(0, 2), float(i % 2)) for i in range(3000)]
    feed.add(hour)
    feed.add([(START + timedelta(hours=3), "m", None, None)])
    feed.run(jobs.stream_results_metrics(feed.stream()))
    feed.add([(START + timedelta(minutes=1), "m", 1e9, 1.0)])  # its window has closed
    feed.add([(START + timedelta(hours=9), "m", 1.0, 1.0)])
    out = feed.run(jobs.stream_results_metrics(feed.stream())).orderBy("window_start").collect()
    assert [(r.window_start, r.n) for r in out] == [(START, 3000), (START + timedelta(hours=3), 1)]
    values = sorted(v for _, _, v, _ in hour)
    rank = lambda x: sum(v <= x for v in values) / len(values)
    assert abs(rank(out[0].median_s) - 0.5) < 0.01 and abs(rank(out[0].p95_s) - 0.95) < 0.01 and out[0].success_rate == 0.5
    assert out[1].median_s is None and out[1].p95_s is None and out[1].avg_s is None and out[1].success_rate == 0


def test_rollup_merges_windows(spark, tmp_path):
    rnd, feed = random.Random(2), Feed(spark, tmp_path, LOG)
    rows = [(START + timedelta(minutes=rnd.randrange(60 * 48)), rnd.choice(["a", "b", None]), rnd.choice([None, rnd.random()]), rnd.choice([0.0, 50.0, None])) for _ in range(6000)]
    feed.add(rows)
    feed.add([(START + timedelta(days=9), "a", 1.0, 1.0)])
    out = jobs.rollup_metrics(feed.run(jobs.stream_results_metrics(feed.stream()))).collect()
    got = {(r.model, r.day, r.hour): r for r in out}
    assert len(got) == len(out) == 3 * (48 + 2 + 1)
    for (model, day, hour), r in got.items():
        own = [x for x in rows if x[1] == model and (day is None or x[0].date() == day) and (hour is None or x[0].hour == hour)]
        known = sorted(x[2] for x in own if x[2] is not None)
        assert r.n == len(own) and abs(r.success_rate - sum(bool(x[3]) for x in own) / len(own)) < 1e-12 and abs(r.avg_s - sum(known) / len(known)) < 1e-9 and r.max_s == known[-1]
        for p, q in ((0.5, r.median_s), (0.95, r.p95_s)):
            assert sum(v < q for v in known) / len(known) <= p + 0.01 and sum(v <= q for v in known) / len(known) >= p - 0.01


def test_requests_take_the_record_of_their_time(spark, tmp_path):
    at = lambda m: START + timedelta(minutes=m)
    known = [(1, at(0), "old"), (1, at(10), "new"), (1, at(10), "mew"), (1, at(30), "later"), (2, at(0), ""), (None, at(0), "nobody"), (3, at(-3000), "stale")]
    asked = [(1, 1, at(5)), (2, 1, at(10)), (3, 1, at(29)), (4, 2, at(5)), (5, None, at(5)), (6, 3, at(5)), (7, 9, at(5)), (8, 1, at(-1))]
    paths = {}
    for name, rows, shape, clock in (("asked", asked, "request_id long, user_id long, ts timestamp", (-1, -1, at(9000))), ("known", known, "user_id long, ts timestamp, record string", (-2, at(9000), "-"))):
        paths[name] = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1)
        spark.createDataFrame(rows, shape).coalesce(1).write.parquet(f"{tmp_path}/{name}")
        spark.createDataFrame([clock], shape).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    out = jobs.stream_cache_lookup(paths["asked"].parquet(f"{tmp_path}/asked"), paths["known"].parquet(f"{tmp_path}/known"))
    out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    got = sorted((r.request_id, r.record, r.source) for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/out").filter("request_id > 0").collect())
    assert got == [(1, "old", "cache"), (2, "new", "cache"), (3, "new", "cache")] + [(i, None, "ocr") for i in range(4, 9)]


@pytest.mark.skipif(not __import__("os").path.isdir(DATA), reason="no test data here")
def test_batches_close_reopen_and_restart(spark, tmp_path):
    pages = R.page_results(spark, DATA).filter("batch_id < 12").withColumn("arrived_at", F.lit(START).cast("timestamp") + F.expr("make_interval(0, 0, 0, 0, 0, 0, pos)"))
    base, shape = str(tmp_path), pages.schema

    def add(df, minutes):
        df.withColumn("arrived_at", F.col("arrived_at") + F.expr(f"interval {minutes} minutes")).coalesce(1).write.mode("append").parquet(f"{base}/in")

    def clock(minutes):
        add(pages.limit(1).withColumn("batch_id", F.lit(None).cast("long")), minutes)

    def run():
        stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        batches.stream_merge(stream, f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
        return batches.read_merged(spark, f"{base}/out")

    plain = lambda df: sorted(str(r) for r in df.select("batch_id", "kind", "out_pos", "filename", "merged_page_count", "original_filenames", F.to_json("data")).collect())
    some, rest = pages.filter("pos % 3 <> 1"), pages.filter("pos % 3 = 1")
    add(some, 0)
    clock(60)
    first = run()
    assert plain(first) == plain(merge_results(some.drop("arrived_at"))) and {r.revision for r in first.select("revision").distinct().collect()} == {1}
    add(rest.filter("batch_id < 6"), 90)  # reopens these, after a restart from the checkpoint
    add(some.filter("batch_id = 2"), 91)  # pages that come again
    clock(200)
    second = run()
    want = merge_results(some.unionByName(rest.filter("batch_id < 6")).drop("arrived_at"))
    assert plain(second) == plain(want)
    assert {(r.batch_id < 6, r.revision) for r in second.select("batch_id", "revision").collect()} == {(True, 2), (False, 1)}


def test_a_batch_writes_its_own_rows_to_a_large_cache(spark, tmp_path):
    base = str(tmp_path / "cache")
    records = lambda lo, hi, day, text: spark.range(lo, hi).selectExpr("id AS user_id", f"timestamp'2025-01-{day:02d}' AS ts", "id", f"concat('{text}', id) AS record", "60 AS confidence")
    size = lambda names: sum(p.stat().st_size for n in names for p in (tmp_path / "cache").glob(f"{n}/*.parquet"))
    cache.append_batch(records(0, 10, 2, "a"), 0, base, records(0, 50_000, 1, "first "), every=3)
    cache.append_batch(records(5, 1005, 3, "b"), 1, base, every=3)
    assert size(["delta-*"]) < size(["version-*"]) / 10
    weak = records(0, 3, 9, "weak").withColumn("confidence", F.lit(50)).unionByName(records(0, 3, 1, "late"))

    def want():
        return {**{u: f"first {u}" for u in range(1005, 50_000)}, **{u: f"a{u}" for u in range(5)}, **{u: f"b{u}" for u in range(5, 1005)}}

    assert {r.user_id: r.record for r in cache.read_cache(spark, base).collect()} == want()
    cache.append_batch(records(5, 1005, 3, "b"), 1, base, every=3)  # repeated
    cache.append_batch(weak, 2, base, every=3)  # compacts
    assert sorted(p.name for p in (tmp_path / "cache").iterdir()) == ["version-000000000003"]
    cache.append_batch(weak, 2, base, every=3)  # repeated after that
    (tmp_path / "cache" / "version-000000000009").mkdir()  # a compaction that failed
    assert {r.user_id: r.record for r in cache.read_cache(spark, base).collect()} == want()


def test_state_of_batches_has_their_times_alone(spark, tmp_path):
    """No Python runs for a batch, and a pause of keep makes a batch begin anew, as a later revision."""
    shape = "batch_id long, pos int, arrived_at timestamp, text string"
    spark.createDataFrame([], shape).write.parquet(f"{tmp_path}/in")
    stream = batches.pages_and_closings(spark.readStream.schema(shape).parquet(f"{tmp_path}/in"))
    run = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
    run.awaitTermination()
    assert "Pandas" not in stream._jdf.queryExecution().analyzed().toString() and {"page", "start", "end", "n"} < set(stream.columns)
    at = lambda d: START + timedelta(days=d)
    rows = [(1, at(0), at(0), 2, 0), (1, at(20), at(21), 1, 3), (1, at(90), at(91), 1, 5), (2, at(1), at(1), 1, 3)]
    chains = batches._chains(spark.createDataFrame(rows, "batch_id long, start timestamp, end timestamp, n long, epoch long"), "30 days")
    assert sorted((r.batch_id, r.epoch, r.since, r.revision) for r in chains.collect()) == [(1, 0, at(0), 1), (1, 3, at(0), 2), (1, 5, at(90), 3), (2, 3, at(1), 1)]
