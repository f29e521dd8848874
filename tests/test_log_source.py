"""The result log as a data source: the same rows as Spark's reader, what names answer, what doesn't fit, restarts."""

import json
import os
import time
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docjobs.sources import log_source
from docjobs.sources.results_log import log_record, read_results_log, write_results_log


def put(base, model, name, value, changed=None):
    path = base / model / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value, indent=2))
    if changed:
        os.utime(path, (changed, changed))
    return path


def record(n, model="m", **more):
    return {"metadata": {"filename": f"f{n}.png", "timestamp": "2025-03-01T10:00:00", "model": model, "duration_seconds": n / 4, "confidence_score": 95}, "extraction": {"doc_type": "Invoice", "invoice_details": {"number": f"N{n}"}, "financials": {"total_amount": n}} | more}


@pytest.fixture
def log(tmp_path):
    put(tmp_path, "m", "20250301_100000_a.json", record(1))
    put(tmp_path, "m", "20250302_100000_b.json", [record(2), record(3)])
    put(tmp_path, "other one", "20250303_100000_c.json", record(4, "other one"))
    put(tmp_path, "model=third", "part-0.json", "\n".join(json.dumps(record(n)) for n in (5, 6)) + "\n")
    put(tmp_path, "m", "_SUCCESS", "")
    put(tmp_path, "m", ".part-0.json.crc", "x")
    put(tmp_path, "m", "20250304_100000_empty.json", "")
    return tmp_path


def test_same_rows_as_spark_reads(spark, log):
    here = log_source.results_source(spark).load(str(log))
    cols = ["metadata", "extraction", "model_dir", "file_time"]
    lines = read_results_log(spark, str(log)).filter("model_dir <> 'third'").union(spark.read.schema(here.select("metadata", "extraction").schema).json(str(log / "model=third")).select("metadata", "extraction", F.lit("third"), F.lit(None).cast("timestamp")))
    assert sorted(map(str, here.select(cols).collect())) == sorted(map(str, lines.select(cols).collect()))
    assert here.filter("unfit is not null").count() == 0
    assert here.count() == 6


def test_names_answer_conditions(spark, log):
    (log / "m" / "20250301_100000_a.json").write_text("opened {")  # a file that no condition here asks for
    read = log_source.results_source(spark, push=True).load(str(log))
    opened = lambda df: sorted({r.file.split("/")[-1] for r in df.collect()})
    assert opened(read.filter("model_dir = 'm' and file_time > timestamp'2025-03-01 10:00:00'")) == ["20250302_100000_b.json"]
    assert opened(read.filter("file_time >= '2025-03-02' and metadata.duration_seconds > 0.6")) == ["20250302_100000_b.json", "20250303_100000_c.json"]
    assert opened(read.filter("model_dir in ('third', 'none')")) == ["part-0.json"]
    assert opened(read.filter("file_time is null")) == ["part-0.json"]
    given = lambda **o: opened(log_source.results_source(spark, **o).load(str(log)))
    assert given(models=["m"], since="2025-03-01T10:00:01") == given(since="2025-03-02", until="2025-03-03") == ["20250302_100000_b.json"]
    assert given(models=["third"]) == ["part-0.json"] and given(models=[]) == given(until="2025-03-01T10:00:00") == []
    reader = log_source.PushedLogReader(read.schema, {"path": str(log)})
    left = list(reader.pushFilters([log_source.D.EqualTo(("model_dir",), "third"), log_source.D.EqualTo(("unfit",), "x")]))
    assert [f.attribute for f in left] == [("unfit",)]
    assert [f.path.split("/")[-1] for p in reader.partitions() for f in p.files] == ["part-0.json"]


def test_what_does_not_fit_is_kept(spark, tmp_path):
    put(tmp_path, "m", "1.json", {"metadata": {"filename": 7, "model": "m", "duration_seconds": "12"}, "extraction": {"vendor_name": "old", "total_amount": "5,00", "line_items": [{"quantity": 1}, "x"], "financials": [1]}, "extra": None})
    put(tmp_path, "m", "2.json", "no JSON at all {")
    put(tmp_path, "m", "3.json", '{"metadata": {"model": "m"}}\nbroken\n[1]\n')
    rows = log_source.results_source(spark).load(str(tmp_path)).orderBy("file", F.col("unfit").asc_nulls_first()).collect()
    first = rows[0]
    assert first.metadata.filename == "7" and first.metadata.duration_seconds is None and first.extraction.line_items[0].quantity == 1.0 and first.extraction.line_items[1] is None
    assert json.loads(first.unfit) == {"metadata.duration_seconds": "12", "extraction.vendor_name": "old", "extraction.total_amount": "5,00", "extraction.line_items[1]": "x", "extraction.financials": [1], "extra": None}
    assert [json.loads(r.unfit)[""] if r.unfit else r.metadata.model for r in rows[1:]] == ["no JSON at all {", "m", "broken", [1]]


def test_tasks_are_bounded_by_bytes(spark, tmp_path):
    for n in range(20):
        put(tmp_path, "m", f"{n}.json", record(n))
    df = log_source.results_source(spark).option("taskBytes", 20_000).load(str(tmp_path))
    assert 3 < df.rdd.getNumPartitions() < 20 and df.count() == 20
    assert log_source.results_source(spark).load(str(tmp_path / "nothing")).count() == 0


def test_a_stream_reads_each_file_once_over_restarts(spark, tmp_path):
    base, began = tmp_path / "log", time.time() - 1000

    def run():
        stream = log_source.results_source(spark, stream=True).option("settleSeconds", 100).load(str(base))
        stream.select("metadata.filename", "model_dir").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        return sorted(r.filename for r in spark.read.parquet(str(tmp_path / "out")).collect())

    put(base, "m", "1.json", record(1), began)
    put(base, "n", "2.json", record(2), began)
    assert run() == ["f1.png", "f2.png"]
    assert run() == ["f1.png", "f2.png"]
    put(base, "m", "3.json", record(3), began + 1)
    put(base, "m", "4.json", record(4))  # too new to be taken
    assert run() == ["f1.png", "f2.png", "f3.png"]
    os.utime(base / "m" / "4.json", (began + 2, began + 2))
    assert run() == ["f1.png", "f2.png", "f3.png", "f4.png"]


def test_offsets_are_bounded_and_repeatable(spark, tmp_path):
    began = int(time.time()) - 1000
    for n in range(10):
        put(tmp_path, "m", f"{n}.json", record(n), began + n // 2)  # two of each time
    schema = log_source.results_source(spark).load(str(tmp_path)).schema
    reader, seen, at = log_source.LogStream(schema, {"path": str(tmp_path), "maxfiles": "3"}), [], None
    at = reader.initialOffset()
    while (end := reader.latestOffset()) != at:
        files = [f.path for p in reader.partitions(at, end) for f in p.files]
        again = log_source.LogStream(schema, {"path": str(tmp_path)})  # after a restart, the same batch has the same files
        assert files == [f.path for p in again.partitions(at, end) for f in p.files] and len(files) <= 4
        seen, at = seen + files, end
        reader.commit(end)
    assert len(seen) == len(set(seen)) == 10


def test_written_logs(spark, tmp_path):
    rows = spark.range(500).select(*log_record(F.concat(F.lit("f"), "id"), F.lit("2025-03-01").cast("timestamp"), F.concat(F.lit("m"), F.col("id") % 3), F.col("id") / 8, F.lit(90), F.struct(F.lit("Invoice").alias("doc_type"))))
    write_results_log(rows.union(spark.range(1).select(*log_record(F.lit("x"), F.lit(None).cast("timestamp"), F.lit("a/b c"), F.lit(1.0), F.lit(90), F.struct(F.lit("Invoice").alias("doc_type"))))), str(tmp_path / "log"))
    df = log_source.results_source(spark).load(str(tmp_path / "log"))
    assert df.filter("model_dir = 'm1'").agg(F.count("*"), F.sum("metadata.duration_seconds")).first()[:] == (167, sum(i / 8 for i in range(1, 500, 3)))
    assert [r.model_dir for r in df.filter("model_dir = 'a/b c'").collect()] == ["a/b c"]


def test_files_of_lines_are_read_line_by_line():
    """What a record a line takes in memory does not grow with the file."""
    data = b'{"metadata":{"filename":"f","model":"m"},"extraction":null}\n' * 100_000
    tracemalloc.start()
    n = sum(v["metadata"]["model"] == "m" for v in log_source._values(pa.BufferReader(data)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 100_000 and peak < 1 << 20
    values = lambda text: list(log_source._values(pa.BufferReader(text.encode())))
    assert values('\n{"a": 1}\n\n {"b": 2}\nno\n') == [{"a": 1}, {"b": 2}, "no"]
    assert values('\ufeff[\n{"a": 1}, 2]') == [{"a": 1}, 2] and values('{\n"a": 1}\n') == [{"a": 1}] and values('\n{"a": 1} x\n') == ['\n{"a": 1} x\n'] and values(" \n") == values("") == []
