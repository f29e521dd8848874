"""Graph, pages, chunks, retrieval, store, sources and streams on small tables."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from docjobs.operators import graph, pages, retrieve, store
from docjobs.sources import documents, results_log
from docjobs.streaming import jobs as streaming


def test_graph(spark):
    docs = spark.createDataFrame([(1, "PartyA agrees to pay PartyB."), (2, "PartyB receives payment from PartyA. Ouvré A"), (3, None)], "doc_id long, text string")
    nodes = graph.entity_nodes(spark.createDataFrame([(9, 1, 2), (8, 3, 3)], "pair_id long, doc1 long, doc2 long"), docs)
    assert {(r.entity, r.in_doc1, r.in_doc2) for r in nodes.collect()} == {("PartyA", True, True), ("PartyB", True, True)}
    assert graph.common_edges(nodes).count() == 2


@pytest.mark.parametrize("style", pages.STYLES)
def test_pages_round_trip(spark, style):
    df = spark.createDataFrame([(1, 2, "b\n"), (1, 1, "a"), (2, 10, "x\n\ny"), (2, 9, "w")], "doc_id long, page_no int, text string")
    back = pages.split_pages(pages.assemble_pages(df, style), style)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_blank_pages(spark):
    df = spark.createDataFrame([(1, 1, " \f"), (1, 2, "t"), (2, 1, None)], "doc_id long, page_no int, text string")
    assert {r.doc_id: r.text for r in pages.assemble_pages(df, "compare").collect()} == {1: "\n --- Page 2 --- \nt", 2: ""}


def test_combine_and_compare(spark):
    files = spark.createDataFrame([("s", "b.PDF", "2"), ("s", "a.pdf", "1"), ("s", "c.txt", "3")], "session_id string, name string, text string")
    assert pages.combine_documents(files).first().text == "Document: a.pdf\n1\n\nDocument: b.PDF\n2"
    shape = "pair_id long, page_no int, text string"
    out = pages.compare_pages(spark.createDataFrame([(1, 1, "a"), (1, 2, "x\ny"), (1, 3, "gone")], shape), spark.createDataFrame([(1, 1, "a"), (1, 2, "y\nz"), (1, 4, "new")], shape))
    assert {r.page_no: (r.status, r.added, r.removed) for r in out.collect()} == {1: ("NO CHANGE", [], []), 2: ("CHANGED", ["z"], ["x"]), 3: ("REMOVED", [], ["gone"]), 4: ("ADDED", ["new"], [])}


def test_chunks_cover_the_text(spark):
    texts = ["", None, "a" * 5, "b" * 1000, "".join(chr(97 + i % 26) for i in range(1001)), "".join(chr(97 + i % 26) for i in range(5000))]
    rows = retrieve.chunk_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for i, t in enumerate(texts):
        own = sorted((r.chunk_no, r.text) for r in rows if r.doc_id == i)
        assert bool(own) == bool(t)
        if t:
            assert own[0][1] + "".join(x[200:] for _, x in own[1:]) == t and len(own) == max(1, -(-(len(t) - 200) // 800))


def test_fingerprints_and_index(spark):
    df = spark.createDataFrame([("s", None, "1", "t"), (None, "p", None, "t"), (None, None, None, "t"), ("", None, None, "t")], "source string, file_path string, row_id string, text string")
    fps = [r[0] for r in df.select(retrieve.fingerprint(*(F.col(c) for c in df.columns))).collect()]
    assert fps[:2] == ["s::1", "p::"] and fps[2] == fps[3] and len(fps[2]) == 64
    shape = "fp string, n long"
    new, index = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3), ("c", 4)], shape), spark.createDataFrame([("b", 0)], shape)
    added = retrieve.add_documents(new, index, ["n"])
    assert sorted(map(tuple, added.collect())) == [("a", 1), ("c", 4)]
    assert retrieve.add_documents(new, index.unionByName(added), ["n"]).count() == 0


def test_topk_against_brute_force(spark):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(300, 8)).round(1).astype(np.float32)
    x[5] = x[7] = x[9]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(5)
    asked = df.filter("vec_id < 20").select(F.col("vec_id").alias("query_id"), "embedding")
    got = {(r.query_id, r["rank"]): r.vec_id for r in retrieve.similarity_topk(asked, df, 4).collect()}
    for q in range(20):
        d = ((x[q].astype(float) - x.astype(float)) ** 2).sum(1).round(9)
        assert [got[q, k] for k in range(1, 5)] == sorted(range(300), key=lambda i: (d[i], i))[:4]


def searched(spark, rows, kinds="vec_id long, embedding array<float>, session string"):
    df = spark.createDataFrame(rows, kinds)
    return df.filter("vec_id < 20").withColumnRenamed("vec_id", "query_id"), df


def test_topk_in_blocks_and_chunks(spark, monkeypatch):
    """Many blocks of queries, chunks of the index and equal vectors; sessions apart."""
    for name, size in (("QUERY_BLOCK", 3), ("INDEX_CHUNK", 40), ("TILE", 64)):
        monkeypatch.setattr(retrieve, name, size)
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(200, 4)).round(1).astype(np.float32)
    x[60:130] = x[3]
    session = [["a", "b", None][i % 3] for i in range(200)]
    rows = [(i, v.tolist(), s) for i, (v, s) in enumerate(zip(x, session))] + [(900, None, "a")]
    asked, df = searched(spark, rows)
    for within in (None, "session"):
        got = {(r.query_id, r["rank"]): r.vec_id for r in retrieve.similarity_topk(asked, df.repartition(3), 4, within).collect()}
        for q in range(20):
            d = ((x[q].astype(float) - x.astype(float)) ** 2).sum(1).round(9)
            near = sorted((i for i in range(200) if within is None or session[i] == session[q]), key=lambda i: (d[i], i))[:4]
            assert [got[q, k] for k in range(1, 5)] == near
    assert retrieve.similarity_topk(asked.filter("false"), df, 3).count() == 0 and retrieve.similarity_topk(asked, df.filter("false"), 3).count() == 0


def test_kinds_of_search(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(120, 6)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[30:40] = x[0] + 0.001 * rnd.normal(size=(10, 6))
    asked, df = searched(spark, [(i, v.tolist(), None) for i, v in enumerate(x)])
    d = ((x[:20, None].astype(float) - x[None].astype(float)) ** 2).sum(-1)
    got = retrieve.retrieve(asked, df, "similarity_score_threshold", k=5, score_threshold=0.7).collect()
    near = {q: sorted(range(120), key=lambda i: (d[q, i], i)) for q in range(20)}
    assert {(r.query_id, r.vec_id) for r in got} == {(q, i) for q in range(20) for i in near[q][:5] if 1 - d[q, i] / 2**0.5 >= 0.7}
    got = {(r.query_id, r["rank"]): r.vec_id for r in retrieve.retrieve(asked, df, "mmr", k=4, fetch_k=15, lambda_mult=0.5).collect()}
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    for q in range(20):
        left, chosen = near[q][:15], []
        while len(chosen) < 4:
            gain = {i: 0.5 * (y[q] @ y[i]) - 0.5 * max((y[i] @ y[j] for j in chosen), default=0) for i in left if i not in chosen}
            chosen.append(max(gain, key=gain.get))
        assert [got[q, k] for k in range(1, 5)] == chosen
    with pytest.raises(ValueError):
        retrieve.retrieve(asked, df, "other")


def test_context_and_history(spark):
    hits = spark.createDataFrame([(1, 5, 2), (1, 6, 1)], "query_id long, vec_id long, rank int")
    assert retrieve.assemble_context(hits, spark.createDataFrame([(5, "b"), (6, "a")], "vec_id long, text string")).first().context == "a\n\nb"
    conv = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r")], "conv_id long, turn long, role string, text string")
    rows = {r.turn: [tuple(m) for m in r.history] for r in retrieve.chat_history(conv).collect()}
    assert rows == {0: [], 2: [("user", "q"), ("assistant", "a")]}
    assert {r.turn: len(r.history) for r in retrieve.chat_history(conv, 1).collect()} == {0: 0, 2: 1}


def test_cache(spark):
    cache = spark.createDataFrame([("u", 1, 1, "old"), ("v", 1, 1, "")], "user_id string, ts long, id long, record string")
    new = spark.createDataFrame([("u", 2, 2, "new", 90), ("u", 3, 3, "weak", 50), (None, 4, 4, "x", 99)], "user_id string, ts long, id long, record string, confidence int")
    after = store.cache_upsert(cache, new)
    assert {r.user_id: r.record for r in after.collect()} == {"u": "new", "v": ""}
    hits, rest = store.cache_lookup(spark.createDataFrame([(1, "u"), (2, "v"), (3, None)], "request_id long, user_id string"), after)
    assert [r.request_id for r in hits.collect()] == [1] and sorted(r.request_id for r in rest.collect()) == [2, 3]


def test_retention_and_metrics(spark):
    sessions = spark.createDataFrame([("b", f"s_2025010{i}_000000_ab") for i in range(1, 6)], "base string, session string")
    assert sorted(r.session[9] for r in store.retain_latest(sessions).filter("not kept").collect()) == ["1", "2"]
    words = spark.createDataFrame([(1, 1, "96"), (1, 1, "-1"), (1, 1, "95.5"), (1, 1, "4")], "doc_id long, page_no int, conf string")
    texts = spark.createDataFrame([(1, 1, "ab"), (1, 2, " \n"), (1, 3, "c")], "doc_id long, page_no int, text string")
    assert sorted(map(tuple, store.ocr_page_stats(words, texts).collect())) == [(1, 1, 2, 50.0), (1, 3, 1, None)]


def test_log_files(spark, tmp_path):
    folder = tmp_path / "log" / "some-model"
    folder.mkdir(parents=True)
    record = {"metadata": {"filename": "a.png", "timestamp": "2025-01-02T03:04:05.000006", "model": "some-model", "duration_seconds": 1.5, "confidence_score": 95}, "extraction": {"doc_type": "x", "line_items": [{"quantity": 2}]}}
    (folder / "20250102_030405_a.json").write_text(json.dumps(record, indent=2))
    r = results_log.read_results_log(spark, str(tmp_path / "log")).first()
    assert r.model_dir == "some-model" and str(r.file_time) == "2025-01-02 03:04:05" and r.extraction.line_items[0].quantity == 2.0
    results_log.write_results_log(spark.read.schema(results_log.LOG_RECORD).option("multiLine", True).option("recursiveFileLookup", True).json(str(tmp_path / "log")), str(tmp_path / "out"))
    assert spark.read.schema(results_log.LOG_RECORD).json(str(tmp_path / "out")).first().metadata.filename == "a.png"


def test_answers(spark):
    df = spark.createDataFrame([('```json\n{"doc_type": "a"}\n```',), ("sorry",), (None,)], "content string")
    assert [(r.confidence, r.data.doc_type if r.data else None, r.error is None) for r in results_log.parse_model_json(df).collect()] == [(95, "a", True), (0, None, False), (0, None, False)]
    flat = spark.createDataFrame([(("V", "12.5", "1/2/25", "7", "inv"),)], "data struct<vendor_name:string,total_amount:string,invoice_date:string,invoice_number:string,doc_type:string>")
    c = results_log.conform_results(flat).first().conformed
    assert (c.vendor.name, c.financials.total_amount, c.invoice_details.number, c.doc_type) == ("V", 12.5, "7", "inv")
    meta = documents.conform_metadata(spark.createDataFrame([('{"PageCount": "Not Available"}',), ('{"PageCount": 3, "Author": ["x"]}',)], "answer string")).collect()
    assert [m.page_count for m in meta] == [None, 3]


def test_routes(spark):
    df = documents.route_by_suffix(spark.createDataFrame([("a/b.JPG",), ("a/.hidden",), ("x.pdf",), ("y.txt",)], "path string"))
    assert [(r.route, r.chat_loads) for r in df.collect()] == [("image", False), ("unsupported", False), ("pdf", True), ("unsupported", True)]


def test_late_rows_are_dropped(spark, tmp_path):
    shape = "timestamp timestamp, model string, duration_seconds double, confidence_score double"
    for n, hours in enumerate((["2025-01-01 00:10", "2025-01-01 05:00"], ["2025-01-01 09:00"], ["2025-01-01 00:20"], ["2025-01-01 12:00"])):
        spark.createDataFrame([(h, "m", 1.0, 9.0) for h in hours], "timestamp string, model string, duration_seconds double, confidence_score double").selectExpr("cast(timestamp as timestamp) as timestamp", "model", "duration_seconds", "confidence_score").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = streaming.stream_results_metrics(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {str(r.window_start): r.n for r in rows}["2025-01-01 00:00:00"] == 1


def test_cache_kept_by_batches(spark, tmp_path):
    """An initial cache, batches that touch some buckets, a batch that is repeated, and nothing left beside the cache."""
    base = f"file://{tmp_path}"
    shape = "user_id bigint, ts timestamp, id bigint, record string, confidence int"
    day = lambda n: f"2025-01-{n:02}"
    rows = lambda *x: spark.createDataFrame([(u, d, i, r, c) for u, d, i, r, c in x], "user_id bigint, ts string, id bigint, record string, confidence int").withColumn("ts", F.col("ts").cast("timestamp"))
    initial = rows(*((u, day(1), u, f"first {u}", 99) for u in range(10)))
    a, b = rows((1, day(2), 11, "a", 90), (2, day(2), 12, "weak", 50), (None, day(2), 13, "x", 99)), rows((1, day(1), 5, "late", 90), (70, day(3), 14, "new", 90))
    streaming.upsert_batch(a, 0, base, initial, 4)
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    streaming.upsert_batch(b, 1, base, initial, 4)
    want = {**{u: f"first {u}" for u in range(10)}, 1: "a", 70: "new"}
    assert {r.user_id: r.record for r in streaming.read_cache(spark, base).collect()} == want
    assert any(p.exists() for p in before) and not list(tmp_path.glob("stage-*"))
    streaming.upsert_batch(b, 1, base, initial, 4)
    assert {r.user_id: r.record for r in streaming.read_cache(spark, base).collect()} == want
    spark.createDataFrame([], shape).write.parquet(f"{base}/stage-2")  # what a failed run has staged is what counts
    streaming.upsert_batch(rows((3, day(9), 99, "unseen", 99)), 2, base, initial, 4)
    assert {r.user_id: r.record for r in streaming.read_cache(spark, base).collect()} == want
