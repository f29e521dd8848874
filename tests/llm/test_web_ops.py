"""Packing, archives, page extraction, URL filters and the pipeline against brute force."""

import hashlib
import itertools
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from docjobs.llm import html_extract, packing, url_filter, warc
from docjobs.llm.common import shared_dir


def padding(lengths, widths):
    return sum(min(w for w in widths if w >= n) - n for n in lengths)


def test_boundaries_are_optimal():
    rnd = random.Random(6)
    for _ in range(60):
        lengths = [rnd.choice([1, 2, 3, 5, 8, 13, 40, 41, 90]) for _ in range(rnd.randint(1, 40))]
        distinct = sorted(set(lengths))
        bins = np.array([(n, lengths.count(n), n * lengths.count(n)) for n in distinct])
        k = rnd.randint(1, 4)
        best = min(padding(lengths, [*c, distinct[-1]]) for j in range(k) for c in itertools.combinations(distinct[:-1], min(j, len(distinct) - 1)))
        widths = packing.boundaries(bins, k)
        assert len(widths) <= k and padding(lengths, widths) == best
    assert packing.boundaries(np.empty((0, 3), np.int64)) == []


def test_pack(spark):
    rnd = random.Random(7)
    texts = [" ".join(["w"] * rnd.choice([1, 3, 10, 50, 51, 52, 300])) for _ in range(400)] + ["", None, "\n\t", "w " * 20_000, "w " * 9001]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1), (None, "w w", 1)], "doc_id long, text string, width int").repartition(4)
    rows = packing.pack(df, buckets=4, budget=200).collect()
    assert len(rows) == len(texts) + 2
    lengths = [max(1, len((t or "").split())) for t in texts]
    batches = {}
    for r in rows:
        assert r.n_words <= r.width and (r.doc_id is None or r.n_words == lengths[r.doc_id])
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for (bucket, batch), own in batches.items():
        holds = max(1, 200 // own[0].width)
        assert sorted(r.slot for r in own) == list(range(len(own))) and len(own) <= holds
        if (bucket, batch + 1) in batches:
            assert len(own) == holds
    assert packing.pack(df.filter("false")).count() == 0


def test_boundaries_of_long_texts_are_optimal(spark):
    rnd = random.Random(12)
    lengths = [rnd.choice([8200, 8203, 9000, 9001, 12_000, 12_001, 16_400, 30_000, 30_007]) for _ in range(60)]
    df = spark.createDataFrame([(i, "w " * n) for i, n in enumerate(lengths)], "doc_id long, text string").repartition(3)
    distinct = sorted(set(lengths))
    for k in (1, 2, 3, 4):
        widths = sorted({r.width for r in packing.pack(df, buckets=k, budget=50_000).collect()})
        assert padding(lengths, widths) == min(padding(lengths, [*c, distinct[-1]]) for c in itertools.combinations(distinct[:-1], k - 1))
    by_tokens = packing.pack(df.withColumn("tokens", F.length("text") + 5), buckets=2, budget=90_000, length=F.col("tokens")).collect()
    assert {(r.doc_id, r.n_words) for r in by_tokens} == {(i, 2 * n + 5) for i, n in enumerate(lengths)}


def pages_table(spark):
    big, rnd = "<p>" + "long text " * 30, random.Random(9)
    rows = [(i, f"http://h{i % 3}.example/{i}", rnd.choice([big, big + "é", f"<b>{i}</b>" * 20, "short", "", None])) for i in range(60)]
    return rows + [(100, None, big), (101, "http://x y\r\n.example/", big), (5, rows[5][1], rows[5][2]), (None, "http://n.example/", big), (102, "http://z.example", "z" * 3_000_000)]


def test_archives(spark):
    rows = pages_table(spark)
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(5)
    folder = shared_dir(spark, "test-warc")
    names = warc.write_archives(df, folder)
    records = warc.read_records(spark, folder, names, with_payload=True)
    captures = warc.assemble(records)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.resolve(captures).collect()]
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h] = min(i, first.get(h, i))
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= 100 and first.get(h, i) != i
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    assert sorted(got, key=str) == sorted(want, key=str)
    full = {r.metadata.fields.get("page-id"): r for r in captures.filter("response.type = 'response'").collect()}
    assert bytes(full["102"].response.payload) == b"z" * 3_000_000 and full["102"].request.uri == "http://z.example"
    assert warc.write_archives(df.filter("false"), shared_dir(spark, "test-warc")) == []


PAGES = [
    ("<html><head><title>no</title></head><body><nav><a>Menu</a></nav><article><header><h1>Head &amp; tail</h1></header><p>One <b>bold<br>two<p>Three&nbsp;four <!-- c --> five</article><footer>f</footer>", "Head & tail\nOne bold two\nThree four five"),
    ("<body><div class='sidebar left'>s</div><div id=content><p>a<p>b<ul><li>c<li>d</ul></div><div class=\"Comment-list\"><p>no</div></body>", "a\nb\nc\nd"),
    ("<body><script>if (a<b) '</p>'</script><style>p{}</style><form>f <input> g</form>text<div>x</div>y<p hidden>h</p></body>", "text\nx\ny"),
    ("<article><p>keep</p><section class='comments'><article><p>reader</p></article></section><aside>no</aside><div role=navigation>n</div><table><tr><td>1<td>2</table></article><p>outside", "keep\n1\n2"),
    ("plain &lt;b&gt; 3 < 4 text", "plain <b> 3 < 4 text"),
    ("<article><p>a</p></p></div>b<p>unclosed <i>x", "a\nb\nunclosed x"),
    ("<main><p>m</p><div class='cookie-notice'>c</div></main><article class=promo>p</article>", "m"),
    ("<!-- open comment <p>x", ""),
    ("<ARTICLE><P>Upper</P><HR>next<pre>a\n  b</pre></ARTICLE>", "Upper\nnext\na b"),
    ("<article><button>Share</button><p>t &copy; &#233; &#x41;</p></article>", "t © é A"),
    ("<article><p></p><p> </p></article>", ""),
    ("<article><h1 class='post-header'>Title</h1><p>Body <span class=legal>text</span>.</p></article>", "Title\nBody text."),
    ("<article><p>a</p><div class=legal>b</div><section class='feedback-loops'><h2>c</h2><p>d</p></section><div id=related-work>e</div></article>", "a\nb\nc\nd\ne"),
    ("<article><p>a</p><div class=ad>b</div><div class='share-buttons ad-slot'>c</div><div class=post-comments>d</div><ul class='nav menu'><li>e</ul><div class=legal><p class=newsletter-signup>f</div></article>", "a"),
    (None, ""), ("", ""),
]


@pytest.mark.parametrize("html, text", PAGES)
def test_main_text(html, text):
    assert html_extract.main_text(html, set()) == text


def test_long_and_broken_pages_end_soon():
    for html in ("<" * 50_000, "<p>" * 20_000 + "x", "<div " + "a=\"'" * 20_000, "<a " * 20_000, "&" * 100_000, "<!--" * 30_000):
        html_extract.main_text(html, set())
    assert html_extract.main_text("<article>" + "<p>word</p>" * 30_000 + "</article>", set()).count("word") == 30_000


def test_style_tree(spark):
    body = "<body><div class='box9'>Follow us everywhere</div><div class='story'><p>{}</p></div></body>"
    rows = [(i, f"http://site.example/{i}", body.format(f"story number {i}")) for i in range(20)]
    rows += [(100 + i, "http://copies.example/a", body.format("one story in many copies")) for i in range(30)]
    rows += [(200, None, body.format("alone")), (201, "http://site.example/x", None), (1, "http://site.example/1", body.format("story number 1"))]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int").repartition(4)
    out = [(r.page_id, r.text) for r in html_extract.extract(df).collect()]
    want = [(i, "" if h is None else ("" if u and "site" in u else "Follow us everywhere\n") + h.split("<p>")[1].split("</p>")[0]) for i, u, h in rows]
    assert sorted(out) == sorted(want)
    assert html_extract.extract(df.filter("false")).count() == 0


def test_repeated_box_inside_articles(spark):
    body = "<body><{0}><h1>Head {1}</h1><div class='box9'><p>Follow us everywhere</p></div><div class='story'><p>story number {1}</p></div></{2}></body>"
    kinds = [("article", "article"), ("div role=main", "div"), ("main><section class=x", "section></main")]
    rows = [(100 * k + i, f"http://s{k}.example/{i}", body.format(a, i, b)) for k, (a, b) in enumerate(kinds) for i in range(12)]
    rows += [(900 + i, "http://same.example/", f"<div role=main><p>one text</p></div><p>{i}</p>") for i in range(12)]
    out = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {i: "one text" if i >= 900 else f"Head {i % 100}\nstory number {i % 100}" for i, _, _ in rows}


def test_hints_inside_articles(spark):
    body = "<article><h1 class='post-header'>Head {0}</h1><p>Story {0}</p><div class='legal'><p>All rights reserved</p></div><section class='feedback-loops'><p>Loop {0}</p></section></article>"
    rows = [(i, f"http://many.example/{i}", body.format(i)) for i in range(12)] + [(99, "http://one.example/", body.format(99))]
    out = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    kept = "Head {0}\nStory {0}\n{1}Loop {0}"
    assert out == {i: kept.format(i, "All rights reserved\n" if i == 99 else "") for i, _, _ in rows}


def test_url_filter(spark):
    rnd = random.Random(3)
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    patterns = [("domain", "example.com"), ("domain", "a.example.com"), ("domain", "com"), ("prefix", "a.example.com/x"), ("prefix", "a.example.com/x/y"), ("prefix", "b.org/")]
    entries = [("l%d" % rnd.randint(0, 2), False, k, p, rnd.choice(["add", "remove"]), day(rnd.randint(0, 30))) for k, p in patterns * 12]
    entries = [(n, n == "l2", k, p, a, d) for n, _, k, p, a, d in entries] + [("l0", False, "domain", None, "add", day(0)), ("l0", False, "domain", "com", "add", None)]
    urls = ["http://A.example.com/x/y/z?q#f", "https://u:p@a.example.com:80/x", "http://b.org", "http://b.org./k", "ftp://c.net/a", "not a url", None, "http://example.com/x"]
    caps = [(i, rnd.choice(urls), day(rnd.randint(0, 31))) for i in range(150)] + [(200, urls[0], None), (5, urls[0], day(3)), (5, urls[0], day(3))]
    df = spark.createDataFrame([(*c, "x") for c in caps], "id long, url string, fetched_at timestamp, host string")
    listed = spark.createDataFrame(entries, "list string, allow boolean, kind string, pattern string, action string, dated timestamp")
    out = url_filter.filter_urls(df, listed)
    state = {}
    for n, allow, k, p, a, d in entries:
        if p and d:
            state.setdefault((n, allow, k, p), {}).setdefault(d, []).append(a)

    def active(t):
        for key, days in state.items():
            past = [d for d in days if t is not None and d <= t]
            if past and "remove" not in days[max(past)]:
                yield key

    want = []
    for i, u, t in caps:
        m = __import__("re").match(r"[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/:?#]+)[^/?#]*([^?#]*)", u or "")
        host, path = (m[1].lower().rstrip("."), [x for x in m[2].split("/") if x]) if m else ("", [])
        asks = {("domain", ".".join(host.split(".")[j:])) for j in range(len(host.split(".")))} | {("prefix", host + "/" + "/".join(path[:j])) for j in range(len(path) + 1)}
        hits = [(len(p), k == "prefix", allow, n, p) for n, allow, k, p in active(t) if host and (k, p) in asks]
        best = max(hits, default=None)
        want.append((i, host if u is not None else None, len(hits), best and best[4], best and best[3], bool(best and not best[2])))
    got = [(r.id, r.host, r.n_active, r.decided_by, r.decided_list, r.blocked) for r in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    parts = url_filter.filter_urls(df, listed, changes=4).collect()  # histories in several rows
    assert sorted(parts, key=str) == sorted(out.collect(), key=str)
    assert out.columns == ["id", "url", "fetched_at", "host", "n_active", "decided_by", "decided_list", "blocked"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    assert url_filter.filter_urls(df.filter("false"), url_filter.sample_entries(df)).count() == 0


def test_long_histories_and_long_paths(spark):
    """Rows in proportion to captures, whatever the number of intervals; folders at the depths of the entries alone."""
    day = datetime(2024, 1, 1)
    entries = spark.range(3000).selectExpr("'l' as list", "false as allow", "'domain' as kind", "'h.example' as pattern", "case id % 2 when 0 then 'add' else 'remove' end as action", "timestamp_micros(id * 1000000) as dated")
    deep = spark.createDataFrame([("p", True, "prefix", "h.example/" + "a/" * 2 + "a", "add", day), ("p", True, "prefix", "h.example/", "add", day)], entries.schema)
    caps = spark.range(5000).selectExpr("id", "concat('http://h.example/', id) as url", "timestamp_micros(id % 3100 * 1000000 + 500000) as fetched_at", "1 as row", "2 as at", "3 as pattern")
    out = url_filter.filter_urls(caps, entries.unionByName(deep))
    assert out.columns == [*caps.columns, *url_filter.ADDED]
    assert {r.id for r in out.filter("blocked").collect()} == {i for i in range(5000) if i % 3100 < 3000 and i % 3100 % 2 == 0}
    met = url_filter.histories(entries).count()
    assert met == -(-3000 // url_filter.CHANGES)
    long = spark.createDataFrame([(1, "http://h.example/" + "a/" * 20_000, datetime(2024, 2, 1))], "id long, url string, fetched_at timestamp")
    r = url_filter.filter_urls(long, deep).first()
    assert (r.n_active, r.decided_by, r.blocked) == (2, "h.example/a/a/a", False)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as cp

    rnd = random.Random(2)
    vocab = [f"{a}{b}" for a in "bcdfgklmnp" for b in ("ab", "en", "is", "um", "ol", "er")]
    say = lambda n: " ".join(rnd.choices(vocab, k=n))
    rows = [(i, say(rnd.randint(30, 200))) for i in range(300)]
    labels = []
    for i in range(0, 300, 3):
        if i % 9 == 0:
            rows[i] = (i, rows[i][1] + " you idiot moron scum idiot")
        labels.append((i, int(i % 9 == 0)))
    item = say(40)
    rows += [(400, rows[1][1]), (401, rows[1][1].replace(" ", "\n")), (402, rows[2][1] + " " + item), (403, ""), (404, None), (405, rows[4][1] + " " + rows[4][1] + " abend")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in cp.STAGES[:-1]:
        df = stage(spark, docs, str(tmp_path))
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        df.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    kept = {r.doc_id for r in docs.collect()}
    assert not kept & {i for i in range(0, 300, 9)} and 402 not in kept and 404 not in kept
    assert len(kept & {1, 400, 401}) == 1
    assert {i for i, _ in rows[:300] if i % 9} - kept <= {1}
    assert {r.doc_id for r in cp.run(spark, str(tmp_path)).collect()} == kept
    assert [n for n, _ in cp.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "decontamination", "packing"]
