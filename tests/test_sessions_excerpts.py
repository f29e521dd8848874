"""Sessions of a chat against a walk over each user's messages, and excerpts of claims against the whole edit matrix."""

import os
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from docjobs.jobs import render as R
from docjobs.jobs.queries import QUERIES
from docjobs.operators import excerpts, sessions
from tests.oracle import DATA
from tests.test_streams import Feed

START = datetime(2025, 3, 1)
MESSAGES = "user_id long, id long, ts timestamp, role string, text string"


def walked(rows, gap):
    """The session of each id."""
    out, last = {}, {}
    for user, i, ts, _, _ in sorted((r for r in rows if r[2]), key=lambda r: (r[2], r[1])):
        before, session = last.get(user, (None, None))
        session = session if before is not None and ts - before <= gap else ts
        last[user], out[i] = (ts, session), session
    return out


def messages():
    rnd = random.Random(4)
    rows = [(rnd.choice([1, 1, 1, 2, 3, None]), i, START + timedelta(minutes=rnd.randrange(60 * 24 * 6)), rnd.choice(["user", "assistant"]), rnd.choice([None, "", f"t{i}"])) for i in range(500)]
    rows += [(9, 1000 + k, START + timedelta(hours=h), "user", "far") for k, h in enumerate((0, 20, 60, 85, 110))]  # over days, and days without any
    return rows + [(1, 2000, None, "user", "no time"), (7, 2001, START, "user", "edge"), (7, 2002, START + timedelta(minutes=45), "user", "edge"), (7, 2003, START + timedelta(minutes=45), "user", "tie")]


@pytest.mark.parametrize("gap", [timedelta(minutes=45), timedelta(hours=25)])
def test_sessions_and_history(spark, gap):
    rows = messages()
    df = spark.createDataFrame([(*r, "x") for r in rows], f"{MESSAGES}, session_of string").repartition(5)
    want = walked(rows, gap)
    got = sessions.chat_sessions(df, f"{int(gap.total_seconds())} seconds")
    assert got.columns == [*df.columns, "session"]
    assert {r.id: r.session for r in got.collect()} == {r[1]: want.get(r[1]) for r in rows} and got.count() == len(rows)
    for last_n in (None, 2):
        heard = {r.id: [tuple(m) for m in r.history] for r in sessions.session_history(df, f"{int(gap.total_seconds())} seconds", last_n).collect()}
        assert set(heard) == {r[1] for r in rows if r[3] == "user"}
        for user, i, ts, role, _ in rows:
            if role == "user":
                before = sorted((r for r in rows if ts and r[2] and r[0] == user and want[r[1]] == want[i] and (r[2], r[1]) < (ts, i)), key=lambda r: (r[2], r[1]))
                assert heard[i] == [(r[3], r[4]) for r in before][-last_n if last_n else 0 :], i
    assert sessions.session_history(df.filter("false")).count() == 0


def test_stream_of_sessions(spark, tmp_path):
    feed, rows = Feed(spark, tmp_path, MESSAGES), [r for r in messages() if r[1] < 2002]
    rows.sort(key=lambda r: (r[2] is None, r[2] or START))
    for at in range(0, len(rows), 200):
        feed.add(rows[at : at + 200])
    feed.add([(0, -1, START + timedelta(days=30), "user", "clock")])
    feed.add([(1, -2, START, "user", "too late")])
    got = feed.run(sessions.stream_sessions(feed.stream(), "45 minutes", "5 days")).collect()
    feed.add([(0, -3, START + timedelta(days=60), "user", "clock")])  # another run from the checkpoint closes the rest, once
    got = feed.run(sessions.stream_sessions(feed.stream(), "45 minutes", "5 days")).collect()
    want = walked(rows, timedelta(minutes=45))
    made = {}
    for user, i, *_ in rows:
        if i in want:
            made.setdefault((user, want[i]), []).append(i)
    assert len([r for r in got if r.user_id != 0]) == len(made)
    for r in got:
        if r.user_id != 0:
            assert sorted(made[r.user_id, r.session]) == sorted(m.id for m in r.messages) and r.n == len(r.messages) and r.last == max(m.ts for m in r.messages)


def whole_matrix(claim, text):
    """(distance, end, start) by the full edit matrix: first to end, then the shortest."""
    rows = [(0, j) for j in range(len(text) + 1)]  # distance and greatest start for the empty claim
    for i, c in enumerate(claim, 1):
        now = [(i, 0)]
        for j, t in enumerate(text, 1):
            options = [(rows[j - 1][0] + (c != t), rows[j - 1][1]), (rows[j][0] + 1, rows[j][1]), (now[-1][0] + 1, now[-1][1])]
            now.append(min(options, key=lambda o: (o[0], -o[1])))
        rows = now
    distance, end = min((d, j) for j, (d, _) in enumerate(rows))
    return distance, end, rows[end][1]


def test_excerpts(spark):
    rnd = random.Random(6)
    text = lambda n, letters: "".join(rnd.choice(letters) for _ in range(n))
    docs = [(i, text(rnd.randrange(0, 400), "ab" if i % 3 == 0 else "abcdefg é😀")) for i in range(40)] + [(100, ""), (101, None), (102, "aaaa" * 60)]
    claims = []
    for i, t in docs:
        for k in range(8):
            if t and k < 6:
                at, n = rnd.randrange(len(t)), rnd.randrange(1, 60)
                c = list(t[at : at + n])
                for _ in range(rnd.randrange(0, 1 + len(c) // 4)):
                    p = rnd.randrange(len(c)) if c else 0
                    c[p : p + rnd.choice([0, 1])] = rnd.choice(["", "x", "a"])
                claims.append((i, k, "".join(c)))
            else:
                claims.append((i, k, [None, "", "zzzzzzzzzzzz"][k % 3]))
    claims.append((999, 0, "no such document"))
    got = {(r.doc_id, r.ord): r for r in excerpts.with_excerpts(spark.createDataFrame(claims, "doc_id long, ord int, value string"), spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert set(got) == {(i, k) for i, k, _ in claims if i != 999}
    texts, n = dict(docs), 0
    for i, k, c in claims[:-1]:
        want = None
        if c and texts[i]:
            distance, end, start = whole_matrix(c, texts[i])
            if distance <= min(int(len(c) * excerpts.SHARE), len(c) // excerpts.SEED - 1):
                want = (start, distance, texts[i][start:end])
                n += distance > 0
        r = got[i, k]
        assert (r.start, r.distance, r.excerpt) == (want or (None, None, None)), (i, k, c)
    assert n > 20


def last_row(claim, text):
    """The edit matrix's last row: the distance of the claim to the nearest span that ends at each place of the text."""
    codes, at = np.array([ord(c) for c in text], np.int64), np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, c in enumerate(claim, 1):
        now = np.concatenate(([i], np.minimum(row[:-1] + (codes != ord(c)), row[1:] + 1)))
        row = np.minimum.accumulate(now - at) + at
    return row


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
def test_registered_excerpts(spark):
    """Every row of the query, over whole texts."""
    texts = {r.doc_id: r.text or "" for r in R.table(spark, DATA, "documents").collect()}
    got = QUERIES["c2_excerpts"](spark, DATA).collect()
    assert len(got) == 3 * len(texts)
    found = 0
    for r in got:
        row = last_row(r.value or "", texts[r.doc_id])
        distance, most = int(row.min()), min(int(len(r.value or "") * excerpts.SHARE), len(r.value or "") // excerpts.SEED - 1)
        if not r.value or distance > most:
            assert (r.start, r.distance, r.excerpt) == (None, None, None)
            continue
        end = int(row.argmin())
        near = texts[r.doc_id][max(0, end - len(r.value) - distance) : end]
        assert r.distance == distance and r.excerpt == texts[r.doc_id][r.start : end] and whole_matrix(r.value, near)[2] == r.start - max(0, end - len(r.value) - distance)
        found += distance > 0
    assert found > len(texts)


def test_whole_texts_go_to_python_in_small_batches(spark):
    from docjobs.operators import verify

    key, docs = "spark.sql.execution.arrow.maxBytesPerBatch", spark.createDataFrame([(1, "a text of no length")], "doc_id long, text string")
    before = spark.conf.get(key)
    claims = docs.selectExpr("doc_id", "0 as ord", "'a' as id", "'address' as type", "'a texd of no' as value")
    try:
        for f in (lambda: excerpts.with_excerpts(claims, docs), lambda: verify.quick_verify(claims, docs), lambda: verify.verify_entity(docs.withColumn("claim", F.lit("texd")))):
            spark.conf.set(key, "1g")
            assert f().count() == 1 and int(spark.conf.get(key)) <= 4 << 20
            spark.conf.set(key, "1000")
            assert f().count() == 1 and spark.conf.get(key) == "1000"  # a smaller bound stays
    finally:
        spark.conf.set(key, before)
