"""Chunks along a text's structure, and edit scripts, against plain walks."""

import random

import pytest

from docjobs.operators import edits, split


def pieces(text, size, seps):
    if len(text) <= size:
        return [text]
    if not seps:
        return list(text)
    parts = text.split(seps[0])
    parts = [p + seps[0] for p in parts[:-1]] + parts[-1:]
    return [x for p in parts if p for x in pieces(p, size, seps[1:])]


def walk(text, size, overlap):
    """Chunks by moving pieces one by one."""
    out, held, tail = [], [], 0
    for p in pieces(text, size, split.SEPARATORS) if text else []:
        if sum(map(len, held)) + len(p) > size:
            out.append("".join(held))
            tail = sum(map(len, held))
            while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(p) > size):
                held.pop(0)
        held.append(p)
    return out + (["".join(held)] if held else [])


def texts():
    rnd = random.Random(7)
    out = ["", None, "a", "x" * 3000, "\n" * 2500, " ", "word " * 900, "p1\n\np2", "é" * 1001, "a\n\n\nb" * 400]
    for _ in range(60):
        words = ["".join(rnd.choices("abcdeü", k=rnd.randint(1, 30))) for _ in range(rnd.randint(1, 500))]
        out.append("".join(w + rnd.choice([" ", " ", " ", " ", "\n", "\n\n", "  "]) for w in words))
    return out


@pytest.mark.parametrize("size, overlap", [(1000, 200), (50, 20), (10, 0), (7, 6)])
def test_chunks_are_those_of_a_plain_walk(size, overlap):
    for t in texts():
        t = t or ""
        spans = split.spans(split.cuts(t, size), size, overlap)
        assert [t[a:b] for a, b in spans] == walk(t, size, overlap)
        assert all(b - a <= size for a, b in spans)
        at = 0  # no character is lost: spans overlap or meet
        for a, b in spans:
            assert a <= at < b and (a == 0 or at - a <= overlap)
            at = b
        assert at == len(t)


def test_split_documents(spark):
    rows = [(i, t, f"t{i}", "keep") for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string, row string").repartition(3)
    out = split.split_documents(df)
    assert out.columns == ["doc_id", "row", "chunk_no", "row_id", "start", "text"]
    got = {}
    for r in out.orderBy("doc_id", "chunk_no").collect():
        assert r.row == "keep" and r.row_id == str(r.chunk_no) and (rows[r.doc_id][1] or "")[r.start : r.start + len(r.text)] == r.text
        got.setdefault(r.doc_id, []).append(r.text)
    assert got == {i: walk(t, 1000, 200) for i, t, _, _ in rows if t}
    assert split.split_documents(df.filter("false")).collect() == []
    with pytest.raises(ValueError):
        split.split_documents(df, 10, 10)
    broken = spark.sql("select 1L doc_id, cast(X'41FF42' as string) text")
    assert [r.text for r in split.split_documents(broken).collect()] == ["A�B"]


def longest(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def applied(old, new, script):
    out, at = [], 0
    for i, n, j, m in script:
        out += old[at : i - 1] + new[j - 1 : j - 1 + m]
        at = i - 1 + n
    return out + old[at:]


def test_scripts_are_shortest_and_replay():
    rnd = random.Random(2)
    for _ in range(1500):
        k = rnd.choice([2, 3, 8])
        old, new = ([str(rnd.randrange(k)) for _ in range(rnd.randrange(14))] for _ in range(2))
        script = edits.hunks(old, new)
        assert applied(old, new, script) == new and len(old) - sum(h[1] for h in script) == longest(old, new)
        assert all(a[0] + a[1] < b[0] and a[2] + a[3] < b[2] for a, b in zip(script, script[1:]))  # hunks don't touch
    base = [f"line {i % 97}" for i in range(3000)]
    new = base[:500] + ["x"] + base[520:2000] + base[100:140] + base[2000:]
    script = edits.hunks(base, new)
    assert applied(base, new, script) == new and sum(h[1] for h in script) <= 20 and sum(h[3] for h in script) <= 41


def test_edit_scripts_of_pages(spark):
    rnd = random.Random(5)
    page = lambda: "\n".join(rnd.choice(["a", "b", "", "ü"]) for _ in range(rnd.randrange(12)))
    ref = [(i, 1, page()) for i in range(60)] + [(60, 1, None), (61, 1, "same"), (62, 2, "only here")]
    act = [(i, 1, page()) for i in range(60)] + [(60, 1, "new"), (61, 1, "same"), (63, 1, "only\nthere")]
    shape = "pair_id long, page_no int, text string"
    left, right = spark.createDataFrame(ref, shape), spark.createDataFrame(act, shape)
    out = edits.edit_scripts(left, right).join(left, ["pair_id", "page_no"], "left")
    got = {(r.pair_id, r.page_no): r for r in out.select("*", edits.replay(out["text"], out["hunks"]).alias("again")).collect()}
    old, new = {x[:2]: x[2] for x in ref}, {x[:2]: x[2] for x in act}
    assert set(got) == set(old) | set(new)
    for key, r in got.items():
        assert (r.again or "") == (new.get(key) or "") and (len(r.hunks) == 0) == (old.get(key, 0) == new.get(key, 1))
    assert (got[63, 1].n_added, got[63, 1].n_removed, got[62, 2].n_added, got[62, 2].n_removed) == (2, 0, 0, 1)
    assert edits.edit_scripts(left.filter("false"), right.filter("false")).collect() == []
