"""Exact and near dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest

from docjobs.llm import exact_dedup, simhash

SHAPE = "doc_id long, text string, lang string, keep_id string"


def texts():
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rnd.choices(words, k=rnd.randint(1, 120))) for _ in range(60)]
    out = base + [rnd.choice(base[:20]).replace(" ", rnd.choice(["  ", "\n", "\t"])) for _ in range(80)] + [base[0]] * 60
    out += [" ".join(t.split()[:-1] + [rnd.choice(words)]) for t in base * 2] + ["", None, " \n", "a", "A", "\x85", "x" * 200_000, "x" * 199_999 + "y"]
    rnd.shuffle(out)
    return out


def docs(spark, rows=None):
    rows = list(enumerate(texts())) if rows is None else rows
    return spark.createDataFrame([(i, t, "en", "clash") for i, t in rows], SHAPE).repartition(5)


def norm(t):
    return "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")


def test_exact_dedup(spark):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r for r in exact_dedup.assign_owners(docs(spark)).collect()}
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i))
    for i, t in rows:
        r, g = got[i], groups[norm(t)]
        assert (r.keep_id, r.group_size, r.kept) == (min(g)[1], len(g), min(g)[1] == i)
        assert r.text_sha256 == hashlib.sha256(norm(t).encode()).hexdigest() and r.lang == "en"
    kept = exact_dedup.drop_duplicates(docs(spark))
    assert kept.columns == ["doc_id", "text", "lang", "keep_id"] and sorted(r.doc_id for r in kept.collect()) == sorted(min(g)[1] for g in groups.values())


def test_exact_dedup_odd_rows(spark):
    df = docs(spark, [(7, "a b"), (7, "a b"), (8, "ab"), (None, "a  b"), (None, "q"), (None, None)])
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.assign_owners(df).collect()]
    assert sorted(got, key=str) == sorted([(7, None, 4, False), (7, None, 4, False), (8, None, 4, False), (None, None, 4, True), (None, None, 1, True), (None, None, 1, True)], key=str)
    again = docs(spark, [(7, "a b"), (7, "a b"), (8, "ab")])
    assert [r.doc_id for r in exact_dedup.drop_duplicates(again).collect()] == [7]
    assert exact_dedup.assign_owners(docs(spark, [])).count() == 0


@pytest.mark.parametrize("limit", [1 << 30, 2000, 10])
def test_trie_spills_by_subtree(limit):
    rnd = random.Random(1)
    keys = [bytes(rnd.choices(b"ab\x00\xff", k=rnd.randint(0, 9))) for _ in range(3000)]
    trie, want = exact_dedup.SpillingTrie(min, limit), {}
    for k in keys:
        v = rnd.random()
        trie.insert(k, v)
        want[k] = min(v, want.get(k, 2))
    found = list(trie.items())
    assert len(found) == len(want) and dict(found) == want


def test_trie_memory_with_long_shared_prefixes():
    keys = [b"a" * 50 + b"%d" % (i * i) for i in range(2000)] + [b"b" * 100_000 + x for x in (b"", b"x", b"y")]
    trie = exact_dedup.SpillingTrie(lambda a, b: a + b, 10_000)
    for k in keys * 2:
        trie.insert(k, 1)
    assert sorted(trie.items()) == sorted((k, 2) for k in keys)
    assert trie.spills > 100 and trie.peak < 10_000 + 100_000 + 2 * exact_dedup.NODE_BYTES


def test_owners_that_spill_and_ids_of_text(spark):
    rows = [(f"d{i:04}", t) for i, t in enumerate(texts())]
    df = spark.createDataFrame([(i, t, 1, 2, 3, 4, 5) for i, t in rows], "doc_id string, text string, row int, number int, rest int, body int, `a.b` int").repartition(5)
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i))
    want = sorted((i, min(groups[norm(t)])[1], len(groups[norm(t)]), t) for i, t in rows)
    for memory in (2_000, 1 << 24):
        out = exact_dedup.assign_owners(df, memory=memory)
        assert out.columns == [*df.columns, "keep_id", "group_size", "kept", "text_sha256"]
        assert sorted((r.doc_id, r.keep_id, r.group_size, r.text) for r in out.collect()) == want
        kept = exact_dedup.drop_duplicates(df, memory=memory)
        assert kept.schema == df.schema and sorted(r.doc_id for r in kept.collect()) == sorted(min(g)[1] for g in groups.values())


def plain_fingerprint(t):
    import re

    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes_of(fps, radius):
    n, root = len(fps), list(range(len(fps)))
    for i in range(n):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_simhash_classes(spark):
    rows = list(enumerate(texts()))
    fps = [plain_fingerprint(t) for _, t in rows]
    want = classes_of(fps, 3)
    found = simhash.classes(docs(spark)).collect()
    assert {r.doc_id: (r.fp % 2**64, r.component_id) for r in found} == {i: (fps[i], want[i]) for i, _ in rows}
    left = simhash.near_dedup(docs(spark))
    assert left.columns == ["doc_id", "text", "lang", "keep_id"] and sorted(r.doc_id for r in left.collect()) == sorted(set(want))


@pytest.mark.parametrize("hot", [4, 30, 10_000])
def test_dense_fingerprints_and_hot_keys(spark, hot):
    rnd = random.Random(hot)
    centres = [rnd.getrandbits(64) for _ in range(6)]
    fps = {c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 5))) for c in centres for _ in range(60)}
    fps = sorted(fps | {rnd.getrandbits(64) for _ in range(40)})
    nodes = spark.createDataFrame([(x - (x >> 63 << 64),) for x in fps], "fp long").repartition(3)
    comp = {r.node % 2**64: r.root for r in simhash.components(simhash.links(nodes, 3, hot)).collect()}
    want = classes_of(fps, 3)
    for i, x in enumerate(fps):
        alone = want.count(want[i]) == 1
        assert (x not in comp) == alone
        if not alone:
            first = min((y - (y >> 63 << 64) for y, w in zip(fps, want) if w == want[i]))
            assert comp[x] == first


def test_cover_holds_every_link():
    rnd = np.random.default_rng(0)
    bits = rnd.random((4000, 64)) < 0.5
    together = (bits.T.astype(float) @ bits).astype(float)
    for n in (1e3, 1e6, 1e9, 1e12):
        plan = simhash.allocate(int(n), together * (n / 4000))
        assert sorted(b for part, _ in plan for b in part) == sorted({b for part, _ in plan for b in part})
        assert sum(t + 1 for _, t in plan) == 4
        for _ in range(300):
            flips = set(rnd.choice(64, rnd.integers(0, 4), replace=False).tolist())
            assert any(len(flips & set(part)) <= t for part, t in plan)


def test_path_components(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(500, 501), (-5, 501)], "u long, v long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, -5: -5, 500: -5, 501: -5}
    assert simhash.components(edges.filter("false")).count() == 0


def test_near_dedup_of_nothing(spark):
    assert simhash.classes(docs(spark, [])).count() == 0
    r = simhash.classes(docs(spark, [(None, "a b c d"), (4, "a b c d"), (4, "a b c d")])).collect()
    assert {x.component_id for x in r} == {4} and len(r) == 3
