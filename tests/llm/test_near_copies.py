"""The pipeline's near-copy stage against brute force over five-word shingles."""

import random

import numpy as np
import pytest

import corpus_pipeline
from docjobs.llm import near_copies, simhash

SHAPE = "doc_id long, text string, lang string"


def shingled(t):
    w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or {" ".join(w)}


def classes_of(texts):
    sets, root = [shingled(t) for t in texts], list(range(len(texts)))
    for i, s in enumerate(sets):
        for j in range(i):
            both = len(s & sets[j])
            if root[i] != root[j] and 5 * both >= 4 * (len(s) + len(sets[j]) - both):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def planted():
    """Texts with copies in which some words differ, from a similarity of one to below the threshold."""
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    passage, out = " ".join(rnd.choices(words, k=60)), []
    for _ in range(40):
        base = rnd.choices(words, k=rnd.choice([30, 60, 150, 400]))
        out.append(" ".join(base))
        for share in (0.005, 0.01, 0.02, 0.025, 0.03):
            copy = list(base)
            for at in rnd.sample(range(len(copy)), max(1, int(share * len(copy)))):
                copy[at] = rnd.choice(words)
            out.append(" ".join(copy))
    out += [" ".join(rnd.choices(words, k=rnd.randint(5, 80))) + " " + passage for _ in range(80)]
    dense = rnd.choices(words, k=120)
    for _ in range(80):
        copy = list(dense)
        copy[rnd.randrange(120)] = rnd.choice(words)
        out.append(" ".join(copy))
    out += ["", None, " \n", "one two", "One  Two", "one two three", out[0].upper()]
    rnd.shuffle(out)
    return out


def test_stage_finds_planted_near_copies(spark):
    texts = planted()
    want = classes_of(texts)
    assert 60 < len(set(want)) < len(texts) - 150
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], SHAPE).repartition(5)
    left = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == sorted(set(want))
    assert corpus_pipeline.drop_near_copies(spark, docs.filter("false"), "").count() == 0


@pytest.mark.parametrize("few", [True, False])
def test_candidates_over_small_and_large_runs(few):
    """Sketches and sizes exclude no similar pair, in one run of all sets."""
    sets = [near_copies.shingles(t) for t in planted()]
    sets.sort(key=len)
    n = np.array([len(s) for s in sets])
    sketches = list(np.array([near_copies.sketch(s) for s in sets], np.uint64).T)
    found = [(i, j) for a, b in near_copies.candidates(np.zeros(len(n)), n, np.zeros(len(n), int), np.arange(len(n)), sketches, few) for i, j in zip(a.tolist(), b.tolist())]
    root = list(range(len(n)))
    for i, j in found:
        a, b = root[i], root[j]
        root = [min(a, b) if r in (a, b) else r for r in root]
    for i in range(len(n)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 5 * both >= 4 * (n[i] + n[j] - both):
                assert root[i] == root[j] and (few or (j, i) in found)
                assert near_copies.may_be_similar(near_copies.wide_sketch(sets[i]), near_copies.wide_sketch(sets[j]), n[i] + n[j])


def test_parts_of_candidates_make_them_all():
    """Each pair is in one part whatever run it is in, and early parts are small."""
    rnd = np.random.default_rng(4)
    n, node = np.full(200, 50), rnd.integers(-(2**63), 2**63 - 1, 200)
    run = np.repeat([0, 1], 100)
    node[100:] = node[:100]
    same = [np.zeros(200, np.uint64)]
    of = lambda part: [(r, frozenset((node[i], node[j]))) for a, b in near_copies.candidates(run, n, np.zeros(200, int), node, same, False, node, part) for r, i, j in zip(run[a].tolist(), a.tolist(), b.tolist())]
    parts = [of(p) for p in zip(near_copies.PARTS, near_copies.PARTS[1:])]
    assert sum(map(len, parts)) == len(set().union(*parts)) == 2 * 100 * 99 // 2
    assert all({p for r, p in x if r == 0} == {p for r, p in x if r == 1} for x in parts) and 0 < len(parts[0]) < 120


def test_large_group_of_near_copies_makes_few_rows(spark):
    """Pairs compared grow with a group's members, not with their square."""
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(500)]
    base, texts = rnd.choices(words, k=100), []
    for _ in range(600):
        copy = list(base)
        for at in rnd.sample(range(100), 1):
            copy[at] = rnd.choice(words)
        texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = classes_of(texts)
    assert sorted(r.doc_id for r in near_copies.near_dedup(docs).collect()) == sorted(set(want))


def test_prefixes_of_similar_sets_meet():
    texts = planted()
    sets = [near_copies.shingles(t) for t in texts]
    common = np.unique(np.concatenate(sets))[::7]
    first = [set(near_copies.prefix(s, common, np.arange(len(common))[::-1].copy()).tolist()) for s in sets]
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                assert first[i] & first[j]


@pytest.mark.parametrize("dedup", [simhash.near_dedup, near_copies.near_dedup])
def test_one_row_of_each_group_stays(spark, dedup):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(7, a), (7, a.upper()), (7, a.replace(" ", "  ")), (9, a), (None, b), (None, b.upper()), (None, a), (3, c), (3, c), (3, b[:70])]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], SHAPE).repartition(3)
    left = dedup(docs).collect()
    assert sorted((str(r.doc_id), r.text.lower().split()[0], len(r.text) == 70) for r in left) == [("3", "b0", True), ("3", "c0", False), ("7", "a0", False), ("None", "b0", False)]


def test_order_of_shingles_comes_from_all_documents(spark):
    """Shingles that stand only in documents which a sample by hash would leave out are known as common all the same."""
    texts = [f"{' '.join(f'x{i}y{j}' for j in range(12))} a passage that all of them share" for i in range(300)]
    crowded, rank = near_copies.crowded_buckets(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    passage = near_copies.shingles("a passage that all of them share")
    at = np.searchsorted(crowded, near_copies.buckets(passage))
    assert (crowded[at] == near_copies.buckets(passage)).all() and set(rank[at]) >= set(range(len(rank) - 3, len(rank)))
    sets = [near_copies.shingles(t) for t in texts]
    want = np.bincount(np.concatenate([near_copies.buckets(s) for s in sets]).astype(np.int64), minlength=near_copies.BUCKETS)
    assert crowded.tolist() == np.flatnonzero(want >= near_copies.LEAST_COMMON).tolist()
    own = near_copies.prefix(sets[0], crowded, rank, near_copies.buckets)
    assert len(own) and not set(own.tolist()) & set(passage.tolist())
