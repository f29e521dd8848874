"""The LSH forest against brute force over two-word shingles."""

import random

import numpy as np
import pytest

from docjobs.llm import minhash

SHAPE = "doc_id long, text string"


def shingled(t):
    w = "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
    return {tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))} if w else set()


def components_of(rows):
    """doc_id -> (set size, smallest id reachable), all pairs compared."""
    sets = {i: shingled(t) for i, t in rows}
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if j < i and root[i] != root[j] and sets[i]:
                both = len(sets[i] & sets[j])
                if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                    a, b = sorted((root[i], root[j]))
                    root = {k: a if r == b else r for k, r in root.items()}
    return {i: (len(s), root[i]) for i, s in sets.items()}


def planted():
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(2000)]
    passage, out = " ".join(rnd.choices(words, k=40)), ["", None, " \n\t", "one", "ONE ", "one two", "one  two", "two one"]
    for _ in range(40):
        base = rnd.choices(words, k=rnd.choice([3, 8, 30, 100, 400]))
        out.append(" ".join(base))
        for share in (0.01, 0.03, 0.05, 0.06, 0.08):
            copy = list(base)
            for at in rnd.sample(range(len(copy)), max(1, int(share * len(copy)))):
                copy[at] = rnd.choice(words)
            out.append(" ".join(copy))
    out += [" ".join(rnd.choices(words, k=rnd.randint(5, 60))) + " " + passage for _ in range(60)]
    dense = rnd.choices(words, k=100)  # near copies of near copies: a chain from similar to not similar
    for _ in range(120):
        copy = list(dense)
        copy[rnd.randrange(100)] = rnd.choice(words)
        out.append(" ".join(copy))
        dense = copy if rnd.random() < 0.3 else dense
    out += [" ".join(dense)] * 30 + [" ".join(rnd.choices(words, k=6000))]
    rnd.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("hot", [minhash.HOT, 8])
def test_components_are_those_of_brute_force(spark, hot):
    """With regions of more than eight texts hot, most groups go through cells."""
    rows = planted()
    want = components_of(rows)
    got = minhash.classes(spark.createDataFrame(rows, SHAPE).repartition(5), hot=hot).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_dedup_keeps_one_of_each(spark):
    rows = [(1, "a b c"), (1, "a b c"), (None, "a  b c"), (2, ""), (3, None), (4, "x y"), (None, "z")]
    df = spark.createDataFrame([(*r, "k") for r in rows], SHAPE + ", node string")
    left = minhash.near_dedup(df)
    assert left.columns == df.columns and sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in left.fillna("-").collect()) == [(False, 1, "a b c"), (False, 2, ""), (False, 3, "-"), (False, 4, "x y"), (True, 0, "z")]


def test_edges(spark):
    empty = spark.createDataFrame([], SHAPE)
    assert minhash.classes(empty).collect() == []
    rows = spark.createDataFrame([(5, "p q"), (5, "p q"), (None, "P Q"), (None, None)], SHAPE).selectExpr("doc_id", "text").unionByName(spark.sql("select 9L doc_id, cast(X'FF4142' as string) text"))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.classes(rows).collect()), key=str)
    assert got == sorted([(5, 1, 5, True), (5, 1, 5, True), (None, 1, 5, False), (None, 0, None, True), (9, 1, 9, True)], key=str)


def test_regions_are_as_deep_as_they_must_be():
    head = np.repeat(np.array([64, 128, 192]), [minhash.LEAF, minhash.LEAF + 4, 1])
    rest = np.concatenate([np.arange(minhash.LEAF), np.repeat([1 << 16, 2 << 16], minhash.LEAF // 2 + 2), [5]])
    region, ok = minhash.leaves(head, rest, np.ones(len(head), bool))
    assert len(set(region[: minhash.LEAF])) == 1 and len(set(region[minhash.LEAF : -1])) == 2 and ok[:-1].all() and not ok[-1]
    region, ok = minhash.leaves(head, rest, np.zeros(len(head), bool))
    assert ok.all() and len(set(region)) == len(set(zip(head, rest)))


def test_signatures_agree_as_sets_do():
    rnd = np.random.RandomState(1)
    for share in (0.5, 0.8, 0.95):
        both = rnd.randint(0, 1 << 62, 4000).astype(np.uint64)
        cut = int(4000 * share)
        rest = (4000 - cut) // 2
        a, b = minhash.signature(both[: cut + rest]), minhash.signature(np.concatenate([both[:cut], both[cut + rest :]]))
        assert abs((a == b).mean() - share) < 0.11
