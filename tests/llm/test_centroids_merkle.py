"""Clustering against a plain loop, and the Merkle manifest against a tree built by hand."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from docjobs.llm import centroids, merkle

VECTORS = "vec_id long, embedding array<float>"


def plain_clusters(rows, k=8, rounds=10):
    kept = [(i, [int(np.floor(1024.0 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    middle = [v for _, v in first]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(middle))
    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for j in range(len(middle)):
            own = [v for (_, v), o in zip(kept, of) if o == j]
            if own:
                middle[j] = [sum(x) // len(own) for x in zip(*own)]
    out = [(i, *nearest(v)[::-1]) for i, v in kept]
    per = {j: sum(d for _, o, d in out if o == j) for j in range(len(middle))}
    return sorted(((str(i), j, d, per[j], sum(per.values()), hashlib.sha256(",".join(map(str, middle[j])).encode()).hexdigest()) for i, j, d in out), key=str)


def vectors():
    rnd = np.random.RandomState(5)
    middles = rnd.randn(6, 64)
    rows = [(i, (middles[i % 6] + rnd.randn(64) * rnd.choice([0.05, 0.6])).astype(np.float32).tolist()) for i in range(300)]
    rows += [(i, [0.25] * 64) for i in range(300, 400)]  # a third alike, in ties
    rows += [(7, rows[8][1]), (None, rows[9][1]), (None, rows[9][1]), (401, None), (402, [1.0] * 63), (403, [None] + [1.0] * 63), (404, [float("nan")] * 64), (405, [float("inf")] * 64), (406, [-1000.5] * 64), (407, [1000.5] * 64)]
    return rows


def test_clusters_are_those_of_a_plain_loop(spark, tmp_path):
    rows = vectors()
    spark.createDataFrame(rows, VECTORS).repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = centroids.op12_centroids(spark, str(tmp_path)).collect()
    assert sorted(((str(r[0]), *r[1:]) for r in got), key=str) == plain_clusters(rows)


def test_bounds_save_work(spark):
    _, _, scans = centroids.fit(spark.createDataFrame(vectors()[:300], VECTORS))
    assert scans[0] > 250 and sum(scans[1:]) < 300 * 10 * 0.7


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5] * 64)], [(1, [0.5] * 64), (2, [-0.5] * 64)]])
def test_few_vectors(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], VECTORS + ", cluster string")
    out = centroids.cluster(df)
    assert out.columns == ["vec_id", *centroids.ADDED]
    assert sorted((r.vec_id, r.distance) for r in out.collect()) == [(i, 0) for i, v in rows if v]


def test_large_components_are_refused(spark):
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(spark.createDataFrame([(1, [1e30] * 64)], VECTORS)).collect()


# ---- Merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes):
    """The top, and for each node its siblings level by level."""
    proofs, under = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        new, new_under = [], []
        for s in range(0, len(nodes), 8):
            run = nodes[s : s + 8]
            for k, members in enumerate(under[s : s + 8]):
                for i in members:
                    proofs[i] += run[:k] + run[k + 1 :]
            new.append(sha(*run))
            new_under.append(sum(under[s : s + 8], []))
        nodes, under = new, new_under
    return nodes[0], proofs


def plain_manifest(rows):
    """rows (doc_id, source, lang, n_chars, text)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    low = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {x: sorted(((sha(*map(field, r)), r) for r in rows if r[2] == x), key=lambda y: (y[1][0] is not None, y[1][0] or 0, y[0])) for x in langs}
    trees = {x: plain_tree([h for h, _ in g]) for x, g in groups.items()}
    root, tops = plain_tree([trees[x][0] for x in langs])
    out = []
    for x, top in zip(langs, tops):
        for (h, r), proof in zip(groups[x], trees[x][1]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and low(r[4]) != r[4]
            out.append((str(r[0]), h, trees[x][0], root, sha(*proof, *top), not hit))
    return sorted(out)


def documents(n, langs):
    rnd = random.Random(n)
    rows = [(i, rnd.choice(["web", None, "é:1"]), rnd.choice(langs), rnd.choice([None, i]), rnd.choice(["Some Text", "plain", "", None, "Ünï 12:x"])) for i in range(n)]
    return rows + rows[: n // 10] + [(None, None, langs[0], None, "T")] * (n // 20)


@pytest.mark.parametrize("n, langs, levels", [(1, ["en"], 5), (700, [None, "en", "de", "é", "zz"], 1), (1300, [f"l{i}" for i in range(70)], 2)])
def test_manifest_is_the_plain_tree(spark, n, langs, levels):
    rows = documents(n, langs)
    got = merkle.tampered(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3), local=levels).collect()
    assert sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.verified) for r in got) == plain_manifest(rows)
    assert all(r.verified == (r.folded_root == r.root) for r in got)


@pytest.mark.parametrize("levels", [0, 1, 2])
def test_local_subtrees_meet(levels):
    """Any cut of a group into pieces gives the levels of the whole tree, and proofs up to the tops."""
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(150)]
    whole = [leaves]
    while len(whole[-1]) > 1:
        whole.append([merkle.digest(whole[-1][s : s + 8]) for s in range(0, len(whole[-1]), 8)])
    for cut in (0, 1, 8, 63, 64, 65, 149):
        for first, part in ((0, leaves[:cut]), (cut, leaves[cut:])):
            if part:
                made = merkle.subtrees(part, first, len(leaves), levels)
                assert len(made) <= levels + 1
                for h, (low, nodes) in enumerate(made):
                    assert nodes == whole[h][low : low + len(nodes)]
                for i, (h, top, proof) in enumerate(merkle.local_proofs(made)):
                    own, place, size, at = part[i], first + i, len(leaves), 0
                    for _ in range(h):
                        start, run = merkle.run_of(place, size)
                        others = [proof[at + 32 * k : at + 32 * (k + 1)] for k in range(run - 1)]
                        others.insert(place - start, own)
                        own, at, place, size = merkle.digest(others), at + 32 * (run - 1), place // 8, merkle.up(size)
                    assert (h, top) in merkle.maximal(made) and own == whole[h][top] and at == len(proof)


def test_empty_and_clashing_names(spark):
    shape = "doc_id long, source string, lang string, n_chars long, text string, g string, leaf string, row string, proof string"
    empty = merkle.manifest(spark.createDataFrame([], shape))
    assert empty.collect() == []
    rows = spark.createDataFrame([(1, None, None, None, None, "a", "b", "c", "d")], shape)
    one = merkle.manifest(rows, fields=("doc_id", "g", "row"), group="leaf").collect()
    assert len(one) == 1 and one[0].leaf == one[0].subroot == one[0].root and bytes(one[0].proof) == b""
