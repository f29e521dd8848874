"""MinHash near-dedup by an LSH forest.

Two documents link at a Jaccard similarity of 0.8 or more of their sets of two-word shingles; classes are connected
components of links. The work is on distinct texts:

* Each set gets ``TREES`` signatures of ``DEPTH`` minima each, drawn from hash functions of their own. A tree is the sorted
  order of one signature over all texts: texts with long common prefixes are neighbours. The orders are sorted by range, so
  a prefix that a third of all texts share spreads over tasks.
* The candidates of a text are its neighbours with the longest common prefix: a region of a tree is as deep as it must be.
  Where at most ``LEAF`` texts share the first ``SHALLOW`` minima they are one region, else those that share one more, and
  where that is more than ``HOT``, or goes on in another task, all minima. Regions of one text are dropped.
* Candidates must differ in component, and agree in size, in a sketch of 64 minima and in a parity sketch (a shingle flips
  its bit: sets differ in as many shingles at least as sketches in bits) as far as similar sets do. The first
  rounds look at two trees, then at all, and compare only as many as join what may be similar, so that a dense group of near
  copies makes about as many rows as it has members. The next rounds compare what is left, first a part of it: what few
  pairs of a part join needn't be compared in the rest. Regions that lie in one component are closed, and not read again.
* A region with more than ``HOT`` texts is dealt in cells: blocks of all its texts against blocks of those outside its
  largest component, so each pair that may still link meets in one cell, and no cell holds more than two blocks.
* Links are confirmed on the full sets. No candidate is left out.

Similar sets are missed only if no tree has them in one region: at a similarity of 0.8 a tree of depth 5 finds them with a
chance of 0.33, and all 40 trees miss with one of 1.3e-7 (0.9: 7e-16); in regions of full depth 5e-6. The sketch
drops a pair at 0.8 with a chance of 2e-8.

Defined results: words are separated by the six ASCII white-space characters and A to Z are lower-cased; a text of one word has
that word as its shingle; null, empty and white texts have the empty set and link with nothing, each being a component of its
own; rows that repeat are evaluated each, and of equal texts any row stands for all; a null doc_id is the smallest of a
component only if all are null; ``near_dedup`` keeps exactly one row of each component, and all texts without words; shingles
and texts are told apart by 64-bit hashes. Empty tables give empty results; columns of any name are kept.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docjobs.llm.common import drop_written, n_written, one_of_each, row_key, small_batches, stored, written
from docjobs.llm.near_copies import DEN, NUM, _joined, pair_hash, wide_sketch

SHINGLE, SEED = 2, 11
TREES, DEPTH, SHALLOW = 40, 6, 4
#: Texts that may share a shallow prefix before a region goes deeper, and those that a task compares at once.
LEAF, HOT = 16, 4096
#: Minima in the sketch of a set, of one byte each, and how many of them similar sets have in common at least.
SKETCH, AGREE = 64, 32
#: Rounds: trees, whether few pairs that join all are enough, and the part of the pairs as bounds of their hashes.
WAVES = ((2, True, (0.0, 1.0)), (TREES, True, (0.0, 1.0)), (TREES, False, (0.0, 1 / 16)), (TREES, False, (1 / 16, 1.0)))
#: Rows of sorted orders that a task looks at together, and shingles whose minima it takes at once.
ROWS, BLOCK = 1 << 17, 4096

#: Texts that are compared are found by a broadcast of their numbers up to so many, 16 MB, and by a shuffle beyond.
SENT = 1 << 20

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_DRAWN = np.random.RandomState(SEED).randint(0, 1 << 32, (2, TREES * DEPTH), dtype=np.uint64).astype(np.uint32)
_XOR, _TIMES = _DRAWN[0], _DRAWN[1] | np.uint32(1)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_TREE = np.uint64(63)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * _M1
        x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """The hashes of the different shingles of k words, ascending; all words if there are fewer, none without words."""
    words = (text or "").encode().translate(_LOWER).split()  # on the six ASCII white-space characters
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(k, len(h))
    out = h[: len(h) - width + 1]
    with np.errstate(over="ignore"):
        for j in range(1, width):
            out = _mixed(out) * _M1 + h[j : len(h) - width + 1 + j]
    return np.unique(_mixed(out ^ np.uint64(width)))


def signature(own: np.ndarray) -> np.ndarray:
    """The minima of a set under each hash function."""
    out = np.full(TREES * DEPTH, np.uint32(0xFFFFFFFF))
    x = (own >> np.uint64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(x), BLOCK):
            np.minimum(out, ((x[at : at + BLOCK, None] ^ _XOR) * _TIMES).min(0), out=out)
    return out


def orders(sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each set and tree, a hash of the first SHALLOW minima (its last six bits are the tree) and the other minima, 16 bits each."""
    own = sigs.reshape(-1, TREES, DEPTH)
    head = np.broadcast_to(np.arange(TREES, dtype=np.uint64), own.shape[:2])
    with np.errstate(over="ignore"):
        for j in range(SHALLOW):
            head = _mixed(head * _M1 + own[:, :, j])
    rest = np.zeros(own.shape[:2], np.int64)
    for j in range(SHALLOW, DEPTH):
        rest = rest << 16 | (own[:, :, j] >> np.uint32(16)).astype(np.int64)
    return head & ~_TREE | np.arange(TREES, dtype=np.uint64), rest.astype(np.int32)


def _text_rows(k, batches):
    for batch in batches:
        sets = [shingles(t, k) for t in batch.column(3).to_pylist()]
        sigs = np.array([signature(s) for s in sets], np.uint32).reshape(-1, TREES * DEPTH)
        n = np.array([len(s) for s in sets], np.int64)
        sketch = (sigs[:, ::3][:, :SKETCH] >> np.uint32(16)).astype(np.uint8)
        heads, rests = orders(sigs)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1), batch.column(2), pa.array(n), pa.array([s.tobytes() for s in sketch], pa.binary()), pa.array([wide_sketch(s) for s in sets], pa.binary()),
                pa.array([h.tobytes() for h in heads], pa.binary()), pa.array([r.tobytes() for r in rests], pa.binary()),
            ],
            names=["doc_id", "key", "node", "n", "sketch", "wide", "heads", "rests"],
        )


def _order_rows(batches):
    for batch in batches:
        node = batch.column(0).to_numpy(zero_copy_only=False)
        if len(node):
            heads = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
            rests = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(heads), pa.array(rests), pa.array(np.repeat(node, TREES))], names=["head", "rest", "node"])


def leaves(head: np.ndarray, rest: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The region of each row of sorted (head, rest), and whether it has others; rows that are not of whole runs are taken at full depth, as if they had."""

    def runs(*columns):
        new = np.ones(len(head), bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        which = np.cumsum(new) - 1
        return np.bincount(which)[which]

    deep = DEPTH - SHALLOW
    region, size = head.view(np.uint64), runs(head)
    open_ = ~whole | (size > LEAF)
    for j in range(1, deep + 1):
        part = rest >> 16 * (deep - j)
        own = runs(head, part)
        with np.errstate(over="ignore"):
            further = _mixed(head.view(np.uint64) * _M1 + part.astype(np.uint32).astype(np.uint64) * _M2 + np.uint64(j))
        region, size = np.where(open_, further, region), np.where(open_, own, size)
        open_ &= ~whole | (size > HOT)
    tree = head.view(np.uint64) & _TREE
    return (region & ~_TREE | tree).view(np.int64), ~whole | (size > 1)


def _leaf_rows(batches):
    """region, node for sorted rows (head, rest, node). The first and the last run of a partition may go on in others."""
    held, size, first = [], 0, None

    def out(columns, end, last: bool):
        nonlocal first
        head, rest, node = (c[:end] for c in columns)
        if first is None:
            first = head[0]
        whole = head != first
        if last:
            whole &= head != head[-1]
        region, ok = leaves(head, rest, whole)
        return pa.RecordBatch.from_arrays([pa.array(region[ok]), pa.array(node[ok])], names=["region", "node"])

    for batch in batches:
        held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
        size += batch.num_rows
        if size >= ROWS:
            columns = [np.concatenate(x) for x in zip(*held)]
            end = int(np.searchsorted(columns[0], columns[0][-1]))
            if not end:  # one long run, of which more may come: at full depth, as the first of a partition is
                first, end = columns[0][0], len(columns[0])
            yield out(columns, end, False)
            held, size = [[c[end:] for c in columns]], len(columns[0]) - end
    columns = [np.concatenate(x) for x in zip(*held)] if held else [()]
    if len(columns[0]):
        yield out(columns, len(columns[0]), True)


class Sketches:
    """Parity sketches (``wide_sketch``) of rows, by width."""

    def __init__(self, blobs: list[bytes]):
        self.width = np.array([len(b) for b in blobs])
        self.at, self.rows = np.zeros(len(blobs), np.int64), {}
        for w in np.unique(self.width).tolist():
            own = np.flatnonzero(self.width == w)
            self.at[own] = np.arange(len(own))
            self.rows[w] = np.frombuffer(b"".join(blobs[i] for i in own.tolist()), np.uint64).reshape(len(own), -1)

    def differ(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """In how many bits pairs differ, at the smaller width of the two: as many shingles differ at least."""
        swap = self.width[x] > self.width[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        out, kind = np.zeros(len(x), np.int64), self.width[x] << 32 | self.width[y]
        for both in np.unique(kind).tolist():
            own = np.flatnonzero(kind == both)
            low, high = both >> 32, both & 0xFFFFFFFF
            step = max(1, (1 << 23) // high)
            for i in range(0, len(own), step):
                part = own[i : i + step]
                a, b = self.rows[low][self.at[x[part]]], self.rows[high][self.at[y[part]]]
                while b.shape[1] > a.shape[1]:
                    b = b[:, : b.shape[1] // 2] ^ b[:, b.shape[1] // 2 :]
                out[part] = np.bitwise_count(a ^ b).sum(1, dtype=np.int64)
        return out


def candidates(region, side, node, n, root, sketch, wide: Sketches, few: bool, part: tuple[float, float]):
    """Yields (positions, positions) of rows of a region that may be similar, sorted by (region, n); with few, only as many as join all."""
    _, label = np.unique(root, return_inverse=True)
    own = np.arange(label.max() + 1 if len(label) else 0)
    last = np.searchsorted(region, region, "right")

    def find(i):
        while own[i] != i:
            own[i] = own[own[i]]
            i = own[i]
        return i

    lag, active = 1, np.flatnonzero(last - np.arange(len(region)) > 1)
    while len(active):
        a, b = active, active + lag
        ok = own[label[a]] != own[label[b]]
        ok &= (side[a] == 0) | (side[a] != side[b])
        a, b = a[ok], b[ok]
        if part != (0.0, 1.0) and len(a):
            h = pair_hash(node[a], node[b])
            ok = (part[0] <= h) & (h < part[1])
            a, b = a[ok], b[ok]
        for at in range(0, len(a), 1 << 16):
            x, y = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
            ok = (sketch[x] == sketch[y]).sum(1) >= AGREE
            x, y = x[ok], y[ok]
            ok = wide.differ(x, y) * (DEN + NUM) <= (DEN - NUM) * (n[x] + n[y])
            x, y = x[ok], y[ok]
            if few and len(x):
                taken = []
                for i, (p, q) in enumerate(zip(label[x].tolist(), label[y].tolist())):
                    p, q = find(p), find(q)
                    if p != q:
                        own[max(p, q)] = min(p, q)
                        taken.append(i)
                x, y = x[taken], y[taken]
                while not (own[own] == own).all():
                    own[:] = own[own]
            if len(x):
                yield x, y
        lag += 1
        active = active[last[active] - active > lag]
        active = active[n[active] * DEN >= n[active + lag] * NUM]  # rows ascend by size


def _pair_rows(few, part, batches):
    """Rows sorted by (region, n) in whole regions."""

    def out(rows: pa.Table):
        region, side, node, n, root = (rows.column(i).to_numpy() for i in range(5))
        sketch = np.frombuffer(b"".join(rows.column(5).to_pylist()), np.uint8).reshape(-1, SKETCH)
        for a, b in candidates(region, side, node, n, root, sketch, Sketches(rows.column(6).to_pylist()), few, part):
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(node[a], node[b])), pa.array(np.minimum(node[a], node[b]))], names=["u", "v"])

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= ROWS // 8:
            rows = pa.Table.from_batches(held)
            region = rows.column(0).to_numpy()
            end = int(np.searchsorted(region, region[-1]))
            if end:
                yield from out(rows.slice(0, end))
                held, size = rows.slice(end).combine_chunks().to_batches(), rows.num_rows - end
    if size:
        yield from out(pa.Table.from_batches(held))


def _set_rows(k, batches):
    for batch in batches:
        sets = [shingles(t, k).view(np.int64) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "own"])


def _dealt(rows: DataFrame, few: bool, hot: int) -> DataFrame:
    """rows (region, node, root) of regions that lie in more than one component, as region, side, node, root; large regions in cells."""
    regions = rows.groupBy("region").agg(F.count("*").alias("c"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("region", "c")
    regions = written(regions, "regions")
    large = regions.filter(F.col("c") > hot)
    cool = rows.join(regions.filter(F.col("c") <= hot), "region").select("region", F.lit(0).alias("side"), "node", "root")
    if large.isEmpty():
        return cool
    warm = rows.join(large, "region").withColumn("blocks", F.ceil(F.col("c") / hot).cast("int"))
    block = lambda of, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(of)).cast("int")
    if few:
        return cool.unionByName(warm.select(F.xxhash64("region", block("blocks", 1)).alias("region"), F.lit(0).alias("side"), "node", "root"))
    of_root = rows.join(large, "region").groupBy("region", "root").agg(F.count("*").alias("m"), F.first("c").alias("c"))
    main = of_root.groupBy("region").agg(F.max_by("root", F.struct("m", "root")).alias("main"), (F.max("c") - F.max("m")).alias("others"))
    warm = warm.join(written(main, "main-components"), "region").withColumn("over", F.greatest(F.lit(1), F.ceil(F.col("others") / hot).cast("int")))
    cell = F.xxhash64("region", F.col("i"), F.col("j")).alias("region")
    left = warm.select("region", "node", "root", block("blocks", 1).alias("i"), F.explode(F.sequence(F.lit(0), F.col("over") - 1)).alias("j"), F.lit(1).alias("side"))
    right = warm.filter("root <> main").select("region", "node", "root", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), block("over", 2).alias("j"), F.lit(2).alias("side"))
    return cool.unionByName(left.unionByName(right).select(cell, "side", "node", "root"))


def similar_components(docs: DataFrame, nodes: DataFrame, text: str = "text", k: int = SHINGLE, hot: int = HOT) -> DataFrame:
    """nodes (node, n, sketch, wide, heads, rests) -> node, root (the smallest node of its component) for each that is similar to another."""
    spark, first = docs.sparkSession, n_written()
    sorted_ = nodes.filter("n > 0").select("node", "heads", "rests").mapInArrow(_order_rows, "head long, rest int, node long").repartitionByRange("head", "rest", "node").sortWithinPartitions("head", "rest", "node")
    met = written(sorted_.mapInArrow(_leaf_rows, "region long, node long"), "regions")
    found, folder = spark.createDataFrame([], "node long, root long"), None
    compared, kept = None, []
    for trees, few, part in WAVES:
        mark = n_written()
        rows = met.filter(F.col("region").bitwiseAND(F.lit(63)) < trees).join(found, "node", "left").select("region", "node", F.coalesce("root", "node").alias("root"))
        dealt = _dealt(rows, few, hot).join(nodes.select("node", "n", "sketch", "wide"), "node").select("region", "side", "node", "n", "root", "sketch", "wide")
        pairs = dealt.repartition("region").sortWithinPartitions("region", "n", "node").mapInArrow(functools.partial(_pair_rows, few, part), "u long, v long").distinct()
        pairs = written(pairs if compared is None else pairs.join(compared, ["u", "v"], "left_anti"), "candidates")
        asked = written(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "asked")
        if n_asked := asked.count():
            asked = F.broadcast(asked) if n_asked <= SENT else asked  # else texts are shuffled
            texts = docs.select(F.xxhash64(text).alias("node"), F.make_valid_utf8(F.col(text)).alias("text")).join(asked, "node", "left_semi").dropDuplicates(["node"])
            sets = written(texts.mapInArrow(functools.partial(_set_rows, k), "node long, own array<long>"), "sets")
            both = pairs.join(sets.select(F.col("node").alias("u"), F.col("own").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("own").alias("b")), "v")
            same = F.size(F.array_intersect("a", "b"))
            done, at = stored(both.select("u", "v", (same * (DEN + NUM) >= (F.size("a") + F.size("b")) * NUM).alias("similar")), "compared")
            compared = done.select("u", "v") if compared is None else compared.unionByName(done.select("u", "v"))
            kept.append(at)
            found, folder = stored(_joined(found, done.filter("similar").select("u", "v")), "components")
        drop_written(spark, mark, but=(*kept, folder or ""))
    drop_written(spark, first, but=folder)
    return found


def _grouped(docs: DataFrame, doc_id: str, text: str, k: int, hot: int) -> DataFrame:
    """doc_id, key, n_shingles, root, component_id for each row of docs; root is null without words."""
    small_batches(docs.sparkSession)
    kind, first = dict(docs.dtypes)[doc_id], n_written()
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), row_key(doc_id, text).alias("key"), F.xxhash64(text).alias("node"), F.make_valid_utf8(F.col(text)).alias("text"))
    made = written(rows.mapInArrow(functools.partial(_text_rows, k), f"doc_id {kind}, key string, node long, n long, sketch binary, wide binary, heads binary, rests binary"), "signatures")
    nodes, nodes_at = stored(made.select("node", "n", "sketch", "wide", "heads", "rests").dropDuplicates(["node"]), "nodes")
    made, narrow = stored(made.select("doc_id", "key", "node", "n"), "rows")
    drop_written(docs.sparkSession, first, but=(narrow, nodes_at))
    found, folder = stored(similar_components(docs, nodes, text, k, hot), "components")
    drop_written(docs.sparkSession, first, but=(narrow, folder))
    of_node = made.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("c"))
    shared = of_node.join(found, "node", "left").filter("c > 1 or root is not null").select("node", "least", F.coalesce("root", "node").alias("root"))
    shared = written(shared, "shared")
    least = shared.groupBy("root").agg(F.min("least").alias("component_id"))
    whole = shared.join(least, "root").select("node", "root", "component_id", F.lit(True).alias("shared"))
    joined = made.select("doc_id", "key", "node", F.col("n").alias("n_shingles")).join(whole, "node", "left")
    return joined.select("doc_id", "key", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("root", "node")).alias("root"), F.when(F.col("shared"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles (set size), component_id (the smallest doc_id reachable by links) and kept (that of the smallest) for each row of docs."""
    rows = _grouped(docs, doc_id, text, k, hot)
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE) -> DataFrame:
    """One row of each component stays, that with the smallest id, and all texts without words; the columns of docs."""
    rows = _grouped(docs, doc_id, text, k, HOT).select(F.col("doc_id").alias("id"), "key", "root")
    return one_of_each(docs, rows, doc_id, text)


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: set size, component and decision of each document."""
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
