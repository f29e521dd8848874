"""SimHash near-dedup: generalised pigeonhole.

Each text gets a 64-bit fingerprint of its word shingles. Two fingerprints link at ``radius`` or fewer differing bits;
classes are connected components of links. The work is on distinct fingerprints:

* The bits are grouped so that correlated ones share a partition. Thresholds T_i with sum(T_i + 1) = radius + 1 then
  cover every link: two fingerprints that differ in at most T_i bits of partition i, for some i, are candidates, and
  by the pigeonhole principle each link is one. Dynamic programming chooses the thresholds (and among partitionings)
  that minimise the estimated candidates and probes, from the bits' agreement over all fingerprints.
* A probe is the partition's value with up to T_i set bits cleared: two values that differ in at most T_i bits meet at
  their common bits. Probes are dealt by key; fingerprints with equal keys are compared and links verified on all 64
  bits. Each key's links are reduced to a spanning forest there, so a dense group of near copies makes as many rows as
  it has members, not pairs.
* A key with more than ``HOT_KEY`` fingerprints is dealt again by its other bits: a link differs in at most ``radius``
  of them, so it agrees in one of radius + 1 pieces. This repeats until no key is hot; no link is lost.
* Components come from alternating large-star and small-star steps on Spark, each written to the shared folder.

Defined results: null and empty texts, and texts of white space, have fingerprint zero and are linked like any other;
texts of fewer words than a shingle have one shingle; bytes that are no UTF-8 count as U+FFFD; rows that repeat are evaluated each; a null doc_id is never the
smallest of a component unless all are null; ``near_dedup`` keeps exactly one row of each component, of equal ids one by
a hash of the text; empty tables give empty results.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docjobs.llm.common import drop, drop_written, n_written, one_of_each, row_key, small_batches, stored, valid, written

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Fingerprints that one key may bring together before it is dealt again by other bits.
HOT_KEY = 20_000
#: Relative cost of a probe row (shuffled, sorted) and of comparing two fingerprints, in microseconds.
ROW_COST, PAIR_COST = 3.0, 0.02

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: str | None, k: int = SHINGLE) -> list[int]:
    """XXH64 of each word shingle of one text, repeats included; a text without words has none."""
    words = (text or "").encode().translate(_LOWER).split()  # on the six ASCII white-space characters
    line, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return [h(line, SEED)] if words else []
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    first = end - size
    return [h(line[a:b], SEED) for a, b in zip(first[: 1 - k].tolist(), end[k - 1 :].tolist())]


def majority(hashes) -> int:
    """The SimHash of hashes, unsigned: a bit is 1 if it is set in over half of them."""
    bits = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 1 << 16):
        raw = np.array(hashes[part : part + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(raw, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """The SimHash of one text; zero without words."""
    return majority(shingle_hashes(text, k))


def _fingerprint_rows(k: int, batches):
    for batch in batches:
        fps = np.array([fingerprint(t, k) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), batch.column(2)], names=["doc_id", "fp", "key"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE) -> DataFrame:
    """doc_id, fp (signed 64-bit), key (id and a hash of the text, for joins back to docs)."""
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select(F.col(doc_id).alias("doc_id"), valid(text).alias("text"), row_key(doc_id, text).alias("key"))
    return rows.mapInArrow(functools.partial(_fingerprint_rows, k), f"doc_id {kind}, fp long, key string")


def _bit_rows(batches):
    """How often each two bits are set together, 64 rows per task."""
    total = np.zeros((64, 64), np.int64)
    for batch in batches:
        raw = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8)
        x = np.unpackbits(raw, axis=1, bitorder="little").astype(np.float32)
        total += (x.T @ x).astype(np.int64)
    yield pa.RecordBatch.from_pydict({"i": pa.array(range(64), pa.int32()), "together": pa.array(total.tolist(), pa.list_(pa.int64()))})


def bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and the 64 x 64 counts of bits set together, over all of them."""
    rows = nodes.select("fp").mapInArrow(_bit_rows, "i int, together array<long>")
    flat = rows.select("i", F.posexplode("together").alias("j", "n")).groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    together = np.zeros((64, 64))
    for r in flat:  # 4096 rows whatever the input
        together[r["i"], r["j"]] = r["n"]
    return nodes.count(), together


def group_bits(n: int, together: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of nearly equal size; each grows by the bit most correlated with those it has."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    free, out = list(range(64)), []
    for part in range(m):
        size = 64 // m + (part < 64 % m)
        own = [max(free, key=lambda b: (corr[b, free].sum(), -b))]
        free.remove(own[0])
        while len(own) < size:
            own.append(max(free, key=lambda b: (corr[b, own].sum(), -b)))
            free.remove(own[-1])
        out.append(sorted(own))
    return out


def near_share(n: int, together: np.ndarray, bits: list[int], most: int) -> list[float]:
    """For t = 0..most, the estimated share of pairs that differ in at most t of these bits.

    The bits' chances to differ are taken from the corpus; correlation makes them worth fewer bits.
    """
    p = np.diag(together) / max(n, 1)
    c = together[np.ix_(bits, bits)] / max(n, 1) - np.outer(p[bits], p[bits])
    spread = np.sqrt(np.maximum(p[bits] * (1 - p[bits]), 1e-9))
    corr = np.abs(c / np.outer(spread, spread))
    worth = 1 / (1 + max(0.0, (corr.sum() - len(bits)) / len(bits)))
    chance = np.zeros(len(bits) + 1)
    chance[0] = 1
    for d in (2 * p * (1 - p))[bits]:
        chance[1:] = chance[1:] * (1 - d) + chance[:-1] * d
        chance[0] *= 1 - d
    return [float(min(1.0, x)) ** worth for x in np.cumsum(chance)[: most + 1]]


def allocate(n: int, together: np.ndarray, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """[(bits of a partition, its threshold)], the cheapest of all covers by two or more partitions."""
    best = None
    for m in range(2, radius + 2):
        parts = group_bits(n, together, m)
        table = {0: (0.0, [])}
        for bits in parts:
            share = near_share(n, together, bits, radius)
            ones = sum((np.diag(together) / max(n, 1))[bits])
            after: dict = {}
            for spent, (cost, chosen) in table.items():
                for t in range(-1, radius):
                    left = radius + 1 - spent - (t + 1)
                    if left < 0:
                        continue
                    probes = sum(np.prod([max(ones - i, 1) / (i + 1) for i in range(j)]) for j in range(t + 1))
                    more = n * probes * ROW_COST + n * n / 2 * share[t] * PAIR_COST if t >= 0 else 0.0
                    new = (cost + more, [*chosen, t])
                    if spent + t + 1 not in after or new < after[spent + t + 1]:
                        after[spent + t + 1] = new
            table = after
        if radius + 1 in table and (best is None or table[radius + 1][0] < best[0]):
            best = (table[radius + 1][0], list(zip(parts, table[radius + 1][1])))
    return [(bits, t) for bits, t in best[1] if t >= 0]


def _mask(bits) -> int:
    return sum(1 << b for b in bits)


def _probe_batch(free, key, fp) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x).view(np.int64)) for x in (free, key, fp)], names=["free", "key", "fp"])


def _probe_rows(plan, batches):
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for bits, threshold in plan:
            own = np.uint64(_mask(bits))
            for cleared in itertools.chain.from_iterable(itertools.combinations(bits, j) for j in range(threshold + 1)):
                gone = np.uint64(_mask(cleared))
                has = fp[(fp & gone) == gone]
                if len(has):
                    yield _probe_batch(np.full(len(has), ~own), has & own & ~gone, has)


def _dealt_again(pieces, batches):
    """Probe rows of hot keys, keyed by one more piece of their free bits."""
    mix = np.uint64(0x9E3779B97F4A7C15)
    for batch in batches:
        free, key, fp = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(3))
        for f in np.unique(free):
            at = free == f
            left = [b for b in range(64) if int(f) >> b & 1]
            for piece in np.array_split(left, min(pieces, max(1, len(left)))):
                m = np.uint64(_mask(piece.tolist()))
                with np.errstate(over="ignore"):
                    k = (key[at] ^ (key[at] >> np.uint64(32)) ^ (m * mix)) * mix + (fp[at] & m)
                    k ^= k >> np.uint64(29)
                    k *= mix
                yield _probe_batch(np.full(at.sum(), f & ~m), k, fp[at])


def forest(runs: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys (runs numbers them, ascending), as few as join what they join."""
    n = len(fp)
    last = np.searchsorted(runs, runs, "right")
    root, a, b = np.arange(n), [], []

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    lag, active = 1, np.flatnonzero(last - np.arange(n) > 1)
    while len(active):
        near = active[np.bitwise_count(fp[active] ^ fp[active + lag]) <= radius]
        near = near[root[near] != root[near + lag]]
        for i in near.tolist():
            x, y = find(i), find(i + lag)
            if x != y:
                root[max(x, y)] = min(x, y)
                a.append(i)
                b.append(i + lag)
        if len(near):
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
        lag += 1
        active = active[last[active] - active > lag]
    return fp[a], fp[b]


def _link_rows(radius, batches):
    """Rows come sorted by (free, key); a run of equal keys may span batches."""

    def links(free, key, fp, closed: bool):
        new = np.concatenate(([True], (free[1:] != free[:-1]) | (key[1:] != key[:-1])))
        end = len(fp) if closed else int(np.flatnonzero(new)[-1])
        runs = np.cumsum(new)
        paired = np.zeros(len(fp), bool)
        paired[1:] = ~new[1:]
        paired[:-1] |= ~new[1:]
        own = np.flatnonzero(paired[:end])
        x, y = forest(runs[own], fp[own], radius)
        ok = x != y
        return (free[end:], key[end:], fp[end:]), pa.RecordBatch.from_arrays([pa.array(np.maximum(x.view(np.int64), y.view(np.int64))[ok]), pa.array(np.minimum(x.view(np.int64), y.view(np.int64))[ok])], names=["u", "v"])

    held, waiting, size = None, [], 0
    for batch in batches:
        waiting.append([batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(3)])
        size += batch.num_rows
        if size >= 1 << 18:
            held, out = links(*(np.concatenate(x) for x in zip(*([held] if held else []), *waiting)), False)
            waiting, size = [], 0
            yield out
    if held or waiting:
        columns = [np.concatenate(x) for x in zip(*([held] if held else []), *waiting)]
        if len(columns[0]):
            yield links(*columns, True)[1]


def links(nodes: DataFrame, radius: int = RADIUS, hot: int = HOT_KEY) -> DataFrame:
    """u, v: links between distinct fingerprints, enough to connect all that are connected."""
    n, together = bit_statistics(nodes)
    plan = allocate(n, together, radius)
    shape = "free long, key long, fp long"
    rows = nodes.select("fp").mapInArrow(functools.partial(_probe_rows, plan), shape)
    ready = None
    for _ in range(64):
        large = rows.groupBy("free", "key").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("free", "key")
        large = written(large, "hot-keys")
        none = large.isEmpty()
        cool = rows if none else rows.join(large, ["free", "key"], "left_anti").select("free", "key", "fp")
        ready = cool if ready is None else ready.unionByName(cool)
        if none:
            break
        again = rows.join(large, ["free", "key"]).select("free", "key", "fp").filter("free <> 0")
        rows = written(again.mapInArrow(functools.partial(_dealt_again, radius + 1), shape), "dealt-again")
    dealt = ready.repartition("free", "key").sortWithinPartitions("free", "key", "fp")
    return dealt.mapInArrow(functools.partial(_link_rows, radius), "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for each node of edges (u, v); by large-star and small-star."""

    def star(pairs: DataFrame) -> DataFrame:
        """Links each u's larger neighbours and itself to its smallest neighbour."""
        least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return pairs.join(least, "u")

    def mark(pairs: DataFrame) -> tuple:
        r = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(r)

    edges, folder = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    before = mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = star(large)
        small = small.select("u", F.col("m").alias("v")).unionByName(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        old = folder
        edges, folder = stored(small.filter("u <> v").distinct(), "edges")
        drop(edges.sparkSession, old)
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _grouped(docs: DataFrame, doc_id: str, text: str, k: int, radius: int, hot: int) -> DataFrame:
    """doc_id, key, fp, root (the smallest fingerprint of the component) and component_id for each row of docs."""
    rows = written(fingerprints(docs, doc_id, text, k), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    first = n_written()
    found, folder = stored(components(links(nodes, radius, hot)), "components")
    drop_written(docs.sparkSession, first, but=folder)
    joined = nodes.join(found, nodes["fp"] == found["node"], "left").filter("n > 1 or root is not null").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    shared = joined.join(least, "root").select("fp", "root", "component_id", F.lit(True).alias("shared"))
    return rows.join(shared, "fp", "left").select("doc_id", "key", "fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("shared"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE, radius: int = RADIUS, hot: int = HOT_KEY) -> DataFrame:
    """doc_id, key, fp, component_id (the smallest doc_id reachable by links) for each row of docs."""
    return _grouped(docs, doc_id, text, k, radius, hot).drop("root")


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of each component stays, that with the smallest id; the columns of docs."""
    rows = _grouped(docs, doc_id, text, k, radius, HOT_KEY).select(F.col("doc_id").alias("id"), "key", "root")
    return one_of_each(docs, rows, doc_id, text)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: fingerprint and component of each document."""
    found = classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
