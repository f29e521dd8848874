"""SimHash near-dedup as a stage of the pipeline: SimHash with verified links, then all that fingerprints can't reach.

Two documents link at a Jaccard similarity of ``NUM / DEN`` or more of their sets of five-word shingles; classes are
connected components of links. Every such pair is found, none by chance:

* First SimHash by generalised pigeonhole (``simhash.links``) on the 64-bit fingerprints of the same shingles: its links,
  verified on the whole sets, join the closest copies, and large groups of them, without bringing them together again.
* Fingerprints of similar documents differ in up to 15 bits (see the README), beyond the radius of any selective probe.
  So prefixes complete the search. Shingles have one order for all documents: those of crowded buckets come last, by how
  many shingles of all documents fall on their bucket (a hash), the others by hash. Sets of n shingles that reach the
  threshold share one of their first n - ceil(n * NUM / DEN) + 1 (the prefix). The counts decide only how many candidates
  there are, as the argument holds for any order.
* Prefixes are dealt by shingle, and shingles of one document are dropped. Documents that meet are candidates unless
  they are joined already, or their sizes, the place where they meet or their parity sketches exclude the threshold (a
  shingle flips its bit: sketches can't differ in more bits than the sets differ in shingles).
* Candidates are compared on their whole sets by joins. The first round compares, for each shingle, as many as join
  what may be similar, so that a dense group makes about as many rows as it has members. The next rounds compare growing
  parts, by a hash of the pair, of the candidates whose documents are in different components by then, and the last round
  all that are left: components that many similar pairs would join are joined by the few in an early part. No candidate
  is left out.

Defined results: bytes that are no UTF-8 count as U+FFFD; words are separated by the six ASCII white-space characters and A to Z are lower-cased, as in
``simhash``; texts of fewer words than a shingle have one shingle, texts without words the empty one, so they are alike;
shingles and texts are told apart by 64-bit hashes. Exactly one row of each component stays: that with the smallest
doc_id, null last, and of equal ids one by a hash of the text. An empty table gives an empty result; columns of any name
are kept.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docjobs.llm import simhash
from docjobs.llm.common import drop_written, n_written, one_of_each, row_key, small_batches, stored, valid, written

SHINGLE, NUM, DEN = 5, 4, 5
#: Buckets that shingles are counted in, and how far above the mean (in its square root, and at least) a crowded one is.
BUCKETS, ABOVE, LEAST_COMMON = 1 << 20, 5, 4
#: The parts of the candidates that one round after the other compares, as bounds of the pairs' hashes.
PARTS = (0.0, 1 / 256, 1 / 16, 1.0)
#: Rows of (shingle, document) that a task pairs at once.
PAIRED = 1 << 18

_SKETCH = [f"s{i}" for i in range(4)]


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """The hashes of the text's different shingles, ascending; of a text without words that of the empty shingle."""
    return np.unique(np.array(simhash.shingle_hashes(text, k) or [xxhash.xxh64_intdigest(b"", simhash.SEED)], np.uint64))


def sketch(own: np.ndarray) -> np.ndarray:
    """256 bits, each the parity of the shingles that fall on it."""
    odd = np.bincount((own >> np.uint64(40) & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def wide_sketch(own: np.ndarray) -> bytes:
    """As ``sketch``, of at least two bits for each shingle; the halves of a wider one fold into a narrower one."""
    width = 1 << max(8, (2 * len(own) - 1).bit_length())
    return np.packbits((np.bincount((own & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).astype(np.uint8), bitorder="little").tobytes()


def may_be_similar(a: bytes, b: bytes, both: int) -> bool:
    """Whether sets of these wide sketches, of so many shingles together, may reach the threshold."""
    x, y = sorted((np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64)) * (DEN + NUM) <= (DEN - NUM) * both


def buckets(own: np.ndarray) -> np.ndarray:
    return own >> np.uint64(44)


def prefix(own: np.ndarray, common: np.ndarray, rank: np.ndarray, of=None) -> np.ndarray:
    """The shingles of which a similar set must hold one: the first of the order (common ascending, rank beside it; with of, common has what it gives for a shingle)."""
    late = np.zeros(len(own), np.int64)
    if len(common):
        key = own if of is None else of(own)
        at = np.minimum(np.searchsorted(common, key), len(common) - 1)
        late = np.where(common[at] == key, rank[at] + 1, 0)
    n = len(own)
    return own[np.lexsort((own, late))[: n - (n * NUM + DEN - 1) // DEN + 1]]


def _signed(x) -> pa.Array:
    return pa.array(np.ascontiguousarray(x, np.uint64).view(np.int64))


def _bucket_rows(k, batches):
    counts = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for t in batch.column(0).to_pylist():
            np.add.at(counts, buckets(shingles(t, k)).astype(np.int64), 1)
    full = np.flatnonzero(counts)
    for at in range(0, len(full), 1 << 16):
        some = full[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some])], names=["bucket", "n"])


def crowded_buckets(docs: DataFrame, text: str = "text", k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (ascending) on which many shingles of all documents fall, and their ranks by that number.

    Every document counts. A task adds its own up, so a few bytes for each task and bucket are moved whatever it reads.
    """
    counts = docs.select(valid(text).alias("text")).mapInArrow(functools.partial(_bucket_rows, k), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = written(counts, "bucket-counts")
    mean = (counts.agg(F.sum("n")).first()[0] or 0) / BUCKETS
    top = counts.filter(F.col("n") >= max(LEAST_COMMON, mean + ABOVE * mean**0.5)).orderBy("bucket").toArrow()  # some of BUCKETS rows
    n = top.column("n").to_numpy()
    return top.column("bucket").to_numpy().astype(np.uint64), np.argsort(np.argsort(n, kind="stable"), kind="stable")


def _node_rows(k, common, rank, batches):
    for batch in batches:
        sets = [shingles(t, k) for t in batch.column(1).to_pylist()]
        sketches = np.array([sketch(own) for own in sets], np.uint64).reshape(-1, 4)
        first = [prefix(own, common, rank, buckets).view(np.int64) for own in sets]
        fp = _signed([simhash.majority(own) for own in sets])
        yield pa.RecordBatch.from_arrays([batch.column(0), fp, pa.array(map(len, sets), pa.int64()), *map(_signed, sketches.T), pa.array(first, pa.list_(pa.int64())), pa.array(map(wide_sketch, sets), pa.binary())], names=["node", "fp", "n", *_SKETCH, "prefix", "wide"])


def _set_rows(k, batches):
    for batch in batches:
        for node, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = _signed(shingles(t, k))
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([own.to_pylist()], pa.list_(pa.int64()))], names=["node", "own"])


def _whole_runs(batches):
    """Columns of rows sorted by the first, cut where it changes, about ``PAIRED`` rows at a time."""
    waiting, size = [], 0
    for batch in batches:
        waiting.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)])
        size += batch.num_rows
        if size >= PAIRED:
            columns = [np.concatenate(x) for x in zip(*waiting)]
            end = int(np.searchsorted(columns[0], columns[0][-1]))
            if end:
                yield [c[:end] for c in columns]
            waiting, size = [[c[end:] for c in columns]], 0
    if waiting:
        yield [np.concatenate(x) for x in zip(*waiting)]


def _shared_rows(batches):
    """Rows whose shingle is in the prefix of another document too."""
    for shingle, node, pos in _whole_runs(batches):
        first = np.ones(len(node), bool)
        first[1:] = (shingle[1:] != shingle[:-1]) | (node[1:] != node[:-1])
        shingle, node, pos = shingle[first], node[first], pos[first]
        again = shingle[1:] == shingle[:-1]
        ok = np.zeros(len(node), bool)
        ok[1:] |= again
        ok[:-1] |= again
        yield pa.RecordBatch.from_arrays([pa.array(shingle[ok]), pa.array(node[ok]), pa.array(pos[ok])], names=["shingle", "node", "pos"])


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number from 0 to 1 for each unordered pair of documents."""
    x, y = (f(a, b).view(np.uint64) for f in (np.maximum, np.minimum))
    with np.errstate(over="ignore"):
        h = (x ^ (y >> np.uint64(31)) ^ (y << np.uint64(33))) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def candidates(run: np.ndarray, n: np.ndarray, pos: np.ndarray, root: np.ndarray, sketches: list[np.ndarray], few: bool, node: np.ndarray | None = None, part: tuple[float, float] = (0.0, 1.0)):
    """Yields (positions, positions) of rows of equal run and different root that may be similar.

    Rows are sorted by run, and by n in a run; pos is the shingle's place in its set's order. Similar sets meet at the first
    shingle that they share, behind which both must hold all that they have to share. With few, only as many as join what all of them join;
    with part, only pairs of nodes whose hash lies in it.
    """
    _, label = np.unique(root, return_inverse=True)
    own = np.arange(label.max() + 1 if len(label) else 0)
    last, starts = np.searchsorted(run, run, "right"), np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    which = np.cumsum(np.concatenate(([True], run[1:] != run[:-1]))) - 1

    def find(i):
        while own[i] != i:
            own[i] = own[own[i]]
            i = own[i]
        return i

    lag, active = 1, np.flatnonzero(last - np.arange(len(run)) > 1)
    while len(active):
        if lag & (lag - 1) == 0:  # runs that are joined already need no further look
            now = own[label]
            open_ = np.minimum.reduceat(now, starts) != np.maximum.reduceat(now, starts)
            active = active[open_[which[active]]]
        there = active + lag
        apart = own[label[active]] != own[label[there]]
        a, b = active[apart], there[apart]
        differ = sum(np.bitwise_count(s[a] ^ s[b]).astype(np.int64) for s in sketches)
        may = differ * (DEN + NUM) <= (DEN - NUM) * (n[a] + n[b])
        may &= np.minimum(n[a] - pos[a], n[b] - pos[b]) * (DEN + NUM) >= NUM * (n[a] + n[b])
        a, b = a[may], b[may]
        if part != (0.0, 1.0) and len(a):
            h = pair_hash(node[a], node[b])
            own_part = (part[0] <= h) & (h < part[1])
            a, b = a[own_part], b[own_part]
        if few and len(a):
            taken = []
            for i, (x, y) in enumerate(zip(label[a].tolist(), label[b].tolist())):
                x, y = find(x), find(y)
                if x != y:
                    own[max(x, y)] = min(x, y)
                    taken.append(i)
            a, b = a[taken], b[taken]
            while True:
                up = own[own]
                if (up == own).all():
                    break
                own[:] = up
        if len(a):
            yield a, b
        lag += 1
        active = active[last[active] - active > lag]
        active = active[n[active] * DEN >= n[active + lag] * NUM]


def _pair_rows(few, part, batches):
    for shingle, node, n, pos, root, *sketches in _whole_runs(batches):
        for a, b in candidates(shingle, n, pos, root, [s.view(np.uint64) for s in sketches], few, node, part):
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(node[a], node[b])), pa.array(np.minimum(node[a], node[b]))], names=["u", "v"])


def _similar_rows(batches):
    for batch in batches:
        u, v, *rest = (c.to_pylist() for c in batch.columns)
        ok = pa.array([may_be_similar(a, b, both) for a, b, both in zip(*rest)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["u", "v"])


def _close_pairs(nodes: DataFrame, radius: int) -> DataFrame:
    """u, v: texts of equal fingerprints or of linked ones, enough to connect all that SimHash connects."""
    first = written(nodes.groupBy("fp").agg(F.min("node").alias("first")), "fingerprints")
    linked = simhash.links(first.select("fp"), radius)
    at = lambda c: first.select(F.col("fp").alias(c), F.col("first").alias(f"of_{c}"))
    between = linked.join(at("u"), "u").join(at("v"), "v").select(F.col("of_u").alias("u"), F.col("of_v").alias("v"))
    within = nodes.join(first, "fp").filter("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    return between.unionByName(within).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def _joined(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """The components found (node, root), and what pairs (u, v) join to them or among them: only the roots are joined anew."""
    ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    members = found.unionByName(ends.join(found, "node", "left_anti").select("node", F.col("node").alias("root")))
    for end in ("u", "v"):
        of = members.select(F.col("node").alias(end), F.col("root").alias(f"of_{end}"))
        pairs = pairs.join(of, end)
    up = simhash.components(pairs.select(F.col("of_u").alias("u"), F.col("of_v").alias("v"))).select(F.col("node").alias("root"), F.col("root").alias("up"))
    return members.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"))


def similar_components(docs: DataFrame, text: str = "text", k: int = SHINGLE, radius: int = simhash.RADIUS) -> DataFrame:
    """node (``xxhash64`` of a text), root (the smallest node of its component) for each text that is similar to another."""
    spark, first = docs.sparkSession, n_written()
    small_batches(spark)
    texts = docs.select(F.xxhash64(text).alias("node"), valid(text).alias("text"))
    shape = f"node long, fp long, n long, {', '.join(f'{s} long' for s in _SKETCH)}, prefix array<long>, wide binary"
    nodes = written(texts.mapInArrow(functools.partial(_node_rows, k, *crowded_buckets(docs, text, k)), shape), "nodes")
    if not nodes.groupBy("node").count().filter("count > 1").isEmpty():
        texts, nodes = texts.dropDuplicates(["node"]), written(nodes.dropDuplicates(["node"]), "nodes")
    found, folder = spark.createDataFrame([], "node long, root long"), None
    compared, kept = None, []

    def compare(pairs: DataFrame) -> None:
        """Adds the pairs that are similar, and the components that they make; drops all else that it has written."""
        nonlocal compared, found, folder
        mark = n_written()
        pairs = written(pairs if compared is None else pairs.join(compared.select("u", "v"), ["u", "v"], "left_anti"), "met-pairs")
        for at, name in (("u", "a"), ("v", "b")):
            pairs = pairs.join(nodes.select(F.col("node").alias(at), F.col("n").alias(f"n{name}"), F.col("wide").alias(name)), at)
        pairs = written(pairs.select("u", "v", "a", "b", F.col("na") + F.col("nb")).mapInArrow(_similar_rows, "u long, v long"), "candidates")
        if not pairs.isEmpty():
            asked = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
            sets = written(texts.join(asked, "node", "left_semi").mapInArrow(functools.partial(_set_rows, k), "node long, own array<long>"), "sets")
            both = pairs.join(sets.select(F.col("node").alias("u"), F.col("own").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("own").alias("b")), "v")
            same = F.size(F.array_intersect("a", "b"))
            done, at = stored(both.select("u", "v", (same * (DEN + NUM) >= (F.size("a") + F.size("b")) * NUM).alias("similar")), "compared")
            compared = done if compared is None else compared.unionByName(done)
            kept.append(at)
            found, folder = stored(_joined(found, done.filter("similar").select("u", "v")), "components")
        drop_written(spark, mark, but=(*kept, folder or ""))

    compare(_close_pairs(nodes, radius))
    mark = n_written()
    dealt = nodes.select(F.posexplode("prefix").alias("pos", "shingle"), "node").select("shingle", "node", F.col("pos").cast("long").alias("pos")).repartition("shingle").sortWithinPartitions("shingle", "node")
    shared = written(dealt.mapInArrow(_shared_rows, "shingle long, node long, pos long"), "shared-shingles")
    met, at = stored(shared.join(nodes.select("node", "n", *_SKETCH), "node").select("shingle", "node", "n", "pos", *_SKETCH), "met")
    drop_written(spark, mark, but=at)
    for few, part in ((True, (0.0, 1.0)), *((False, part) for part in zip(PARTS, PARTS[1:]))):
        rows = met.join(found, "node", "left").select("shingle", "node", "n", "pos", F.coalesce("root", "node").alias("root"), *_SKETCH)
        rows = rows.repartition("shingle").sortWithinPartitions("shingle", "n", "root", "node")
        compare(rows.mapInArrow(functools.partial(_pair_rows, few, part), "u long, v long").distinct())
    drop_written(spark, first, but=folder)
    return found


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE) -> DataFrame:
    """One row of each component stays, that with the smallest id; the columns of docs."""
    found = similar_components(docs, text, k)
    rows = docs.select(F.col(doc_id).alias("id"), row_key(doc_id, text).alias("key"), F.xxhash64(text).alias("node"))
    rows = written(rows.join(found, "node", "left").select("id", "key", F.coalesce("root", "node").alias("root")), "classes")
    return one_of_each(docs, rows, doc_id, text)
