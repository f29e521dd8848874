"""A Merkle manifest of a dataset: a tree for each group of rows, a tree over the groups, and a proof for each row.

A row's leaf is the SHA-256 of its fields, each told apart by its length. In a group, leaves ascend by the order column;
every ``ARITY`` consecutive nodes (fewer at the end, even one) become their hash, until one is left, the group's subroot.
Subroots, ordered by group, become the root likewise. A row's proof lists the other nodes of its run, level by level.

* Leaves are hashed where they are read, and only ids and hashes are sorted by range, so that a group of any size spreads
  over tasks. The sorted RDD is checkpointed, which fixes its partitions.
* Only the first and the last group of a partition can go on in another one. Their counts, two rows for each partition,
  are all that the driver sees; their prefix sums give each partition its place in these groups.
* Each task then builds all subtrees that lie wholly inside it and are aligned to the group's places, at most
  ``LOCAL`` levels high, and emits the tops of these alone. The ragged ones at its edges are shuffled by their coordinate
  (group, level, number), and the upper levels are finished level by level, each an eighth of the one below.
* Proofs come back down the upper levels, and join the rows at the top of their local subtree.

Defined results: null groups are a group of their own, the first; null fields count as ``-``; null orders come first; rows of
equal order are ordered by leaf; rows that repeat have leaves of their own; one row alone is its subroot; an empty table
gives an empty result. Columns of any name may be among the fields. Texts that are not UTF-8 are hashed as their bytes.
"""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docjobs.llm.common import checkpoint_dir, written

ARITY = 8
#: Levels that a task builds by itself; it holds ARITY ** LOCAL leaves at a time.
LOCAL = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(*fields: Column) -> Column:
    """The SHA-256 (32 bytes) of fields: - for null, else byte count, colon and value."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def digest(nodes) -> bytes:
    """The hash of nodes, which go in as hexadecimal text."""
    return hashlib.sha256(b"".join(nodes).hex().encode()).digest()


def run_of(place: int, n: int) -> tuple[int, int]:
    """Start and size of the run that a node is in, on a level of n nodes."""
    start = place // ARITY * ARITY
    return start, min(ARITY, n - start)


def up(n: int) -> int:
    return -(-n // ARITY)


def fold(own: bytes, place: int, n: int, proof: bytes, at: int = 0) -> tuple[bytes, int]:
    """The top of a tree of n leaves, from one leaf and its proof (from byte ``at`` on), and where the proof ends."""
    while n > 1:
        start, size = run_of(place, n)
        others = [proof[at + 32 * i : at + 32 * (i + 1)] for i in range(size - 1)]
        others.insert(place - start, own)
        own, at, place, n = digest(others), at + 32 * (size - 1), place // ARITY, up(n)
    return own, at


def subtrees(leaves: list[bytes], first: int, n: int, local: int = LOCAL) -> list[tuple[int, list[bytes]]]:
    """The levels (number of their first node, nodes) that leaves from place ``first`` on make by themselves, in a group of n."""
    levels, size = [(first, leaves)], n
    while size > 1 and len(levels) <= local:
        low, nodes = levels[-1]
        end = low + len(nodes)
        lo, hi = up(low), up(end) if end == size else end // ARITY
        if lo >= hi:
            break
        levels.append((lo, [digest(nodes[ARITY * j - low : min(ARITY * (j + 1), end) - low]) for j in range(lo, hi)]))
        size = up(size)
    return levels


def maximal(levels) -> list[tuple[int, int]]:
    """(level, number) of the nodes whose parent is not among levels."""
    out = []
    for h, (low, nodes) in enumerate(levels):
        above, n_above = (levels[h + 1][0], len(levels[h + 1][1])) if h + 1 < len(levels) else (0, 0)
        out += [(h, i) for i in range(low, low + len(nodes)) if not above <= i // ARITY < above + n_above]
    return out


def local_proofs(levels) -> list[tuple[int, int, bytes]]:
    """For each leaf, the (level, number) of its top node among levels, and its proof up to there."""
    tops = {}
    for h in range(len(levels) - 1, -1, -1):
        low, nodes = levels[h]
        below, above = {}, levels[h + 1] if h + 1 < len(levels) else (0, [])
        for i in range(low, low + len(nodes)):
            j = i // ARITY
            if above[0] <= j < above[0] + len(above[1]):
                start = j * ARITY - low
                run = nodes[start : start + ARITY]
                level, top, proof = tops[j]
                below[i] = (level, top, b"".join(run[: i - low - start] + run[i - low - start + 1 :]) + proof)
            else:
                below[i] = (h, i, b"")
        tops = below
    return list(tops.values())


def _runs(batches):
    """(group, rows of one group as a table) over a partition's sorted batches; a group may come in several pieces."""
    for batch in batches:
        groups = batch.column(0).to_pylist()
        start = 0
        for i in range(1, len(groups) + 1):
            if i == len(groups) or groups[i] != groups[start]:
                yield groups[start], batch.slice(start, i - start)
                start = i


def _edge_rows(batches):
    """The counts of the first and of the last group of a partition."""
    first, last = None, None
    for group, rows in _runs(batches):
        if last is not None and last[0] == group:
            last[1] += rows.num_rows
        else:
            first, last = first or last, [group, rows.num_rows]
    if last is not None:
        found = [(0, first or last)] + ([(1, last)] if first else [])
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part] * len(found), pa.int32()), "at": pa.array([a for a, _ in found], pa.int32()), "g": [x[0] for _, x in found], "n": pa.array([x[1] for _, x in found], pa.int64())})


def places(edges: list[tuple[int, int, str, int]]) -> dict[int, dict[str, tuple[int, int]]]:
    """For each partition, the place of its first row in its first and last group, and the rows of that group, from (partition, at, group, rows)."""
    total, offset = {}, {}
    for part, _, group, n in sorted(edges):
        offset.setdefault(part, {})[group] = total.get(group, 0)
        total[group] = total.get(group, 0) + n
    return {part: {g: (o, total[g]) for g, o in own.items()} for part, own in offset.items()}


def _pieces(known, local, batches):
    """(group, place of the first row, rows of the group, rows) in pieces that end where a local subtree of full height does."""
    own, most = known.get(TaskContext.get().partitionId(), {}), ARITY**local
    group, at, held, size = None, 0, [], 0

    def piece(last: bool):
        nonlocal at, held, size
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        start, at, held, size = at, at + size, [], 0
        # a group that is not an edge of the partition ends with it; before its end, its size is only known to be larger
        n = own[group][1] if group in own else at if last else at + most
        return group, start, n, rows

    for g, rows in _runs(batches):
        if g != group or group is None:
            if held:
                yield piece(True)
            group, at = g, own.get(g, (0, 0))[0]
        while rows.num_rows:
            if size and (at + size) % most == 0:
                yield piece(False)
            take = min(rows.num_rows, most - (at + size) % most)
            held.append(rows.slice(0, take))
            size += take
            rows = rows.slice(take)
    if held:
        yield piece(True)


def _node_rows(known, local, batches):
    for group, first, n, rows in _pieces(known, local, batches):
        levels = subtrees(rows.column(1).to_pylist(), first, n, local)
        tops = maximal(levels)
        yield pa.RecordBatch.from_pydict({
            "g": [group] * len(tops), "level": pa.array([h for h, _ in tops], pa.int32()), "i": pa.array([i for _, i in tops], pa.int64()),
            "hash": pa.array([levels[h][1][i - levels[h][0]] for h, i in tops], pa.binary()),
        })


def _leaf_rows(known, local, batches):
    for group, first, n, rows in _pieces(known, local, batches):
        found = local_proofs(subtrees(rows.column(1).to_pylist(), first, n, local))
        yield pa.RecordBatch.from_arrays(
            [
                rows.column(0), rows.column(1), rows.column(2), pa.array(range(first, first + len(found)), pa.int64()),
                pa.array([h for h, _, _ in found], pa.int32()), pa.array([i for _, i, _ in found], pa.int64()), pa.array([p for _, _, p in found], pa.binary()),
            ],
            names=["g", "leaf", "row", "place", "level", "i", "local"],
        )


def _hash_of(children: Column) -> Column:
    return F.unhex(F.sha2(F.array_join(F.transform(children, lambda c: F.lower(F.hex(c["hash"]))), "").cast("binary"), 256))


def _upper_proofs(nodes: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (g, level, i, hash), counts (g, n) -> g, level, i, proof of each node up to its subroot; and g, n, hash of the subroots.

    Works up level by level: the runs of a level meet by (g, number of the parent), ARITY nodes each; then down again.
    """
    nodes = nodes.join(counts, "g")
    height, n = 0, counts.agg(F.max("n")).first()[0] or 1
    while n > 1:  # of the tallest group
        height, n = height + 1, up(n)
    shape = ("g", "i", "n", "hash")
    size = lambda h: F.floor((F.col("n") + (ARITY**h - 1)) / ARITY**h)
    level, runs, roots = nodes.filter("level = 0").select(*shape), [], []
    for h in range(height + 1):
        roots.append(level.filter(size(h) == 1).select("g", F.lit(h).alias("level"), "n", "hash"))
        if h < height:
            meet = level.filter(size(h) > 1).groupBy("g", "n", F.floor(F.col("i") / ARITY).alias("i")).agg(F.array_sort(F.collect_list(F.struct("i", "hash"))).alias("children"))
            runs.append(written(meet.select("g", "i", "n", _hash_of(F.col("children")).alias("hash"), "children"), "level"))
            level = runs[-1].select(*shape).unionByName(nodes.filter(F.col("level") == h + 1).select(*shape))
    subroots = written(functools.reduce(DataFrame.unionByName, roots), "subroots")
    proofs, above = [subroots.select("g", "level", F.lit(0).cast("long").alias("i"), F.lit(b"").alias("proof"))], None
    for h in range(height - 1, -1, -1):
        run = runs[h].select("g", "i", "children")
        run = run.withColumn("proof", F.lit(b"")) if above is None else run.join(above.select("g", "i", "proof"), ["g", "i"], "left").withColumn("proof", F.coalesce("proof", F.lit(b"")))
        child = run.select("g", F.explode("children").alias("c"), "children", "proof")
        others = F.aggregate(F.filter("children", lambda x: x["i"] != F.col("c.i")), F.lit(b""), lambda a, x: F.concat(a, x["hash"]))
        above = written(child.select("g", F.lit(h).alias("level"), F.col("c.i").alias("i"), F.concat(others, "proof").alias("proof")), "proofs")
        proofs.append(above)
    return functools.reduce(DataFrame.unionByName, proofs), subroots.select("g", "n", "hash")


def trees(rows: DataFrame, local: int = LOCAL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows (g, o, leaf, row), g a string that is never null -> three tables.

    The leaves (g, leaf, row, place, level, i, local: the proof up to node i of that level), the proofs of such nodes up to
    the subroot (g, level, i, proof), and the subroots (g, n, hash).
    """
    checkpoint_dir(rows.sparkSession)
    tied = rows.withColumn("tie", F.monotonically_increasing_id())  # rows that are alike spread too
    ordered = tied.repartitionByRange("g", "o", "leaf", "tie").sortWithinPartitions("g", "o", "leaf", "tie").select("g", "leaf", "row").checkpoint()
    edges = ordered.select("g").mapInArrow(_edge_rows, "part int, at int, g string, n long").collect()  # two for each partition
    known = places([tuple(r) for r in edges])
    nodes = written(ordered.select("g", "leaf").mapInArrow(functools.partial(_node_rows, known, local), "g string, level int, i long, hash binary"), "nodes")
    proofs, subroots = _upper_proofs(nodes, written(ordered.groupBy("g").agg(F.count("*").alias("n")), "groups"))
    leaves = ordered.mapInArrow(functools.partial(_leaf_rows, known, local), f"g string, leaf binary, row {dict(ordered.dtypes)['row']}, place long, level int, i long, local binary")
    return leaves, proofs, subroots


def manifest(docs: DataFrame, group: str = "lang", order: str = "doc_id", fields: tuple[str, ...] = FIELDS, keep: tuple[Column, ...] = (), local: int = LOCAL) -> DataFrame:
    """One row for each of docs: row (a struct of the order column and of keep), leaf, subroot, root, and the proof.

    ``proof`` has the other nodes of each run, 32 bytes each, from the leaf up; place and n tell the leaf's place among the
    n of its group, group_place and groups the same of its group. ``fold`` takes them back to the root.
    """
    g = F.coalesce(F.concat(F.lit("+"), F.col(f"`{group}`").cast("string")), F.lit(""))  # null first
    own = F.struct(F.col(f"`{order}`").alias(order), *keep)
    rows = docs.select(g.alias("g"), F.col(f"`{order}`").alias("o"), leaf(*(F.col(f"`{f}`") for f in fields)).alias("leaf"), own.alias("row"))
    leaves, proofs, subroots = trees(rows, local)
    tops, top_proofs, top = trees(subroots.select(F.lit("").alias("g"), F.col("g").alias("o"), F.col("hash").alias("leaf"), F.struct("g", "n").alias("row")), local)
    root = top.first()
    groups = tops.withColumnsRenamed({"leaf": "subroot"}).join(top_proofs, ["g", "level", "i"]).select(F.col("row.g").alias("g"), F.col("row.n").alias("n"), "subroot", F.col("place").alias("group_place"), F.concat("local", "proof").alias("last"))
    ends = proofs.join(groups, "g").withColumn("proof", F.concat("proof", "last")).drop("last")
    whole = leaves.join(ends, ["g", "level", "i"])
    return whole.select(
        "row", "leaf", "subroot", F.lit(bytes(root["hash"]) if root else None).cast("binary").alias("root"), F.concat("local", "proof").alias("proof"), "place", "n", "group_place", F.lit(root["n"] if root else 0).cast("long").alias("groups"),
    )


def _fold_rows(batches):
    for batch in batches:
        names = ("leaf", "altered", "proof", "place", "n", "group_place", "groups")
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names]
        sha, roots = [], []
        for own, altered, proof, place, n, group_place, groups in zip(*columns):
            top, at = fold(altered or own, place, n, proof)
            roots.append(fold(top, group_place, groups, proof, at)[0].hex())
            sha.append(hashlib.sha256(proof.hex().encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in ("id", "leaf", "subroot", "root")), pa.array(sha, pa.string()), pa.array(roots, pa.string())], names=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root"])


def folded(found: DataFrame, id_col: str = "doc_id", altered: str = "altered") -> DataFrame:
    """The rows of ``manifest``, whose row has an altered leaf (or null), with digests as hexadecimal text, proof_sha256, folded_root and verified."""
    flat = found.select(F.col(f"row.{id_col}").alias("id"), F.col(f"row.{altered}").alias("altered"), *(c for c in found.columns if c != "row"))
    out = flat.mapInArrow(_fold_rows, f"id {dict(flat.dtypes)['id']}, leaf binary, subroot binary, root binary, proof_sha256 string, folded_root string")
    text = [F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root")]
    return out.select(F.col("id").alias(id_col), *text, "proof_sha256", "folded_root").withColumn("verified", F.col("folded_root") == F.col("root"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tampered(docs: DataFrame, local: int = LOCAL) -> DataFrame:
    """``folded`` manifest of docs; where 3 divides the CRC-32 of the decimal doc_id, with the leaf of a text in lower case."""
    altered = leaf(*(F.translate("text", UPPER, LOWER) if f == "text" else F.col(f) for f in FIELDS))
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return folded(manifest(docs, keep=(F.when(hit, altered).alias("altered"),), local=local))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: leaf, subroot, root and proof of each document, and whether rows of which a third are tampered with still lead to the root."""
    return tampered(spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS))


def _crc_table() -> list[int]:
    """The remainders of all bytes, by the polynomial of CRC-32."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def oracle_sql(levels: int = 7) -> str:
    """DuckDB SQL for the same rows, for groups of up to 8 ** levels documents and as many groups."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf_of = lambda text: "sha256(" + " || ".join(field(text if f == "text" else f) for f in FIELDS) + ")"
    crc = f"xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ord(ch)::BIGINT), lambda a, b: xor(a >> 8, ({_crc_table()})[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"
    parts = [
        f"leaves AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lang, {leaf_of('text')} AS leaf, CASE WHEN ({crc}) % 3 = 0 THEN {leaf_of(f"translate(text, '{UPPER}', '{LOWER}')")} END AS altered FROM documents)",
        "a0 AS MATERIALIZED (SELECT coalesce('+' || lang, '') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, r, leaf AS h, coalesce(altered, leaf) AS f, '' AS p FROM leaves)",
    ]

    def climb(rows: str, tag: str) -> str:
        """rows (g, i, r, h, f, p) -> one row for each r with the subroot h, the folded f and the proof p."""
        at = rows
        for k in range(levels):
            parts.append(f"{tag}n{k} AS MATERIALIZED (SELECT DISTINCT g, i, h, count(*) OVER (PARTITION BY g) AS size FROM (SELECT DISTINCT g, i, h FROM {at}))")
            parts.append(f"{tag}u{k} AS MATERIALIZED (SELECT g, i // {ARITY} AS j, list(h ORDER BY i) AS hs, any_value(size) AS size FROM {tag}n{k} GROUP BY g, i // {ARITY})")
            place = f"a.i % {ARITY}"
            parts.append(f"""{tag}{k + 1} AS MATERIALIZED (SELECT a.g, a.i // {ARITY} AS i, a.r, CASE WHEN u.size = 1 THEN a.h ELSE sha256(array_to_string(u.hs, '')) END AS h,
              CASE WHEN u.size = 1 THEN a.f ELSE sha256(array_to_string(u.hs[1:{place}], '') || a.f || array_to_string(u.hs[{place} + 2:], '')) END AS f,
              CASE WHEN u.size = 1 THEN a.p ELSE a.p || array_to_string(u.hs[1:{place}], '') || array_to_string(u.hs[{place} + 2:], '') END AS p
              FROM {at} a JOIN {tag}u{k} u ON u.g = a.g AND u.j = a.i // {ARITY})""")
            at = f"{tag}{k + 1}"
        return at

    groups = climb("a0", "b")
    parts += [
        f"ranked AS MATERIALIZED (SELECT g, row_number() OVER (ORDER BY g) - 1 AS i FROM (SELECT DISTINCT g FROM {groups}))",
        f"t0 AS MATERIALIZED (SELECT '' AS g, ranked.i, x.r, x.h, x.f, x.p FROM {groups} x JOIN ranked USING (g))",
    ]
    top = climb("t0", "c")
    return "WITH " + ",\n".join(parts) + f"""
SELECT l.doc_id, l.leaf, s.h AS subroot, x.h AS root, sha256(x.p) AS proof_sha256, x.f AS folded_root, x.f = x.h AS verified
FROM leaves l JOIN {top} x USING (r) JOIN {groups} s USING (r)
"""


ORACLE_SQL = oracle_sql()
