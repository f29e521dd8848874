"""Exact dedup: Patricia-trie owners.

Texts are equal when identical after deleting the six ASCII white-space characters. Each scan task inserts its
normalised byte strings into a compressed radix trie; a terminal node numbers its string and keeps the smallest
identifier (most code points in the original text first, then smallest doc_id) and the count. A stretch of a scan task
passes on one row per distinct string, so a text that holds a third of the table is one row per stretch before any
shuffle. These rows are dealt by length and content hash; each partition inserts all its byte strings into one trie,
whose terminal nodes keep the smallest identifier of all and the numbers that the string has had. A trie that outgrows
its memory spills by subtree: the largest branch under the root goes to a file of the task, is replayed alone below the
prefix that its strings share, and spills again if it has to. What terminal nodes know goes back to the rows by their
strings' numbers; a number has at most ``TRIE_KEYS`` rows, however large its class. Digests are an output, not a key.

The rows and their numbers are written to the shared folder first, so that both sides see the same numbers when a task
runs again.

Defined results: bytes that are no UTF-8 count as U+FFFD, and come back so; null texts count as empty; texts that normalise to nothing are equal to each other; ids may be of any
type that has an order; null doc_ids sort after all others; rows that repeat both doc_id and text are one document and
carry the same ``kept`` (``drop_duplicates`` leaves one of them); an empty table gives an empty result; further columns
are kept as they are, those that clash with the added names are replaced (``drop_duplicates`` adds none).
"""

from __future__ import annotations

import array
import functools
import hashlib
import pickle
import tempfile

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from docjobs.llm.common import SPACES, columns, small_batches, valid, written

#: Estimated bytes that a trie holds before it passes rows on (scan side) or spills a subtree (dealt side).
TRIE_BYTES = 16 << 20
#: Rows after which a scan task passes on what its trie holds.
TRIE_KEYS = 20_000
#: Estimated bytes of a node beside its label.
NODE_BYTES = 300
#: Bytes of keys that are written to a spill file, or passed on, at once.
CHUNK = 1 << 20

ADDED = ("keep_id", "group_size", "kept", "text_sha256")


def shared_prefix(a: bytes, b: bytes) -> int:
    """How many bytes a and b have in common at their beginning."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class _Node:
    __slots__ = ("edges", "value")

    def __init__(self):
        self.edges: dict[int, list] = {}  # first byte -> [label, node]
        self.value = None


class PatriciaTrie:
    """A compressed radix trie over byte strings; merge() combines what is inserted at the same string."""

    def __init__(self, merge):
        self.root, self.merge, self.bytes, self.under = _Node(), merge, 0, {}

    def _grow(self, branch: int, size: int) -> None:
        self.bytes += size
        self.under[branch] = self.under.get(branch, 0) + size

    def insert(self, key: bytes, value):
        """The value at key, after value is merged into it."""
        node, at, n = self.root, 0, len(key)
        while at < n:
            edge = node.edges.get(key[at])
            if edge is None:
                edge = node.edges[key[at]] = [key[at:], _Node()]
                self._grow(key[0], n - at + NODE_BYTES)
                node = edge[1]
                break
            label = edge[0]
            if key.startswith(label, at):
                node, at = edge[1], at + len(label)
                continue
            common = shared_prefix(label, key[at : at + len(label)])
            middle = _Node()
            middle.edges[label[common]] = [label[common:], edge[1]]
            node.edges[key[at]] = [label[:common], middle]
            self._grow(key[0], NODE_BYTES)
            node, at = middle, at + common
        node.value = value if node.value is None else self.merge(node.value, value)
        return node.value

    def items(self, branch: int | None = None):
        """All strings with their values, or those of one branch under the root."""
        if branch is None and self.root.value is not None:
            yield b"", self.root.value
        stack = [(b"", e) for b, e in self.root.edges.items() if branch is None or b == branch]
        while stack:
            prefix, (label, node) = stack.pop()
            key = prefix + label
            if node.value is not None:
                yield key, node.value
            stack.extend((key, e) for e in node.edges.values())

    def cut(self, branch: int) -> None:
        """Takes a branch under the root out of the trie."""
        self.bytes -= self.under.pop(branch)
        del self.root.edges[branch]


class SpillingTrie:
    """A trie whose memory is bounded by ``limit`` (estimated), the longest string and a chunk.

    Subtrees go to files by their first byte. Each is replayed alone: the prefix that its strings share is taken off, so
    it parts into at least two branches, and it spills again if it is over the limit.
    """

    def __init__(self, merge, limit: int = TRIE_BYTES):
        self.trie, self.merge, self.limit, self.files, self.spills, self.peak = PatriciaTrie(merge), merge, limit, {}, 0, 0

    def insert(self, key: bytes, value) -> None:
        self.trie.insert(key, value)
        self.peak = max(self.peak, self.trie.bytes)
        while self.trie.bytes > self.limit and self.trie.under:
            self._spill(max(self.trie.under, key=self.trie.under.get))

    def _spill(self, branch: int) -> None:
        if branch not in self.files:
            self.files[branch] = tempfile.TemporaryFile()
        held, rows = 0, []
        for k, v in self.trie.items(branch):
            rows.append((k, v))
            held += len(k)
            if held > CHUNK:
                pickle.dump(rows, self.files[branch], protocol=5)
                held, rows = 0, []
        pickle.dump(rows, self.files[branch], protocol=5)
        self.trie.cut(branch)
        self.spills += 1

    def _close(self) -> list:
        """What is in memory of branches that have files follows them there."""
        for branch in self.files.keys() & self.trie.under.keys():
            self._spill(branch)
        return list(self.files.values())

    def items(self):
        """All strings with their values, once."""
        waiting = [(b"", f) for f in self._close()]
        yield from self.trie.items()
        while waiting:
            prefix, f = waiting.pop()
            common = None
            for k, _ in _replayed(f):
                common = k if common is None else common[: shared_prefix(common, k)]
            part = SpillingTrie(self.merge, self.limit)
            for k, v in _replayed(f):
                part.insert(k[len(common) :], v)
            f.close()
            prefix += common
            waiting += [(prefix, g) for g in part._close()]
            self.spills += part.spills
            self.peak = max(self.peak, part.peak)
            for k, v in part.trie.items():
                yield prefix + k, v


def _replayed(f):
    f.seek(0)
    while True:
        try:
            yield from pickle.load(f)
        except EOFError:
            return


def _merge(a: tuple, b: tuple) -> tuple:
    """(numbers of the string, rows, order of the owner)"""
    a[0].extend(b[0])
    return a[0], a[1] + b[1], min(a[2], b[2])


def _merge_numbered(a: tuple, b: tuple) -> tuple:
    """(number, rows, order of the owner); the number is that of the first."""
    return a[0], a[1] + b[1], min(a[2], b[2])


def _order(points: int, doc_id, row: int) -> tuple:
    return -points, doc_id is None, 0 if doc_id is None else doc_id, row


def _numbered_rows(doc_id: str, keep_text: bool, memory: int, names: list[str]):
    """One row per document with its string's number; and one per distinct string of (a stretch of) the task."""
    kinds = {"row": pa.int64(), "number": pa.int64(), "points": pa.int64(), "sha": pa.string(), "body": pa.binary(), "n": pa.int64(), "n_bytes": pa.int64(), "h": pa.int64()}

    def rows(batches):
        row = number = TaskContext.get().partitionId() << 33
        trie, keys, rest_type = PatriciaTrie(_merge_numbered), 0, None

        def batch_of(size: int, **given) -> pa.RecordBatch:
            own = kinds | {"text": pa.string(), "rest": rest_type, "id": id_type}
            return pa.RecordBatch.from_arrays([x if isinstance(x := given.get(c), pa.Array) else pa.nulls(size, own[c]) if x is None else pa.array(x, own[c]) for c in names], names=names)

        def classes():
            held, out = 0, []
            for body, v in trie.items():
                out.append((body, *v))
                held += len(body)
                if held > CHUNK or len(out) >= 4096:
                    yield class_batch(out)
                    held, out = 0, []
            if out:
                yield class_batch(out)

        def class_batch(found) -> pa.RecordBatch:
            body, no, n, order = zip(*found)
            ids = [None if o[1] else o[2] for o in order]
            return batch_of(len(found), number=no, n=n, points=[-o[0] for o in order], id=ids, row=[o[3] for o in order], body=body, n_bytes=list(map(len, body)), h=[xxhash.xxh64_intdigest(x) - (1 << 63) for x in body])

        for batch in batches:
            rest = batch.column(1)
            ids = rest.field(doc_id)
            rest_type, id_type = rest.type, ids.type
            rows_, numbers, points, shas = [], [], [], []
            for text, own in zip(batch.column(0).to_pylist(), ids.to_pylist()):
                body = (text or "").encode().translate(None, SPACES.encode())
                size = len(text or "")
                no = trie.insert(body, (number, 1, _order(size, own, row)))[0]
                number += no == number
                rows_.append(row)
                numbers.append(no)
                points.append(size)
                shas.append(hashlib.sha256(body).hexdigest())
                row += 1
            yield batch_of(batch.num_rows, text=batch.column(0) if keep_text else None, rest=rest, row=rows_, number=numbers, points=points, sha=shas)
            keys += batch.num_rows
            if trie.bytes > memory or keys > TRIE_KEYS:
                yield from classes()
                trie, keys = PatriciaTrie(_merge_numbered), 0
        if keys:
            yield from classes()

    return rows


def _owner_rows(memory: int, batches):
    """All strings of a partition go into one trie; each of a string's numbers gets its owner, if it has others beside it."""
    trie, id_type = SpillingTrie(_merge, memory), None
    for batch in batches:
        id_type = batch.column(4).type
        for body, no, n, points, doc_id, row in zip(*(c.to_pylist() for c in batch.columns)):
            trie.insert(body, (array.array("q", [no]), n, _order(points, doc_id, row)))

    def out(found) -> pa.RecordBatch:
        no, n, order = zip(*found)
        names = ["number", "group_size", "keep_points", "keep_id", "keep_row"]
        return pa.RecordBatch.from_arrays([pa.array(no, pa.int64()), pa.array(n, pa.int64()), pa.array([-o[0] for o in order], pa.int64()), pa.array([None if o[1] else o[2] for o in order], id_type), pa.array([o[3] for o in order], pa.int64())], names=names)

    found = []
    for _, (numbers, n, order) in trie.items():
        if n > 1:
            found += [(no, n, order) for no in numbers]
            if len(found) >= 4096:
                yield out(found)
                found = []
    if found:
        yield out(found)


def _numbered(docs: DataFrame, doc_id: str, text: str, keep_text: bool, memory: int) -> tuple[DataFrame, DataFrame]:
    """The rows of docs with their strings' numbers; and number, group_size, keep_points, keep_id, keep_row of shared strings."""
    small_batches(docs.sparkSession)
    given = docs.select(valid(text).alias("text"), F.struct(*columns(docs, text)).alias("rest"))
    rest = given.schema["rest"].dataType
    long, id_type = LongType(), rest[doc_id].dataType
    fields = [("text", StringType()), ("rest", rest), ("row", long), ("number", long), ("points", long), ("sha", StringType()), ("body", BinaryType()), ("n", long), ("id", id_type), ("n_bytes", long), ("h", long)]
    table = written(given.mapInArrow(_numbered_rows(doc_id, keep_text, memory, [n for n, _ in fields]), StructType([StructField(n, t) for n, t in fields])), "numbered")
    dealt = table.filter("body is not null").repartition("n_bytes", "h").select("body", "number", "n", "points", "id", "row")
    shape = StructType([StructField(n, t) for n, t in (("number", long), ("group_size", long), ("keep_points", long), ("keep_id", id_type), ("keep_row", long))])
    return table.filter("rest is not null").select("text", "rest", "row", "number", "points", "sha"), dealt.mapInArrow(functools.partial(_owner_rows, memory), shape)


def assign_owners(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_text: bool = True, memory: int = TRIE_BYTES) -> DataFrame:
    """All columns of docs (the text if asked for) plus keep_id, group_size, kept and text_sha256; memory bounds each trie."""
    rows, owners = _numbered(docs, doc_id, text, keep_text, memory)
    own, shared = F.col("rest")[doc_id], F.col("keep_row").isNotNull()
    kept = ~shared | (F.col("keep_id").eqNullSafe(own) & (F.col("keep_points") == F.col("points")))
    added = [F.when(shared, F.col("keep_id")).otherwise(own).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256")]
    given = [F.col("text").alias(c) if c == text else F.col("rest")[c].alias(c) for c in docs.columns if c not in ADDED and (keep_text or c != text)]
    return rows.join(owners, "number", "left").select(*given, *added)


def drop_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", memory: int = TRIE_BYTES) -> DataFrame:
    """The documents that stay, with all columns of docs; exactly one row of each class."""
    rows, owners = _numbered(docs, doc_id, text, True, memory)
    dropped = written(rows.select("number", "row").join(owners, "number").filter("row <> keep_row").select("row"), "dropped")
    kept = rows.join(dropped, "row", "left_anti")  # dropped is sent to the texts if Spark finds it small
    return kept.select(*(F.col("text").alias(c) if c == text else F.col("rest")[c].alias(c) for c in docs.columns))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: a row for each document, dropped ones too."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return assign_owners(docs, keep_text=False).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE_SQL = """
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]', '', 'g') AS norm FROM documents
), g AS (
  SELECT norm, count(*) AS group_size, (min(struct_pack(p := -points, i := doc_id))).i AS keep_id FROM n GROUP BY norm
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g USING (norm)
"""
