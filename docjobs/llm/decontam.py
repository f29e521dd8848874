"""Benchmark decontamination: prefix-filtered set join.

A window is ``size`` consecutive words of a benchmark item (a shorter item is one window). One pass over the documents
finds the runs of words all of whose shingles may occur in the benchmark (a bit table of the benchmark's shingles, of
bounded size, lets others fall; what it lets through wrongly is refuted later). On the runs, the rest is joins of small
tables: shingles are counted over the whole corpus and ordered by rarity; containing a window means containing each of
its shingles, so its necessary prefix is its rarest shingle alone; windows join the runs on that shingle; length and
position bounds drop candidates that would reach over a run's edge; and the words of the window and of the document
are compared exactly. Occurrences become covered words per document by an ordered sweep.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. Null and empty texts have no words and are
never hit; null or empty items give no window; repeated items and repeated documents are each evaluated; an item whose
item_id is null is found like any other, but is not named in the list; empty tables give no hits. Further columns of
either table are not looked at, and ``decontaminate`` keeps those of the documents whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docjobs.llm.common import keyed, row_key, small_batches, without, written

WINDOW, SHINGLE = 10, 5
#: The bit table has at least 64 bits a shingle and this many at most (16 MB); beyond, it only filters less.
MAX_TABLE_BITS = 1 << 27
_MIX, _ROLL, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), 0x100000001B3

_FOLD = np.zeros(256, np.uint8)
for _b in range(256):
    if _b >= 0x80 or 48 <= _b <= 57 or 97 <= _b <= 122:
        _FOLD[_b] = _b
    elif 65 <= _b <= 90:
        _FOLD[_b] = _b + 32

#: Bytes of text that are looked at together, and the powers that a worker keeps; a longer text makes its own for a while.
CHUNK = 1 << 19
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    global _powers
    if len(_powers[0]) >= n:
        return _powers
    with np.errstate(over="ignore"):
        out = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(max(n, 2 * CHUNK), b, np.uint64)
            x[0] = 1
            out.append(np.cumprod(x, dtype=np.uint64))
    if n <= 2 * CHUNK:
        _powers = tuple(out)
    return tuple(out)


def _chunks(batch):
    """Slices of a batch whose texts (its second column) have about CHUNK bytes, or one text."""
    size = [len(x) if x else 0 for x in batch.column(1).to_pylist()]
    first, held = 0, 0
    for i, n in enumerate(size):
        if held and held + n > CHUNK:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    yield batch.slice(first)


class Words:
    """The words of a batch of texts: where they stand in its bytes, of which text they are, and a hash of each."""

    def __init__(self, texts: list[bytes]):
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.bytes = _FOLD[raw]
        inside = np.concatenate(([False], self.bytes != 0))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edge[0::2], edge[1::2]
        first = np.cumsum(size + 1) - (size + 1)
        self.doc = np.searchsorted(first, self.start, "right") - 1
        self.first = np.searchsorted(self.start, first)
        self.count = np.diff(np.append(self.first, len(self.start)))
        with np.errstate(over="ignore"):
            power, inverse = _power(len(raw))
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.bytes * power[: len(raw)], dtype=np.uint64)))
            h = (sums[self.end] - sums[self.start]) * inverse[self.start]
            h ^= h >> np.uint64(31)
            self.hash = h * _MIX

    def shingles(self, k: int) -> np.ndarray:
        """A hash of the k words from each word on; 0 where the text ends before."""
        n, out = len(self.start), np.zeros(len(self.start), np.uint64)
        if n >= k:
            with np.errstate(over="ignore"):
                h = np.zeros(n - k + 1, np.uint64)
                for j in range(k):
                    h = h * _ROLL + self.hash[j : n - k + 1 + j]
                h ^= h >> np.uint64(29)
                h *= _MIX
            out[: n - k + 1] = np.where(self.doc[: n - k + 1] == self.doc[k - 1 :], h, 0)
        return out

    def text(self, a: int, b: int) -> str:
        """Words a to b (of one text), separated by spaces."""
        piece = self.bytes[self.start[a] : self.end[b - 1]].tobytes()
        return piece.replace(b"\0", b" ").decode() if b"\0\0" not in piece else b" ".join(piece.replace(b"\0", b" ").split()).decode()


def _blob(column) -> list[bytes]:
    return [x or b"" for x in column.to_pylist()]


def _window_rows(size: int, k: int):
    def rows(batches):
        for batch in batches:
            ids, w = batch.column(0), Words(_blob(batch.column(1)))
            at, item, words, length = [], [], [], []
            for d, (a, n) in enumerate(zip(w.first.tolist(), w.count.tolist())):
                m = min(size, n)
                for i in range(a, a + n - m + 1) if n else ():
                    item.append(ids[d].as_py())
                    words.append(w.text(i, i + m))
                    length.append(m)
            yield pa.RecordBatch.from_pydict({"item_id": pa.array(item, ids.type), "window": pa.array(words, pa.string()), "size": pa.array(length, pa.int32())})

    return rows


def benchmark_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """item_id, window (its words, separated by spaces), size: each window of each item."""
    kind = dict(items.dtypes)[item_id]
    return items.select(F.col(item_id).alias("item_id"), F.col(text).cast("binary").alias("text")).mapInArrow(_window_rows(size, SHINGLE), f"item_id {kind}, window string, size int")


def _shingles(words, n: int, first=0):
    """Shingles of n words with their offsets, from an array of words."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.struct((i + first).alias("i"), F.array_join(F.slice(words, i + 1, n), " ").alias("shingle"))))


def _table_rows(sizes: list[int], bits: int):
    """64-bit pieces of the bit table with the shingles of windows set: a shingle's place is its hash's upper bits."""

    def rows(batches):
        for batch in batches:
            texts = [x.encode() for x in batch.column(0).to_pylist()]
            w, length = Words(texts), np.asarray(batch.column(1).to_pylist(), np.int64)
            found = [np.empty(0, np.uint64)]
            for k in sizes:
                h = w.shingles(k)
                found.append(h[(h != 0) & (np.minimum(length[w.doc], SHINGLE) == k)])
            slot = np.concatenate(found) >> np.uint64(64 - bits)
            piece, at = np.unique(slot >> np.uint64(6), return_inverse=True)
            own = np.zeros(len(piece), np.uint64)
            np.bitwise_or.at(own, at, np.uint64(1) << (slot & np.uint64(63)))
            yield pa.RecordBatch.from_pydict({"piece": pa.array(piece.astype(np.int64)), "bits": pa.array(own.view(np.int64))})

    return rows


def _bit_table(windows: DataFrame, sizes: list[int], bits: int) -> bytes:
    """The bit table: pieces are united on Spark, and the driver takes each of at most ``MAX_TABLE_BITS / 64`` once."""
    rows = windows.select("window", "size").distinct().mapInArrow(_table_rows(sizes, bits), "piece long, bits long")
    united = rows.groupBy("piece").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), "<u8")
    table[united.column("piece").to_numpy()] = united.column("bits").to_numpy().view(np.uint64)
    return table.tobytes()


def _run_rows(table, bits: int, needed: dict[int, int]):
    """For each document its number of words and the runs of words that the bit table lets through."""
    shift = np.uint64(64 - bits)

    def rows(batches):
        known = np.frombuffer(table.value, np.uint8)
        for batch in (part for whole in batches for part in _chunks(whole)):
            w = Words(_blob(batch.column(1)))
            hit = np.zeros(len(w.start) + 1, np.int32)
            for k, need in needed.items():
                h = w.shingles(k)
                slot = (h >> shift).astype(np.int64)
                ok = (h != 0) & ((known[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(bool)
                edge = np.flatnonzero(np.diff(np.concatenate(([0], (ok & True).view(np.int8), [0]))))
                a, b = edge[0::2], edge[1::2]
                long = b - a >= need
                np.add.at(hit, a[long], 1)
                np.add.at(hit, np.minimum(b[long] + k - 1, len(w.start)), -1)
            covered = np.cumsum(hit[:-1]) > 0
            change = np.flatnonzero(np.diff(np.concatenate(([0], covered.view(np.int8), [0]))))
            runs: list[list] = [[] for _ in range(len(batch.column(1)))]
            for a, b in zip(change[0::2].tolist(), change[1::2].tolist()):
                cuts = [a, *(np.flatnonzero(np.diff(w.doc[a:b])) + a + 1).tolist(), b]
                for x, y in zip(cuts, cuts[1:]):
                    d = int(w.doc[x])
                    runs[d].append({"first": x - int(w.first[d]), "words": w.text(x, y)})
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "row": batch.column(2), "n_words": pa.array(w.count, pa.int64()), "runs": pa.array(runs, pa.list_(pa.struct([("first", pa.int32()), ("words", pa.string())])))})

    return rows


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Per document: doc_id, row (a number of this run that tells rows apart), n_words, n_hit, n_items, item_ids.

    Also returns the occurrences: row, first (word of the document), size, item_id.
    """
    spark = docs.sparkSession
    small_batches(spark)
    windows = written(benchmark_windows(items, item_id, item_text, size), "windows")
    lengths = {r["size"]: r["n"] for r in windows.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    sizes = sorted({min(n, SHINGLE) for n in lengths}) or [SHINGLE]
    needed = {k: min([n - k + 1 for n in lengths if min(n, SHINGLE) == k], default=1) for k in sizes}
    bits = min(max(1 << 16, 64 * sum(lengths.values())), MAX_TABLE_BITS).bit_length() - 1
    table = _bit_table(windows, sizes, bits)

    kind = dict(docs.dtypes)[doc_id]
    numbered = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"), F.monotonically_increasing_id().alias("row"))
    seen = written(numbered.mapInArrow(_run_rows(spark.sparkContext.broadcast(table), bits, needed), f"doc_id {kind}, row long, n_words long, runs array<struct<first:int,words:string>>"), "runs")

    runs = seen.filter("size(runs) > 0").select("row", F.explode("runs").alias("run")).select("row", F.col("run.first").alias("first"), F.split("run.words", " ").alias("words"))
    reach = size - 1
    probe = None
    for k in sizes:
        at = runs.select("row", "first", "words", F.explode(_shingles(F.col("words"), k)).alias("s"))
        lo = F.greatest(F.col("s.i") - reach, F.lit(0))
        at = at.select("row", F.lit(k).alias("k"), F.col("s.shingle").alias("shingle"), (F.col("first") + lo).alias("begin"), (F.col("s.i") - lo).alias("i"), F.slice("words", lo + 1, reach + k + F.col("s.i") - lo).alias("near"))
        probe = at if probe is None else probe.unionByName(at)
    rarity = probe.groupBy("k", "shingle").agg(F.count("*").alias("freq"))

    distinct = windows.select("window", "size").distinct().withColumn("words", F.split("window", " "))
    parts = None
    for k in sizes:
        p = distinct.filter(F.least(F.col("size"), F.lit(SHINGLE)) == k).select("window", "size", F.lit(k).alias("k"), F.explode(_shingles(F.col("words"), k)).alias("s")).select("window", "size", "k", F.col("s.i").alias("offset"), F.col("s.shingle").alias("shingle"))
        parts = p if parts is None else parts.unionByName(p)
    # a shingle that no run has can't be contained: with it falls its window, hence the left join and the count of 0
    ranked = parts.join(rarity, ["k", "shingle"], "left").groupBy("window", "size").agg(F.min(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "shingle", "offset", "k")).alias("p"))
    prefix = ranked.filter("p.freq > 0").select("window", "size", "p.k", "p.shingle", "p.offset")

    cand = probe.join(prefix, ["k", "shingle"])
    inside = (F.col("offset") <= F.col("i")) & (F.col("i") - F.col("offset") + F.col("size") <= F.size("near"))
    same = F.array_join(F.slice("near", F.col("i") - F.col("offset") + 1, F.col("size")), " ") == F.col("window")
    found = cand.filter(inside).filter(same).select("row", (F.col("begin") + F.col("i") - F.col("offset")).alias("first"), "size", "window")
    found = written(found, "occurrences")

    by_place = Window.partitionBy("row").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("first") + F.col("size")
    places = found.groupBy("row", "first").agg(F.max("size").alias("size"))
    hit = places.withColumn("before", F.max(end).over(by_place)).groupBy("row").agg(F.sum(F.greatest(end - F.greatest("first", F.coalesce("before", F.lit(0))), F.lit(0))).cast("long").alias("n_hit"))
    occurrences = found.join(windows.select("window", "item_id").distinct(), "window").select("row", "first", "size", "item_id")
    named = found.select("row", "window").distinct().join(windows.select("window", "item_id").distinct(), "window").select("row", "item_id").distinct()
    named = named.groupBy("row").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("item_ids"))
    marked = seen.filter("size(runs) > 0").select("doc_id", "row", "n_words").join(hit, "row", "left").join(named, "row", "left")
    columns = ["doc_id", "row", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids")]
    none = F.lit(None)
    clean = seen.filter("size(runs) = 0").select("doc_id", "row", "n_words", none.cast("long").alias("n_hit"), none.cast("long").alias("n_items"), none.cast("array<string>").alias("item_ids"))
    return marked.select(*columns).unionByName(clean.select(*columns)), occurrences


def decontaminate(docs: DataFrame, items: DataFrame, max_hit: float = 0.0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents whose share of hit words is at most max_hit, with the columns of docs.

    A rejected document goes with all rows that repeat its doc_id and text.
    """
    found, _ = contamination(docs.select(row_key(doc_id, text).alias("key"), F.col(text).alias("text")), items, "key")
    bad = found.filter((F.col("n_hit") > 0) & (F.col("n_hit") > max_hit * F.col("n_words"))).select(F.col("doc_id").alias("key"))
    return without(keyed(docs, doc_id, text), bad).select("doc.*")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: each document with the words and items that the benchmark shares with it."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found, _ = contamination(docs, items)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = "regexp_extract_all(regexp_replace(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), '[^ ]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
i AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p + 1 : p + least(len(w), 10)], ' ') AS window
  FROM (SELECT item_id, w, unnest(range(len(w) - least(len(w), 10) + 1)) AS p FROM i WHERE len(w) > 0)
),
spot AS (
  SELECT doc_id, n, p, array_to_string(w[p + 1 : p + n], ' ') AS window
  FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS p FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
),
occ AS (SELECT DISTINCT doc_id, item_id, p, spot.n FROM spot JOIN win ON spot.window = win.window AND spot.n = win.n),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM occ) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
