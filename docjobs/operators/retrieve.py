"""Chunks, fingerprints, the chunk index, nearest neighbours, and the context and history of a chat."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as pads
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docjobs.sources.shared import drop_folder, folder_exists, shared_folder, small_batches

#: Query vectors and index vectors that a task holds at once, and the distances that it computes at once.
QUERY_BLOCK, INDEX_CHUNK, TILE = 4096, 1 << 16, 1 << 22
#: Folders that queries of many sessions are dealt over, and a bound of the error of a distance by matrix product, as a share of the sizes.
QUERY_BUCKETS, ERROR = 64, 1e-12


def chunk_documents(docs: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """docs without text, plus chunk_no, row_id (the same) and text of each chunk; empty texts give none."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    step, n = size - overlap, F.length("text")
    count = F.greatest(F.lit(1), F.ceil((n - overlap) / step))
    starts = F.when(n > 0, F.sequence(F.lit(0).cast("long"), count - 1))
    kept = [c for c in docs.columns if c not in ("text", "chunk_no", "row_id")]
    chunks = docs.select(*kept, "text", F.explode(starts).alias("chunk_no"))
    return chunks.select(*kept, "chunk_no", F.col("chunk_no").cast("string").alias("row_id"), F.substring("text", F.col("chunk_no") * step + 1, F.lit(size)).alias("text"))


def fingerprint(source: Column, file_path: Column, row_id: Column, text: Column) -> Column:
    """source::row_id where a source is known (an empty one is not), else the SHA-256 of the text."""
    where = F.coalesce(F.nullif(source, F.lit("")), file_path)
    return F.when(where.isNotNull(), F.concat(where, F.lit("::"), F.coalesce(row_id, F.lit("")))).otherwise(F.sha2(F.coalesce(text, F.lit("")), 256))


def add_documents(new: DataFrame, index: DataFrame, order: list[str]) -> DataFrame:
    """The rows of new (with fp) to add: the first per fingerprint by order, of those the index lacks.

    min_by combines in the map tasks, so boilerplate with one fingerprint is no hot group.
    """
    row = F.struct(*new.columns)
    first = new.groupBy("fp").agg(F.min_by(row, F.struct(*order)).alias("r")).select("r.*")
    return first.join(index.select("fp"), "fp", "left_anti").select(*new.columns)


def load_or_create(spark: SparkSession, path: str, chunks: DataFrame | None) -> DataFrame:
    """The index at path, written from chunks if there is none."""
    if not folder_exists(spark, path):
        if chunks is None:
            raise ValueError("there is no index and nothing to create one from")
        chunks.write.parquet(path)
    return spark.read.parquet(path)


def embed_chunks(df: DataFrame, fn: Callable[[list[str]], list], text: str = "text") -> DataFrame:
    """df plus embedding, by a user's function from a list of texts to vectors."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([np.asarray(v, np.float32) for v in fn(s.fillna("").tolist())])

    return df.withColumn("embedding", embed(F.col(text)))


def _matrix(column) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def nearest_of(q: np.ndarray, x: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Yields (query, row, squared distance) of the k nearest rows of x to each finite q; of equal distances, the first rows.

    A matrix product of the vectors, moved to the first row, gives bounds of all distances, with an error in proportion to
    the sizes; what the bounds leave is computed exactly, so neither a common offset nor a small scale hides a neighbour.
    """
    whole = np.flatnonzero(np.isfinite(q).all(1))
    q = q[whole]
    qc, xc = q - x[0], x - x[0]
    qq, xx = np.einsum("ij,ij->i", qc, qc), np.einsum("ij,ij->i", xc, xc)
    step = max(1, TILE // len(x))
    for at in range(0, len(q), step):
        part = slice(at, at + step)
        near = qc[part] @ xc.T  # changed in place, so that a task holds one such array, and a copy while it is parted
        near *= -2
        near += qq[part, None] * (1 + ERROR)
        near += xx * (1 + ERROR)
        take = min(k, len(x))
        edge = np.partition(near, take - 1, axis=1)[:, take - 1].copy()
        near -= 2 * ERROR * qq[part, None]
        near -= 2 * ERROR * xx
        i, j = np.nonzero(near <= edge[:, None])
        exact = ((q[at + i] - x[j]) ** 2).cumsum(1)[:, -1]  # summed in order
        order = np.lexsort((j, exact, i))
        i, j, exact = i[order], j[order], exact[order]
        first = np.arange(len(i)) - np.searchsorted(i, i) < k
        yield whole[at + i[first]], j[first], exact[first]


def _nearest(folder: str, k: int):
    """The k nearest rows of each chunk of the index to each query of their part; the window that follows merges chunks and tasks.

    Queries are read block by block from the shared folder, only from the buckets of the parts that the chunk holds, so no
    task or driver holds more than one block of them.
    """

    def blocks(buckets):
        fs, path = pafs.FileSystem.from_uri(folder)
        kind = pads.partitioning(pa.schema([("bucket", pa.int32())]), flavor="hive")
        rows = pads.dataset(path, filesystem=fs, format="parquet", partitioning=kind)
        for batch in rows.to_batches(filter=pads.field("bucket").isin(buckets), batch_size=QUERY_BLOCK, batch_readahead=1, fragment_readahead=1):
            if batch.num_rows:
                yield batch.column("query_id").to_numpy(), _matrix(batch.column("embedding")), batch.column("part").to_pandas()

    def found(held: list):
        table = pa.Table.from_batches(held).sort_by("vec_id").combine_chunks()
        held.clear()  # of a chunk, only its vectors stay while they are compared
        ids, x = table.column("vec_id").to_numpy(), _matrix(table.column("embedding").combine_chunks())
        whole = np.isfinite(x).all(1)
        code, names = pd.factorize(table.column("part").to_pandas(), use_na_sentinel=False)
        code = code[whole]
        order = np.argsort(code, kind="stable")
        at, code = np.flatnonzero(whole)[order], code[order]
        ids, x = ids[at], x[at]
        known = {None if pd.isna(n) else n: c for c, n in enumerate(names)}
        buckets = np.unique(table.column("bucket").to_numpy()).tolist()
        del table
        for asked, q, parts in blocks(buckets):
            part = np.array([known.get(None if pd.isna(p) else p, -1) for p in parts])
            for c in np.unique(part[part >= 0]).tolist():
                lo, hi = np.searchsorted(code, [c, c + 1])
                own = np.flatnonzero(part == c)
                if lo < hi:
                    for i, j, dist in nearest_of(q[own], x[lo:hi], k):
                        yield pa.RecordBatch.from_arrays([pa.array(asked[own[i]]), pa.array(ids[lo + j]), pa.array(dist)], names=["query_id", "vec_id", "dist"])

    def rows(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= INDEX_CHUNK:
                del batch
                yield from found(held)
                n = 0
        if n:
            yield from found(held)

    return rows


def similarity_topk(queries: DataFrame, index: DataFrame, k: int = 5, within: str | None = None) -> DataFrame:
    """queries (query_id, embedding) x index (vec_id, embedding) -> query_id, vec_id, dist, rank.

    Squared L2, ties by vec_id; with ``within``, a column of both tables (such as a session), among the rows that share it
    (a query may stand in several). Any other condition is a filter on the index. The queries are written to the shared
    folder, by buckets of ``within``, and read from there in blocks by the tasks that scan the index, once; what they find, k
    rows per query and chunk, is written before the queries are dropped. Vectors that are null or not finite find nothing
    and are not found.
    """
    spark = queries.sparkSession
    part = F.lit(None).cast("string") if within is None else F.col(within).cast("string")
    bucket = F.lit(0) if within is None else F.pmod(F.xxhash64("part"), F.lit(QUERY_BUCKETS)).cast("int")
    narrow = lambda df, key: df.filter(F.col("embedding").isNotNull()).select(F.col(key).cast("long").alias(key), "embedding", part.alias("part")).withColumn("bucket", bucket)
    folder, near = shared_folder(spark, "queries"), shared_folder(spark, "near")
    asked = narrow(queries, "query_id")
    (asked if within is None else asked.repartition("bucket", F.pmod(F.xxhash64("query_id"), F.lit(8)))).write.partitionBy("bucket").parquet(folder)
    narrow(index, "vec_id").mapInArrow(_nearest(folder, k), "query_id long, vec_id long, dist double").write.parquet(near)
    drop_folder(spark, folder)
    order = Window.partitionBy("query_id").orderBy("dist", "vec_id")
    return spark.read.schema("query_id long, vec_id long, dist double").parquet(near).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def relevance(dist: Column) -> Column:
    """1 for equal vectors, falling with the squared distance."""
    return 1 - dist / F.sqrt(F.lit(2.0))


def _diverse(k: int, weight: float):
    """Places of k candidates: each time the one with the best balance of nearness to the query and distance from those chosen."""

    @F.pandas_udf("array<int>")
    def choose(query: pd.Series, candidates: pd.Series) -> pd.Series:
        out = []
        for q, c in zip(query, candidates):
            x = np.array(list(map(np.asarray, c)), np.float64)
            unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-300)
            x, near = unit(x), unit(x) @ unit(np.asarray(q, np.float64))
            chosen, like = [int(np.argmax(near))], np.full(len(x), -np.inf)
            while len(chosen) < min(k, len(x)):
                like = np.maximum(like, x @ x[chosen[-1]])
                gain = (weight * near - (1 - weight) * like).round(12)
                gain[chosen] = -np.inf
                chosen.append(int(np.argmax(gain)))
            out.append(chosen)
        return pd.Series(out)

    return choose


def retrieve(queries: DataFrame, index: DataFrame, search_type: str = "similarity", k: int = 5, score_threshold: float = 0.0, fetch_k: int = 20, lambda_mult: float = 0.5, within: str | None = None) -> DataFrame:
    """query_id, vec_id, dist, rank by one of three kinds of search.

    ``similarity``: the k nearest. ``similarity_score_threshold``: those of them whose ``relevance`` reaches the threshold.
    ``mmr``: k of the fetch_k nearest by maximal marginal relevance, with lambda_mult the weight of nearness (by cosine);
    rank is the order in which they were chosen.
    """
    if search_type == "similarity":
        return similarity_topk(queries, index, k, within)
    if search_type == "similarity_score_threshold":
        return similarity_topk(queries, index, k, within).filter(relevance(F.col("dist")) >= score_threshold)
    if search_type != "mmr":
        raise ValueError(f"unknown search type {search_type}")
    small_batches(queries.sparkSession)  # a row has fetch_k vectors
    near = similarity_topk(queries, index, fetch_k, within)
    vectors = index.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").alias("asked"))
    rows = near.join(vectors, "vec_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "dist", "embedding"))).alias("c"))  # fetch_k a query
    chosen = rows.join(asked, "query_id").select("query_id", "c", F.posexplode(_diverse(k, lambda_mult)("asked", "c.embedding")).alias("at", "place"))
    hit = F.get("c", F.col("place"))
    return chosen.select("query_id", hit["vec_id"].alias("vec_id"), hit["dist"].alias("dist"), (F.col("at") + 1).alias("rank"))


def assemble_context(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """hits (query_id, vec_id, rank) with texts (vec_id, text) -> query_id, context: hit texts in rank order."""
    joined = hits.join(texts.select("vec_id", "text"), "vec_id")
    parts = F.array_sort(F.collect_list(F.struct("rank", "vec_id", F.coalesce("text", F.lit("")).alias("t"))))
    return joined.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n").alias("context"))


def chat_history(conversations: DataFrame, last_n: int | None = None) -> DataFrame:
    """For each user turn, all (or the last_n) earlier messages in order: conv_id, turn, input, history."""
    frame = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding if last_n is None else -last_n, -1)
    messages = F.collect_list(F.struct("role", "text")).over(frame)
    return conversations.withColumn("history", messages).filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("input"), "history")


def chat_payloads(history: DataFrame, contexts: DataFrame) -> DataFrame:
    """conv_id, turn, input, history, context: what a model is asked; questions without hits have an empty context."""
    return history.join(contexts, ["conv_id", "turn"], "left").withColumn("context", F.coalesce("context", F.lit("")))
