"""Packing: optimal length buckets.

The global histogram of lengths goes to dynamic programming, which chooses the bucket boundaries with the least padding;
then token-budget batches form inside each bucket: a bucket of width w holds max(1, budget // w) documents a batch.
Batches are numbered over a whole bucket, in an order drawn from the document ids: the rows are sorted by bucket and that
order into stretches of equal size, ranked there, and the stretches' bases are prefix sums of their counts, so neither a
bucket nor the rows of one id (or of none) meet in one task, and at most one batch of a bucket is not full.

The histogram has a row for each different length and no bins, so the boundaries are optimal over all documents. It is
counted before it is shuffled, and the driver sees it alone: D different lengths take texts of D * D / 2 words together at
least, so a trillion words have 1.5 million of them at most. The programming takes D log D steps for each bucket.

A length is the number of words unless ``length`` says otherwise, such as a column of token counts; the budget is in the
same unit.

Defined results: null, empty and white texts have length 1 (they hold the end of their document); documents longer
than the budget are batches of their own; repeated rows are packed each; rows of equal ids are ordered by length; an
empty table gives an empty result; names that clash with the added columns are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docjobs.llm.common import written

BUCKETS, BUDGET = 8, 16_384
#: Stretches of the order: about so many rows each, and so many stretches at most.
STRETCH, MOST_STRETCHES = 20_000, 1 << 16


def n_words(text: str = "text") -> Column:
    """Words separated by the six ASCII white-space characters, 1 at least."""
    return F.greatest(F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(1)).cast("long")


def histogram(lengths: DataFrame, length: str = "n") -> np.ndarray:
    """Rows (length, documents, sum of lengths) of the different lengths, ascending."""
    table = lengths.groupBy(F.col(length).alias("n")).agg(F.count("*").alias("docs")).toArrow()
    n, docs = (table.column(c).to_numpy() for c in ("n", "docs"))
    order = np.argsort(n)
    return np.stack([n, docs, n * docs], axis=1)[order]


def boundaries(bins: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """The widths of at most so many buckets with the least padding; of equal ones, the smallest.

    best[j] is the least padding of the first j bins in k buckets. Its last cut moves right with j, so each layer is
    halved: the middle is searched in full, and either half between its neighbours' cuts.
    """
    m = len(bins)
    if not m:
        return []
    top, docs, total = bins[:, 0], np.concatenate(([0], np.cumsum(bins[:, 1]))), np.concatenate(([0], np.cumsum(bins[:, 2])))
    best = np.full(m + 1, np.iinfo(np.int64).max // 4)
    best[0] = 0
    cuts = []
    for _ in range(min(buckets, m)):
        new, cut = np.full(m + 1, np.iinfo(np.int64).max // 4), np.zeros(m + 1, np.int64)
        todo = [(1, m, 0, m - 1)]
        while todo:
            lo, hi, left, right = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(left, min(j - 1, right) + 1)
            cost = best[i] + top[j - 1] * (docs[j] - docs[i]) - (total[j] - total[i])
            at = int(np.argmin(cost))
            new[j], cut[j] = cost[at], i[at]
            todo += [(lo, j - 1, left, int(cut[j])), (j + 1, hi, int(cut[j]), right)]
        best = new
        cuts.append(cut)
    out, j = [], m
    for cut in reversed(cuts):
        out.append(int(top[j - 1]))
        j = int(cut[j])
    return out[::-1]


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, doc_id: str = "doc_id", length: Column | None = None) -> DataFrame:
    """doc_id, n_words (the length), bucket, width, batch (number in its bucket), slot (place in its batch)."""
    order = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    lengths = written(docs.select(F.col(doc_id).alias("doc_id"), order.alias("order"), (n_words() if length is None else length).cast("long").alias("n")), "lengths")
    bins = histogram(lengths)
    widths = boundaries(bins, buckets)
    stretches = int(min(max(1, bins[:, 1].sum() // STRETCH), MOST_STRETCHES))
    wide = F.array(*[F.lit(w).cast("long") for w in widths]) if widths else F.array().cast("array<long>")
    below = F.size(F.filter(wide, lambda w: w < F.col("n")))
    rows = lengths.withColumn("bucket", below).withColumn("width", F.get(wide, F.col("bucket"))).withColumn("tie", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(stretches, "bucket", "order", "doc_id", "n", "tie").drop("tie")  # rows that are alike spread too
    rows = written(dealt.withColumn("stretch", F.spark_partition_id()), "stretches")  # fixed, as bases count on them
    counts = rows.groupBy("bucket", "stretch").agg(F.count("*").alias("c"))
    base = counts.withColumn("base", F.coalesce(F.sum("c").over(Window.partitionBy("bucket").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("c")
    own = F.row_number().over(Window.partitionBy("bucket", "stretch").orderBy("order", "doc_id", "n")) - 1
    ranked = rows.join(base, ["bucket", "stretch"]).withColumn("rank", F.col("base") + own)
    holds = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("width")))
    return ranked.select("doc_id", F.col("n").alias("n_words"), "bucket", "width", F.floor(F.col("rank") / holds).cast("long").alias("batch"), (F.col("rank") % holds).cast("long").alias("slot"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the batch of each document, for buckets over the words of whole texts."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle_sql(source: str = "documents", buckets: int = BUCKETS, budget: int = BUDGET) -> str:
    """DuckDB SQL for the same batches."""
    return f"""
WITH RECURSIVE len_of AS (
  SELECT doc_id, md5(coalesce(doc_id::VARCHAR, '')) AS ord,
    greatest(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')), 1)::BIGINT AS n
  FROM {source}
), h AS (
  SELECT row_number() OVER (ORDER BY n) AS j, n AS top, (sum(count(*)) OVER (ORDER BY n))::BIGINT AS docs, (sum(sum(n)) OVER (ORDER BY n))::BIGINT AS total
  FROM len_of GROUP BY n
), h0 AS (SELECT 0 AS j, 0 AS docs, 0 AS total UNION ALL SELECT j, docs, total FROM h),
w AS (SELECT h0.j AS i, h.j, h.top * (h.docs - h0.docs) - (h.total - h0.total) AS cost FROM h JOIN h0 ON h0.j < h.j),
dp AS (
  SELECT 1 AS k, j, cost, 0::BIGINT AS i FROM w WHERE w.i = 0
  UNION ALL
  SELECT k, j, best.cost, best.i FROM (
    SELECT dp.k + 1 AS k, w.j, min(struct_pack(cost := dp.cost + w.cost, i := w.i)) AS best
    FROM dp JOIN w ON w.i = dp.j WHERE dp.k < {buckets} GROUP BY dp.k + 1, w.j)
), size AS (SELECT max(j) AS m, least(max(j), {buckets}) AS kk FROM h),
back AS (
  SELECT dp.k, dp.j, dp.i FROM dp, size WHERE dp.k = size.kk AND dp.j = size.m
  UNION ALL
  SELECT dp.k, dp.j, dp.i FROM dp JOIN back ON dp.k = back.k - 1 AND dp.j = back.i
), widths AS (SELECT back.k - 1 AS bucket, h.top AS width FROM back JOIN h USING (j)),
placed AS (
  SELECT len_of.doc_id, ord, n, min(struct_pack(width := width, bucket := bucket)) AS b FROM len_of JOIN widths ON widths.width >= n GROUP BY ALL
), ranked AS (
  SELECT doc_id, n, b.bucket AS bucket, b.width AS width, row_number() OVER (PARTITION BY b.bucket ORDER BY ord, doc_id, n) - 1 AS rank FROM placed
)
SELECT doc_id, n AS n_words, bucket::INTEGER AS bucket, width, rank // greatest(1, {budget} // width) AS batch, rank % greatest(1, {budget} // width) AS slot FROM ranked
"""


ORACLE_SQL = oracle_sql()
