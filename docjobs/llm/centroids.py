"""Centroid clustering with Hamerly's bounds, in integers.

Each vector keeps one upper bound of its distance to its own centroid and one lower bound of that to the second nearest.
When centroids move, the upper bound grows by the drift of the vector's own centroid and the lower one falls by the
largest drift of the others. As long as the upper bound stays below the lower one, or below half the distance from its
centroid to the nearest other, the assignment can't have changed. Otherwise the upper bound is made exact, and vectors
that are still ambiguous are compared with all centroids. Distances and means are exact integers, so the bounds only save
work: they are floats with a margin, and never decide.

A round is one narrow pass over the table of the round before it, which holds vectors and bounds, and is written to the
shared folder; sums are added up in tasks, and the driver sees one row for each centroid and component. Nothing is
shuffled by vector, so a vector that a third of the rows repeat is no hot key. Two rounds are kept on disk at a time.

Defined results: vectors that are null, of another number of components, or with a component that is null, infinite or no
number are left out; fewer vectors than centroids start as many as there are; the seeds are ordered by hash, then by
components, with null ids last; rows that repeat are clustered each; an empty table gives an empty result. A component of
131,072 or more in size is an error, as a squared distance might not fit 64 bits. Columns that clash with the added ones
are replaced.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docjobs.llm.common import columns, drop, stored

CENTROIDS, ROUNDS, DIMENSIONS, SCALE, SEED = 8, 10, 64, 1024, 3
#: Components below this size give distances that fit 64 bits.
LIMIT = 1 << 27
#: By how much, as a share and at all, bounds must be apart before they count.
SHARE, APART = 1e-9, 1e-6


def integers(vector: Column, scale: int = SCALE) -> Column:
    """The components as floor(scale * x)."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    ok = F.forall(vector, lambda x: F.abs(x.cast("double") * scale) < LIMIT)
    return F.when(ok, F.transform(whole, lambda x: x.cast("int"))).otherwise(F.raise_error(F.lit("a component is too large for exact distances")))


def usable(vector: Column, dimensions: int = DIMENSIONS) -> Column:
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) == dimensions) & finite, F.lit(False))


def _matrix(column) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(len(column), -1)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all vectors to all centroids."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if most * most * 4 * x.shape[1] < 1 << 53:  # every sum is a whole number that a double holds
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], axis=1)


def assign(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, drift: np.ndarray, half: np.ndarray) -> int:
    """Brings cluster, upper and lower up to date in place; the number of vectors that were compared with all centroids."""
    others = np.array([max((d for j, d in enumerate(drift) if j != i), default=0.0) for i in range(len(drift))])
    upper += drift[cluster]
    lower -= others[cluster]
    safe = np.maximum(lower, half[cluster]) * (1 - SHARE) - APART
    open_ = np.flatnonzero(~(upper * (1 + SHARE) < safe))
    if len(open_):
        upper[open_] = np.sqrt(((x[open_] - centroids[cluster[open_]]) ** 2).sum(1).astype(np.float64))
        open_ = open_[~(upper[open_] * (1 + SHARE) < safe[open_])]
    if len(open_):
        d = distances(x[open_], centroids)
        cluster[open_] = d.argmin(1)  # of equal ones, the smaller number
        d.sort(axis=1)
        upper[open_] = np.sqrt(d[:, 0].astype(np.float64))
        lower[open_] = np.sqrt(d[:, 1].astype(np.float64)) if d.shape[1] > 1 else np.inf
    return len(open_)


def _state(batch) -> list[np.ndarray]:
    return [_matrix(batch.column(1)), *(batch.column(i).to_numpy(zero_copy_only=False).copy() for i in (2, 3, 4))]


def _round_rows(centroids, drift, half, batches):
    for batch in batches:
        x, cluster, upper, lower = _state(batch)
        scanned = np.zeros(len(x), np.int64)
        if len(x):
            scanned[0] = assign(x, cluster, upper, lower, centroids, drift, half)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster), pa.array(upper), pa.array(lower), pa.array(scanned)], names=["row", "x", "cluster", "upper", "lower", "scanned"])


def _sum_rows(k, batches):
    total = count = None
    for batch in batches:
        x, cluster = _matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
        if total is None:
            total, count = np.zeros((k, x.shape[1]), np.int64), np.zeros(k, np.int64)
        for j in np.unique(cluster):
            own = cluster == j
            total[j] += x[own].sum(0)
            count[j] += own.sum()
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(count), pa.array(total.tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"])


def _distance_rows(centroids, batches):
    for batch in batches:
        x, cluster = _matrix(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)
        d = ((x - centroids[cluster]) ** 2).sum(1) if len(x) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(d)], names=["row", "cluster", "distance"])


def seeds(rows: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The k vectors (id, x) with the smallest SHA-256 of the seed and the id; each task passes on k."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.select(order.alias("h"), "x").orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()
    return np.array([r["x"] for r in first], np.int64) if first else np.zeros((0, DIMENSIONS), np.int64)


def means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floor of each component's mean; empty clusters keep their centroid."""
    k = len(centroids)
    parts = state.select("x", "cluster").mapInArrow(functools.partial(_sum_rows, k), "cluster long, n long, total array<long>")
    wide = parts.select("cluster", "n", F.posexplode("total").alias("at", "t")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    out = centroids.copy()
    for r in wide.collect():  # a row for each centroid and component
        if r["n"]:
            out[r["cluster"], r["at"]] = r["t"] // r["n"]
    return out


def _moved(old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far each centroid has moved, and half its distance to the nearest other one."""
    apart = np.sqrt(np.array([[sum((int(p) - int(q)) ** 2 for p, q in zip(a, b)) for b in new] for a in new], np.float64))
    np.fill_diagonal(apart, np.inf)
    return np.sqrt(((old - new) ** 2).sum(1).astype(np.float64)), apart.min(1) / 2


def fit(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, id_col: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray, list[int]]:
    """(row, cluster, distance) of the usable rows of vectors (row is a struct of the row), the centroids, and how many vectors each pass compared with all centroids."""
    kept = vectors.filter(usable(F.col(vector), dimensions)).select(F.struct(*columns(vectors, vector)).alias("row"), F.col(id_col).alias("id"), integers(F.col(vector), scale).alias("x"))
    start = kept.select("row", "x", F.lit(0).cast("long").alias("cluster"), F.lit(float("inf")).alias("upper"), F.lit(float("-inf")).alias("lower"))
    centroids = seeds(kept.select("id", "x"), k, seed)
    shape = f"row {dict(start.dtypes)['row']}, x array<int>, cluster long, upper double, lower double, scanned long"
    state, folder, scans = start, None, []
    drift, half = _moved(centroids, centroids) if len(centroids) else (np.zeros(0), np.zeros(0))
    for r in range(rounds + 1):
        old = folder
        state, folder = stored(state.select("row", "x", "cluster", "upper", "lower").mapInArrow(functools.partial(_round_rows, centroids, drift, half), shape), "bounds")
        if old:
            drop(vectors.sparkSession, old)
        scans.append(state.agg(F.coalesce(F.sum("scanned"), F.lit(0))).first()[0])
        if r < rounds and len(centroids):
            new = means(state, centroids)
            (drift, half), centroids = _moved(centroids, new), new
    found = state.select("row", "x", "cluster").mapInArrow(functools.partial(_distance_rows, centroids), f"row {dict(start.dtypes)['row']}, cluster long, distance long")
    return found, centroids, scans


ADDED = ("cluster", "distance", "cluster_inertia", "inertia", "centroid")


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, **names) -> DataFrame:
    """The columns of the usable vectors but the vector, plus cluster, distance (squared), cluster_inertia, inertia and centroid (its components)."""
    found, centroids, _ = fit(vectors, k, rounds, **names)
    found, _folder = stored(found, "clustered")
    inertia = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows at most
    per = F.get(F.array(*(F.lit(inertia.get(j, 0)).cast("long") for j in range(len(centroids)))), F.col("cluster").cast("int")) if len(centroids) else F.lit(None).cast("long")
    middle = F.get(F.array(*(F.array(*(F.lit(int(v)).cast("long") for v in c)) for c in centroids)), F.col("cluster").cast("int")) if len(centroids) else F.lit(None).cast("array<long>")
    kept = [F.col(f"row.`{c}`").alias(c) for c in found.schema["row"].dataType.fieldNames() if c not in ADDED]
    return found.select(*kept, F.col("cluster").cast("int").alias("cluster"), "distance", per.alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), middle.alias("centroid"))


def centroid_digest(centroid) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in centroid).encode()).hexdigest()


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the cluster and squared distance of each vector, with the inertia and the digest of its centroid."""
    found = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    text = F.array_join(F.transform("centroid", lambda v: v.cast("string")), ",")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(text, 256).alias("centroid_sha256"))


def oracle_sql(k: int = CENTROIDS, rounds: int = ROUNDS) -> str:
    """DuckDB SQL for the same clusters: every round compares all vectors with all centroids."""
    square = "list_sum(list_transform(list_zip(v.x, c.x), z -> (z[1] - z[2]) * (z[1] - z[2])))"
    parts = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, x) - 1 AS c, x FROM (SELECT sha256('{SEED}:' || vec_id) AS h, x FROM kept ORDER BY h NULLS LAST, x LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT v.r, min(struct_pack(d := {square.replace('z ->', 'lambda z:')}::BIGINT, c := c.c)) AS b FROM kept v, c{i} c GROUP BY v.r)")
        if i < rounds:
            parts += [
                f"s{i} AS MATERIALIZED (SELECT c, pos, sum(x)::BIGINT AS t, count(*) AS n FROM (SELECT a.b.c AS c, unnest(range({DIMENSIONS})) AS pos, unnest(v.x) AS x FROM a{i} a JOIN kept v USING (r)) GROUP BY c, pos)",
                f"m{i} AS MATERIALIZED (SELECT c, list((t - ((t % n) + n) % n) // n ORDER BY pos) AS x FROM s{i} GROUP BY c)",
                f"c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m USING (c))",
            ]
    return "WITH " + ",\n".join(parts) + f"""
SELECT kept.vec_id, a.b.c::INTEGER AS cluster, a.b.d AS distance, (sum(a.b.d) OVER (PARTITION BY a.b.c))::BIGINT AS cluster_inertia,
  (sum(a.b.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM kept JOIN a{rounds} a USING (r) JOIN c{rounds} c ON c.c = a.b.c
"""


ORACLE_SQL = oracle_sql()
