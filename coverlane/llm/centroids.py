"""Centroid clustering of integer vectors by scalar lookup tables.

Components are turned into integers (``floor(scale * x)``). In every round each task
tabulates, per dimension, the squared difference between every integer value that occurs
there in its rows and every centroid's component: a table of (distinct values x centroids).
A vector's distances to all centroids are then gathers from these tables by the index of
its values and sums over the dimensions, in NumPy. The table has at most as many rows as
the task has vectors, so it is bounded by the task, not by the data.

Only the centroids (``k x dim`` integers) travel to the tasks and back to the driver: each
task sums its vectors per nearest centroid, Spark adds the partial sums (exact decimals),
and the driver takes the exact floor of the means.

Defined results: vectors that are null, of another length, or hold a null or non-finite
component take no part and give no row. Fewer kept vectors than ``k``: as many centroids
as vectors. No vector: no row. Repeated ``vec_id``: each row is a vector; the start order
of equal hashes then goes by the components; a null ``vec_id`` has no hash and comes after
all others at the start, but takes part like any vector. Ties in distance go to the smaller centroid
number. A centroid that loses all vectors stays where it is. Other columns are dropped;
output names are fixed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coverlane.llm.registry import query, table
from coverlane.session import settle

#: Largest magnitude of scaled components for which int64 sums of squares cannot overflow.
SMALL = 1 << 27


def kept(vectors: DataFrame, dim: int, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, embedding) of vectors with exactly ``dim`` components, none null or non-finite."""
    x = F.col(column)
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) != F.lit(float("inf"))))
    return vectors.where(x.isNotNull() & (F.size(x) == dim) & good).select(F.col(key).alias("vec_id"),
                                                                            F.col(column).alias("embedding"))


def scaled(batch: pa.RecordBatch | pa.Table, dim: int, scale: int, column: str = "embedding") -> np.ndarray:
    """Rows of ``floor(scale * x)`` with x as double: int64, or Python integers where they are too large."""
    values = batch.column(column)
    flat = pa.concat_arrays(values.chunks) if isinstance(values, pa.ChunkedArray) else values
    flat = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.floor(flat * scale).reshape(len(batch), dim)
    if out.size and np.abs(out).max() >= SMALL:
        return np.array([[int(v) for v in row] for row in out], dtype=object).reshape(len(batch), dim)
    return out.astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (smaller number on ties) and squared distance, by per-dimension tables.

    For dimension d the task's distinct values u and the index of each row's value are
    found once; the table (u - c[:, d])^2 is gathered by that index and summed.
    """
    n, dim = x.shape
    exact = x.dtype == object or centroids.dtype == object or (
        x.size and np.abs(x).max() + np.abs(centroids).max() >= 2 * SMALL)
    kind = object if exact else np.int64
    total = np.zeros((n, len(centroids)), dtype=kind)
    for d in range(dim):
        values, index = np.unique(x[:, d], return_inverse=True) if not exact else _unique(x[:, d])
        diff = values.astype(kind)[:, None] - centroids[:, d].astype(kind)[None, :]
        total += (diff * diff)[index]
    best = np.argmin(total, axis=1) if n else np.zeros(0, np.int64)
    return best.astype(np.int32), total[np.arange(n), best]


def _unique(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    seen: dict[int, int] = {}
    index = np.fromiter((seen.setdefault(int(v), len(seen)) for v in column), np.int64, len(column))
    return np.array(list(seen), dtype=object), index


def _sums_type() -> T.StructType:
    return T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("n", T.LongType()),
                         T.StructField("sums", T.ArrayType(T.DecimalType(38, 0)))])


def _round(kept_df: DataFrame, centroids: np.ndarray, dim: int, scale: int) -> np.ndarray:
    """One round: assign every vector, new centroids by exact floor of the means."""
    schema = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0)))])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = scaled(batch, dim, scale)
            best, _ = nearest(x, centroids)
            for c in np.unique(best):
                part = x[best == c]
                total = [Decimal(int(v)) for v in part.sum(axis=0, dtype=object if part.dtype == object else np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array([int(c)], pa.int32()), pa.array([len(part)], pa.int64()),
                                                  pa.array([total], schema.field("sums").type)], schema=schema)

    parts = kept_df.mapInArrow(sums, _sums_type())
    rows = (parts.select("cluster", "n", F.posexplode("sums").alias("d", "s"))
            .groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect())
    out = centroids.astype(object).copy()
    for r in rows:
        out[r.cluster, r.d] = int(r.s) // int(r.n)
    return out if any(abs(int(v)) >= SMALL for v in out.ravel()) else out.astype(np.int64)


def start(kept_df: DataFrame, k: int, dim: int, scale: int, seed_prefix: str = "1:") -> np.ndarray:
    """The ``k`` kept vectors with the smallest hex SHA-256 of ``<prefix><vec_id>``, in that order."""
    digest = F.sha2(F.concat(F.lit(seed_prefix), F.col("vec_id").cast("string")), 256)
    first = kept_df.select(digest.alias("h"), "embedding").orderBy(F.col("h").asc_nulls_last(), "embedding").limit(k).toArrow()
    if first.num_rows == 0:
        return np.zeros((0, dim), np.int64)
    return scaled(first, dim, scale)


def centroid_sha256(centroid) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in centroid).encode()).hexdigest()


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64,
            column: str = "embedding", key: str = "vec_id") -> tuple[DataFrame, np.ndarray]:
    """Assignments (vec_id, cluster, distance) after ``rounds`` rounds, and the final centroids."""
    spark = vectors.sparkSession
    base = kept(vectors, dim, column, key)
    centroids = start(base, k, dim, scale)
    if len(centroids) == 0:
        empty = spark.createDataFrame([], "vec_id long, cluster int, distance long")
        return empty, centroids
    for _ in range(rounds):
        centroids = _round(base, centroids, dim, scale)
    final = centroids

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, dist = nearest(scaled(batch, dim, scale), final)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(best, pa.int32()), pa.array(dist.astype(np.int64))],
                                             names=["vec_id", "cluster", "distance"])

    found = base.mapInArrow(assign, "vec_id long, cluster int, distance long")
    return settle(found, "clusters"), final


def report(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Per vector: cluster, distance, cluster_inertia, inertia and centroid_sha256."""
    totals = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    inertia = sum(totals.values())
    by_cluster = F.create_map(*[e for c, s in totals.items() for e in (F.lit(c).cast("int"), F.lit(s).cast("long"))]) \
        if totals else None
    hashes = F.create_map(*[e for c in range(len(centroids)) for e in (F.lit(c).cast("int"), F.lit(centroid_sha256(centroids[c])))]) \
        if len(centroids) else None
    if by_cluster is None:
        return assigned.select("vec_id", "cluster", "distance", F.lit(None).cast("long").alias("cluster_inertia"),
                               F.lit(None).cast("long").alias("inertia"), F.lit(None).cast("string").alias("centroid_sha256"))
    return assigned.select("vec_id", "cluster", "distance", by_cluster[F.col("cluster")].cast("long").alias("cluster_inertia"),
                           F.lit(inertia).cast("long").alias("inertia"), hashes[F.col("cluster")].alias("centroid_sha256"))


def _sql(k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64) -> str:
    """DuckDB SQL for the same rows: rounds written out, distances by joins over dimensions."""
    steps = [f"""x AS (SELECT vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = {dim}
        AND list_count(embedding) = {dim} AND isfinite(list_sum(embedding::DOUBLE[]))),
    v AS (SELECT vec_id, d, CAST(floor({scale} * (embedding[d])::DOUBLE) AS BIGINT) AS val
        FROM x, range(1, {dim} + 1) t(d)),
    c0 AS (SELECT (row_number() OVER (ORDER BY h NULLS LAST, embedding) - 1)::INT AS c, vec_id, embedding FROM
        (SELECT sha256('1:' || vec_id::VARCHAR) AS h, embedding, vec_id FROM x ORDER BY h NULLS LAST, embedding LIMIT {k})),
    m0 AS (SELECT c0.c, v.d, v.val::HUGEINT AS val FROM c0 JOIN v USING (vec_id))"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS (SELECT vec_id, arg_min(c, dist * 1000 + c::HUGEINT) AS c, min(dist) AS dist FROM
        (SELECT v.vec_id, m.c, sum((v.val - m.val) * (v.val - m.val)) AS dist FROM v JOIN m{i} m USING (d) GROUP BY v.vec_id, m.c)
        GROUP BY vec_id)""")
        if i < rounds:
            steps.append(f"""m{i + 1} AS (SELECT m.c, m.d, coalesce(u.val, m.val) AS val FROM m{i} m LEFT JOIN
        (SELECT a.c, v.d, CASE WHEN sum(v.val) >= 0 THEN sum(v.val) // count(*) ELSE -((-sum(v.val) + count(*) - 1) // count(*)) END AS val
         FROM a{i} a JOIN v USING (vec_id) GROUP BY a.c, v.d) u USING (c, d))""")
    return "WITH " + ",\n    ".join(steps) + f""",
    h AS (SELECT c, sha256(string_agg(val::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM m{rounds} GROUP BY c),
    ci AS (SELECT c, sum(dist) AS cluster_inertia FROM a{rounds} GROUP BY c)
SELECT a.vec_id, a.c AS cluster, a.dist::BIGINT AS distance, ci.cluster_inertia::BIGINT AS cluster_inertia,
    (sum(a.dist) OVER ())::BIGINT AS inertia, h.centroid_sha256
FROM a{rounds} a JOIN ci USING (c) JOIN h USING (c)"""


CHECK = _sql()


@query("op11_centroid_clustering", CHECK)
def op11_centroid_clustering(spark, sf_dir):
    assigned, centroids = cluster(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dim=64, scale=64)
    return report(assigned, centroids)
