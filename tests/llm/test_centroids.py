"""Centroid clustering: lookup tables against plain distances, the query against its SQL and a plain loop, odd rows."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from coverlane.llm import centroids


def plain(rows, k=16, rounds=3, dim=64, scale=64):
    """k-means as the contract says it, with Python integers."""
    keep = [(i, [int(np.floor(np.float64(np.float32(x)) * scale)) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    if not keep:
        return {}
    def digest(i):
        return (1, "") if i is None else (0, hashlib.sha256(f"1:{i}".encode()).hexdigest())

    order = sorted(keep, key=lambda r: (digest(r[0]), [np.float32(x) for x in r[1]]))
    cents = [list(v) for _, v in order[:k]]

    def assign():
        out = []
        for i, v in keep:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in cents]
            out.append((i, d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        a = assign()
        for c in range(len(cents)):
            members = [keep[j][1] for j, (_, cc, _) in enumerate(a) if cc == c]
            if members:
                cents[c] = [sum(col) // len(members) for col in zip(*members)]
    a = assign()
    inertia = sum(d for _, _, d in a)
    per = {}
    for _, c, d in a:
        per[c] = per.get(c, 0) + d
    return sorted(((i, c, d, per[c], inertia, hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for i, c, d in a), key=repr)


def test_tables_equal_plain_distances():
    r = np.random.default_rng(1)
    x = r.integers(-70, 70, size=(300, 8))
    c = r.integers(-70, 70, size=(5, 8))
    c[3] = c[1]
    best, dist = centroids.nearest(x, c)
    full = ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
    assert (best == full.argmin(axis=1)).all() and (dist == full.min(axis=1)).all()
    assert not (best == 3).any()
    big = x.astype(object) * (1 << 40)
    b2, d2 = centroids.nearest(big, c.astype(object) * (1 << 40))
    assert (b2 == best).all() and all(int(a) == int(b) * (1 << 80) for a, b in zip(d2, dist))


def test_odd_rows_against_plain_loop(spark):
    r = random.Random(5)
    rows = [(i, [r.uniform(-1, 1) for _ in range(4)]) for i in range(60)]
    rows += [(60, None), (61, [0.1, None, 0.2, 0.3]), (62, [0.1, float("nan"), 0.0, 0.0]), (63, [float("inf"), 0.0, 0.0, 0.0]), (64, [0.5, 0.5]),
             (7, rows[7][1]), (8, [0.9, 0.9, 0.9, 0.9]), (65, [1e12, -1e12, 3.0, 0.0]), (None, [0.2, 0.1, -0.3, 0.4])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit(9))
    assigned, cents = centroids.cluster(df, k=5, rounds=3, dim=4, scale=64)
    got = sorted((tuple(x) for x in centroids.report(assigned, cents).collect()), key=repr)
    assert got == plain(rows, k=5, rounds=3, dim=4)
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    a, c = centroids.cluster(few, k=16, dim=4)
    assert len(c) == 3 and a.count() == 3
    none = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    a, c = centroids.cluster(none, dim=4)
    assert centroids.report(a, c).count() == 0 and len(centroids.report(a, c).columns) == 6


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_sql_and_plain_loop(spark, sf):
    got = sorted(tuple(x) for x in centroids.op11_centroid_clustering(spark, f"/root/testdata/{sf}").collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/{sf}/embeddings.parquet'")
    want = sorted(tuple(x) for x in con.execute(centroids.CHECK).fetchall())
    assert got == want
    if sf == "sf0.001":
        rows = [(a, list(b)) for a, b in con.execute("SELECT vec_id, embedding FROM embeddings").fetchall()]
        assert sorted(got, key=repr) == plain(rows)
