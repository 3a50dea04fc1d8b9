"""Recall against brute force, exact scores and ties, odd vectors."""

import numpy as np

from coverlane.llm import neighbours
from coverlane.llm.queries import QUERIES


def brute(ids, x, queries, k=10):
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[ids.index(q)]) ** 2).sum(axis=1))
        out[q] = sorted((s, i) for s, i in zip(d.tolist(), ids, strict=True) if i != q)[:k]
    return out


def test_query_recall_and_scores(spark):
    d = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], float)
    want = brute(ids, x, [i for i in ids if i % 100 == 0])
    got = {}
    for r in sorted(QUERIES["op2_nearest_neighbours"](spark, d).collect()):
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(got[r.query_id]) and abs(r.score - np.linalg.norm(x[ids.index(r.vec_id)] - x[ids.index(r.query_id)])) < 1e-12
    assert got.keys() == want.keys() and all(len(v) == 10 and v == sorted(v) for v in got.values())
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.97 * 10 * len(want)


def test_several_shards_and_blocks(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(1200, 16))
    rows = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, score int")
    graphs, shards = neighbours.index(rows, shard_rows=300)
    got = neighbours.search(graphs, shards, rows.where("vec_id % 10 = 0"), block_rows=25).collect()
    want = brute(list(range(1200)), x, range(0, 1200, 10))
    hits = len({(g.query_id, g.vec_id) for g in got} & {(q, i) for q, v in want.items() for _, i in v})
    assert shards == 4 and hits >= 0.9 * 1200


def test_odd_vectors(spark):
    one = [1.0, 2.0]
    rows = [(0, one), *((i, one) for i in range(20, 60)), (20, one), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [1.0, float("nan")]),
            (7, [float("inf"), 1.0]), (8, []), (9, [1.0, 3.0]), (100, [5.0]), (None, one), (200, [2.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    graphs, shards = neighbours.index(df)
    got = [tuple(r) for r in neighbours.search(graphs, shards, df.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()]
    assert got[:10] == [(0, k + 1, 20 + k, 0.0) for k in range(10)]
    assert got[10:] == [(200, k + 1, i, 1.0) for k, i in enumerate([0, *range(20, 29)])]
    graphs, shards = neighbours.index(df.limit(0))
    assert neighbours.search(graphs, shards, df.limit(0)).count() == 0
    few, shards = neighbours.index(df.where("vec_id in (0, 9, 200)"))
    assert neighbours.search(few, shards, df.where("vec_id = 0")).count() == 2
