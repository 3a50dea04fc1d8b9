"""Approximate nearest neighbours on robust-pruned directed graphs.

Vectors are dealt to shards by hash, each of bounded size. Within a shard every vector is
inserted by a greedy search for its neighbours; of those found, relaxed distance pruning
keeps edges in diverse directions, and edges back are pruned the same way. A beam search
from the vector nearest to the middle answers queries; each query asks every shard, and the
nearest of all shards are scored again on the original vectors.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coverlane.llm.registry import query, table
from coverlane.session import settle


class Shape(NamedTuple):
    """Edges per vector, candidates kept by a search when building and when asked, expansions at a time, relaxation."""

    degree: int = 24
    build_width: int = 56
    search_width: int = 96
    beam: int = 4
    alpha: float = 1.2


class Graph:
    """A navigable graph over the rows of ``x``."""

    def __init__(self, x: np.ndarray, shape: Shape = Shape(), edges: np.ndarray | None = None):
        self.x, self.shape = np.ascontiguousarray(x, np.float32), shape
        self.square = np.einsum("ij,ij->i", self.x, self.x)
        n = len(x)
        self.entry = int(np.argmin(((self.x - self.x.mean(axis=0)) ** 2).sum(axis=1))) if n else 0
        self.edges = np.full((n, shape.degree * 3 // 2), -1, np.int32) if edges is None else edges
        self.count = (self.edges >= 0).sum(axis=1)
        self.seen = np.zeros(n, np.int64)
        self.round = 0

    def _far(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Squared distances, the same constant per query left out."""
        return self.square[nodes] - 2 * (self.x[nodes] @ q)

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest nodes met, nearest first, with their distances."""
        self.round += 1
        nodes = np.array([self.entry])
        self.seen[nodes] = self.round
        far, open_ = self._far(q, nodes), np.ones(1, bool)
        while open_.any():
            take = np.flatnonzero(open_)[: self.shape.beam]
            open_[take] = False
            near = self.edges[nodes[take]].ravel()
            near = np.unique(near[near >= 0])
            near = near[self.seen[near] != self.round]
            if not len(near):
                continue
            self.seen[near] = self.round
            nodes = np.concatenate([nodes, near])
            far = np.concatenate([far, self._far(q, near)])
            open_ = np.concatenate([open_, np.ones(len(near), bool)])
            order = np.argsort(far, kind="stable")[:width]
            nodes, far, open_ = nodes[order], far[order], open_[order]
        return nodes, far

    def _prune(self, p: int, nodes: np.ndarray) -> np.ndarray:
        """Relaxed pruning: the nearest stays, what is nearer to it than 1/alpha of its way to p goes, and so on."""
        nodes = nodes[nodes != p]
        x = self.x[nodes]
        to_p = np.maximum(self.square[nodes] + self.square[p] - 2 * (x @ self.x[p]), 0)
        order = np.argsort(to_p, kind="stable")
        nodes, x, to_p = nodes[order], x[order], to_p[order]
        between = np.maximum(self.square[nodes][:, None] + self.square[nodes][None] - 2 * (x @ x.T), 0) * self.shape.alpha**2
        alive, kept = np.ones(len(nodes), bool), []
        for i in range(len(nodes)):
            if alive[i]:
                kept.append(i)
                if len(kept) == self.shape.degree:
                    break
                alive &= between[i] > to_p
        return nodes[kept]

    def build(self, seed: int = 11) -> Graph:
        n = len(self.x)
        for p in np.random.default_rng(seed).permutation(n).tolist():
            found, _ = self.search(self.x[p], self.shape.build_width)
            kept = self._prune(p, np.unique(np.concatenate([found, self.edges[p][: self.count[p]]])))
            self.edges[p] = -1
            self.edges[p, : len(kept)] = kept
            self.count[p] = len(kept)
            for other in kept.tolist():
                if p in self.edges[other, : self.count[other]]:
                    continue
                if self.count[other] == self.edges.shape[1]:
                    less = self._prune(other, np.append(self.edges[other], p))
                    self.edges[other] = -1
                    self.edges[other, : len(less)] = less
                    self.count[other] = len(less)
                else:
                    self.edges[other, self.count[other]] = p
                    self.count[other] += 1
        return self


def usable(vector: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not all zero."""
    fine = F.forall(vector, lambda x: F.coalesce((x == x) & (F.abs(x) < float("inf")), F.lit(False)))  # noqa: PLR0124
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), np.float64)


def index(vectors: DataFrame, k: int = 10, shard_rows: int = 4096, shape: Shape = Shape()) -> tuple[DataFrame, int]:
    """The graphs of all shards as a table, and the number of shards.

    ``vectors`` has ``vec_id`` and ``embedding``. Equal vectors are one node that names the
    ``k + 1`` smallest ids of its copies: no answer of ``k`` needs more. Vectors of different
    length lie in different graphs. Rows without id or with an unusable vector are left out.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rank = F.dense_rank().over(Window.partitionBy("embedding").orderBy("vec_id"))
    nodes = rows.withColumn("_rank", rank).where(F.col("_rank") <= k + 1).groupBy("embedding").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    nodes = settle(nodes, "vectors")
    shards = max(1, -(-nodes.count() // shard_rows))
    schema = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("node", T.IntegerType()),
                           T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("embedding", T.ArrayType(T.DoubleType())),
                           T.StructField("edges", T.ArrayType(T.IntegerType()))])

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(_first=[x[0] for x in rows["ids"]]).sort_values("_first", ignore_index=True)
        graph = Graph(_matrix(rows["embedding"]), shape).build()
        return pd.DataFrame({"dim": rows["dim"], "shard": rows["shard"], "node": np.arange(len(rows), dtype=np.int32), "ids": rows["ids"],
                             "embedding": rows["embedding"], "edges": [e[:n] for e, n in zip(graph.edges, graph.count, strict=True)]})

    dealt = nodes.withColumns({"dim": F.size("embedding"), "shard": F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int")})
    return settle(dealt.groupBy("dim", "shard").applyInPandas(build, schema), "graphs"), shards


def search(graphs: DataFrame, shards: int, queries: DataFrame, k: int = 10, block_rows: int = 4096, shape: Shape = Shape()) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest to each query, itself left out.

    ``queries`` has ``vec_id`` and ``embedding``; of several vectors under one id the smallest
    is asked. Scores are Euclidean distances in double precision; equal ones go by id. A
    query meets vectors of its own length only, and fewer than ``k`` if there are not as many.
    A task holds one shard and one block of queries.
    """
    asked = (queries.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
             .where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    asked = settle(asked, "queries")
    blocks = max(1, -(-asked.count() // block_rows))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = graphs.withColumn("block", spread(blocks))
    right = asked.withColumns({"dim": F.size("embedding"), "block": F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")}).withColumn("shard", spread(shards))
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])

    def ask(nodes: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, float]] = []
        if len(nodes) and len(rows):
            nodes = nodes.sort_values("node", ignore_index=True)
            x, ids = _matrix(nodes["embedding"]), nodes["ids"].tolist()
            edges = np.full((len(nodes), max(1, max(map(len, nodes["edges"])))), -1, np.int32)
            for i, e in enumerate(nodes["edges"]):
                edges[i, : len(e)] = e
            graph = Graph(x, shape, edges)
            for query_id, q in zip(rows["vec_id"].tolist(), _matrix(rows["embedding"]), strict=True):
                found, _ = graph.search(q.astype(np.float32), max(shape.search_width, k + 1))
                score = np.sqrt(((x[found] - q) ** 2).sum(axis=1))
                near = [(s, i) for s, node in zip(score.tolist(), found.tolist(), strict=True) for i in ids[node] if i != query_id]
                out += [(query_id, i, s) for s, i in sorted(near)[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    met = left.groupBy("dim", "shard", "block").cogroup(right.groupBy("dim", "shard", "block")).applyInPandas(ask, schema)
    best = met.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query("op2_nearest_neighbours")
def op2_nearest_neighbours(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    graphs, shards = index(vectors)
    return search(graphs, shards, vectors.where("vec_id % 100 = 0"))
