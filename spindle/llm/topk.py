"""Operator 2: exact top-k search by inner product, with a ball tree per shard and branch and bound.

Vectors are dealt to shards of bounded size; a shard's tree splits its vectors into balls. For a query, the inner
product with any vector of a ball is at most q.c + |q| r, so leaves are visited by descending bound (the least over a
leaf and its ancestors) until the bound falls below the query's current kth score. A first pass over one shard gives
every query a kth score, which all other shards share.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, row_type

SCALE = 256
SHARD_ROWS = 8192
QUERY_ROWS = 32_768
LEAF_ROWS = 128

_HITS = "query_key long, query_id long, vec_id long, score long"


class BallTree:
    """Balls over the rows of ``x``: leaves hold rows, and ``chain`` lists the nodes from the root to each leaf."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF_ROWS) -> None:
        self.x = x
        self.centers, self.radii, self.leaves, self.chain = [], [], [], []
        todo: list[tuple[np.ndarray, list[int]]] = [(np.arange(len(x)), [])]
        while todo:
            rows, above = todo.pop()
            points = x[rows]
            center = points.mean(axis=0)
            away = points - center
            distance = np.einsum("ij,ij->i", away, away)
            node = len(self.centers)
            self.centers.append(center)
            self.radii.append(math.sqrt(float(distance.max())))
            chain = [*above, node]
            if len(rows) <= leaf or distance.max() == 0:
                self.leaves.append(rows)
                self.chain.append(chain)
                continue
            one = points[int(distance.argmax())]
            other = points[int(np.einsum("ij,ij->i", points - one, points - one).argmax())]
            side = points @ (other - one)
            by = np.argsort(side, kind="stable")
            todo += [(rows[by[: len(by) // 2]], chain), (rows[by[len(by) // 2 :]], chain)]

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner product of each query with each leaf, from the leaf and all balls around it."""
        norm = np.sqrt(np.einsum("ij,ij->i", q, q))[:, None]
        each = q @ np.array(self.centers).T + norm * np.array(self.radii)[None, :]
        each += 1e-9 * (np.abs(each) + norm * np.sqrt(np.einsum("ij,ij->i", self.x, self.x).max()) + 1)  # for rounding
        return np.stack([each[:, c].min(axis=1) for c in self.chain], axis=1)


def search(q: np.ndarray, own: np.ndarray, floor: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its k best rows of ``x`` (scores, ids, and which are there), ties to the smaller id.

    ``own`` is the row of x that a query must not find, or -1; ``floor`` a score below which rows aren't wanted.
    """
    tree = BallTree(x)
    bound = tree.bounds(q)
    rank = np.argsort(-bound, axis=1)
    n = len(q)
    best = np.full((n, k), -np.inf)
    who = np.full((n, k), np.iinfo(np.int64).max)
    live = np.arange(n)
    for step in range(len(tree.leaves)):
        leaf = rank[live, step]
        least = np.maximum(best[live, k - 1], floor[live])
        go = bound[live, leaf] >= least  # equal scores count: the smaller id may be here
        live, leaf = live[go], leaf[go]
        if not len(live):
            break
        by = np.argsort(leaf, kind="stable")
        cuts = np.flatnonzero(np.append(True, np.diff(leaf[by]) != 0))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(by)]):
            who_asks = live[by[a:b]]
            rows = tree.leaves[int(leaf[by[a]])]
            score = q[who_asks] @ x[rows].T
            score[own[who_asks][:, None] == rows[None, :]] = -np.inf
            hit = np.flatnonzero((score >= np.maximum(best[who_asks, k - 1], floor[who_asks])[:, None]).any(axis=1))
            if not len(hit):
                continue
            asks = who_asks[hit]
            both = np.concatenate([best[asks], score[hit]], axis=1)
            names = np.concatenate([who[asks], np.broadcast_to(ids[rows], (len(hit), len(rows)))], axis=1)
            order = np.lexsort((names, -both), axis=1)[:, :k]
            best[asks] = np.take_along_axis(both, order, axis=1)
            who[asks] = np.take_along_axis(names, order, axis=1)
    return best, who, best > -np.inf


def _matrix(column: pa.ChunkedArray, rows: np.ndarray, dim: int) -> np.ndarray:
    """Rows of a list column as whole numbers; exact as long as inner products stay below 2**53."""
    flat = column.take(pa.array(rows)).combine_chunks()
    flat = flat.flatten() if hasattr(flat, "flatten") else flat
    return np.floor(SCALE * flat.to_numpy(zero_copy_only=False).astype(float)).reshape(len(rows), dim)


def _shard_search(k: int):
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if queries.num_rows and vectors.num_rows:
            qdim, vdim = (np.array([len(v) for v in t["embedding"]]) for t in (queries, vectors))
            for dim in np.unique(qdim).tolist():
                qi, vi = np.flatnonzero(qdim == dim), np.flatnonzero(vdim == dim)
                if not len(vi):
                    continue
                # equal rows came as one with a count; only k + 1 of them can matter to any query
                times = np.minimum(vectors["times"].to_numpy()[vi], k + 1)
                x = np.repeat(_matrix(vectors["embedding"], vi, dim), times, axis=0)
                ids = np.repeat(vectors["vec_id"].to_numpy()[vi], times)
                keys = vectors["key"].to_numpy()[vi]
                first = dict(zip(keys.tolist(), (np.cumsum(times) - times).tolist()))
                q = _matrix(queries["embedding"], qi, dim)
                own = np.array([first.get(key, -1) for key in queries["key"].to_numpy()[qi].tolist()])
                score, who, there = search(q, own, queries["floor"].to_numpy()[qi], x, ids, k)
                at = np.nonzero(there)
                out[0] += queries["key"].to_numpy()[qi][at[0]].tolist()
                out[1] += queries["vec_id"].to_numpy()[qi][at[0]].tolist()
                out[2] += who[at].tolist()
                out[3] += score[at].astype(np.int64).tolist()
        return pa.table({n: pa.array(v, pa.int64()) for n, v in zip(("query_key", "query_id", "vec_id", "score"), out)})

    return run


def top_k(vectors: DataFrame, query_filter, k: int = 5) -> DataFrame:
    """For each row that ``query_filter`` picks, the k other rows of highest integer inner product: query_id, rank, vec_id, score.

    ``vectors`` has vec_id and embedding; other columns are left out. Components x count as floor(256 x). Vectors that
    are null or hold null or non-finite components take no part; nor do rows of null vec_id. Vectors of other
    dimensions than a query's aren't its candidates. Ties go to the smaller vec_id. A query's own row isn't its
    candidate, but other rows of its vec_id are; each of several equal query rows is answered. Fewer than k candidates
    give fewer rows; an empty table gives none.

    Queries and candidates meet block by block: every block of queries with every shard, both of bounded size.
    """
    names = {"vec_id": F.col("vec_id").cast("long"), "embedding": F.col("embedding").cast("array<double>")}
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = vectors.select(*(c.alias(n) for n, c in names.items())).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite))
    rows = materialise(good.groupBy("vec_id", "embedding").agg(F.count("*").alias("times")).withColumn("key", F.xxhash64("vec_id", "embedding")), "vectors")
    asked = rows.where(query_filter)
    n, m = rows.count(), asked.count()
    shards, blocks = max(1, math.ceil(n / SHARD_ROWS)), max(1, math.ceil(m / QUERY_ROWS))
    shard = F.pmod(F.col("key"), F.lit(shards)).alias("shard")
    block = F.pmod(F.xxhash64(F.lit(3), "key"), F.lit(blocks)).alias("block")
    low = F.lit(float("-inf"))

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(_shard_search(k), row_type(_HITS))

    q = asked.select("key", "vec_id", "embedding", block).toDF("key", "vec_id", "embedding", "block")  # columns of its own: both sides come from one table
    first = q.withColumns({"shard": F.pmod(F.col("block"), F.lit(shards)), "floor": low})
    own = rows.select("key", "vec_id", "embedding", "times", shard)
    every = own.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    seeded = every.where(F.col("shard") == F.pmod(F.col("block"), F.lit(shards)))
    hits = meet(first, seeded)
    if shards > 1:
        hits = materialise(hits, "first-shard")
        kth = hits.groupBy("query_key").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
        later = q.join(kth, q["key"] == kth["query_key"], "left").withColumn("floor", F.coalesce(F.col("kth").cast("double"), low))
        later = later.select("key", "vec_id", "embedding", "block", "floor").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
        hits = hits.unionByName(meet(later.where(F.col("shard") != F.pmod(F.col("block"), F.lit(shards))), every.where(F.col("shard") != F.pmod(F.col("block"), F.lit(shards)))))
    order = Window.partitionBy("query_key").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    repeated = asked.where("times > 1").select("key", "times").toDF("query_key", "times")
    ranked = ranked.join(repeated, "query_key", "left").withColumn("_n", F.explode(F.expr("sequence(1L, coalesce(times, 1L))")))
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def digest(vectors: DataFrame) -> DataFrame:
    """What query op2 returns."""
    return top_k(vectors, F.col("vec_id") % 50 == 0, 5)


ORACLE_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS k, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.k, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.k <> q.k AND len(c.e) = len(q.e) WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
