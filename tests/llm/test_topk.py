import math
import random

import numpy as np
from pyspark.sql import functions as F

from spindle.llm import topk


def brute(rows, k=5, every=50):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(good):
        if i % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(good) if b != a and len(v) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.digest(df).collect())


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 60)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    r = random.Random(4)
    rows = [(i, [r.choice([-0.5, -0.01, 0.0, 0.25, r.random()]) for _ in range(4)]) for i in range(400)]
    rows += [(50, rows[50][1]), (50, [1.0, 1.0, 1.0, 1.0]), (1000, None), (1050, [None, 1.0, 1.0, 1.0]), (1100, [float("nan"), 1.0, 1.0, 1.0]), (1150, [float("inf")] * 4), (1200, [1.0, 2.0]), (None, [1.0] * 4)]
    rows += [(7, [0.9, 0.9, 0.9, 0.9])] * 20  # many equal rows
    assert run(spark, rows) == brute(rows)


def test_fewer_candidates_and_empty_tables(spark):
    assert run(spark, [(0, [1.0]), (3, [0.5])]) == [(0, 1, 3, 256 * 128)]
    assert run(spark, [(0, [1.0])]) == [] and run(spark, [(1, None)]) == []
    assert topk.digest(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_ball_bounds_hold():
    x = np.random.default_rng(1).normal(size=(500, 6))
    tree = topk.BallTree(x, leaf=20)
    q = x[:30]
    bound = tree.bounds(q)
    for k, rows in enumerate(tree.leaves):
        assert (bound[:, k] >= (q @ x[rows].T).max(axis=1)).all()
    assert sorted(np.concatenate(tree.leaves).tolist()) == list(range(500))


def test_other_filters(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"]) for r in topk.top_k(df, F.col("vec_id") == 1, 1).collect()] == [2]
