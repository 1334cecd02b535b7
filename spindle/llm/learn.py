"""Small models fitted on the driver, on bounded samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, weight: np.ndarray | None = None, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic model (last: the intercept) for targets in [0, 1], by Newton steps with a ridge."""
    x = np.hstack([x, np.ones((len(x), 1))])
    s = np.ones(len(x)) if weight is None else weight
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (s * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (s * (y - p)) - penalty * w)
        longest = np.abs(step).max()
        w += step * min(1.0, 4 / max(longest, 1e-12))
        if longest < 1e-8:
            break
    return w


def sample(rows: DataFrame, key: str, most: int, seed: int) -> DataFrame:
    """At most ``most`` rows, those of the least hashes of ``key``: the bounded sample that a model is fitted on."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(most)
