"""What the trained text models share: bounded samples of labelled rows and gradient descent."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier is fitted on at most; drawn by a hash of doc_id.
SAMPLE_ROWS = 4000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, label) of at most rows documents with labels.

    Several labels of one doc_id count as their largest, several texts as the one that is first in order.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def adam(x: np.ndarray, gradient, rounds: int, rate: float) -> np.ndarray:
    """Minimise by Adam with a rate that falls to zero; gradient(x) is of x's shape."""
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, rounds + 1):
        g = gradient(x)
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        x = x - rate * (1 - (t - 1) / rounds) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return x


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a calibrated chance sigmoid(slope * z + intercept); the identity if y has one class only."""
    if len(set(y.tolist())) < 2:
        return 1.0, 0.0
    aim = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    p = np.array([1.0, 0.0])
    for _ in range(50):
        q = sigmoid(p[0] * z + p[1])
        x = np.stack([z, np.ones_like(z)], 1)
        h = (x * (q * (1 - q))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (q - aim))
        p = p - step * min(1, 5 / max(1e-9, np.abs(step).max()))
    return (float(p[0]), float(p[1])) if p[0] > 0 else (1.0, 0.0)
