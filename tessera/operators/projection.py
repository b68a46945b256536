"""Principal components with partial whitening, from sums that every partition adds up."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def moments(vectors: DataFrame, column: str = "embedding") -> tuple[int, np.ndarray, np.ndarray]:
    """Count, sum and Gram matrix of all vectors: one partial result of fixed size for each task, added up by Spark."""
    width = vectors.select(F.size(column)).first()
    if width is None:
        raise ValueError("there are no vectors")
    d = width[0]

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, g = 0, np.zeros(d), np.zeros((d, d))
        for f in frames:
            if len(f):
                x = np.stack(f["v"].to_numpy()).astype(np.float64)
                n, s, g = n + len(x), s + x.sum(0), g + x.T @ x
        for i in range(d):
            yield pd.DataFrame({"i": [i], "n": [n], "s": [s[i]], "g": [g[i]]})

    rows = vectors.select(F.col(column).alias("v")).mapInPandas(partial, "i int, n long, s double, g array<double>")
    added = rows.select("i", "n", "s", F.posexplode("g").alias("j", "g")).groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("g").alias("g")).toPandas()
    added = added.sort_values(["i", "j"])
    return int(added.n.iloc[0]), added.s.to_numpy().reshape(d, d)[:, 0], added.g.to_numpy().reshape(d, d)


def fit(vectors: DataFrame, k: int, power: float = -0.25, column: str = "embedding") -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of the projection x a' + b to k components, each scaled by its eigenvalue to a power; identity if k is the width or more.

    The component with the largest magnitude is positive.
    """
    n, s, g = moments(vectors, column)
    d = len(s)
    if k >= d:
        return np.eye(d), np.zeros(d)
    mean = s / n
    values, parts = np.linalg.eigh(g / n - np.outer(mean, mean))
    order = np.argsort(-values)[:k]
    v = parts[:, order].T
    v *= np.sign(v[np.arange(k), np.abs(v).argmax(1)])[:, None]
    a = v * np.maximum(values[order], 1e-12)[:, None] ** power
    return a, -a @ mean


def project(vectors: DataFrame, a: np.ndarray, b: np.ndarray, column: str = "embedding") -> DataFrame:
    """vectors with the column projected and of unit length; the matrix is broadcast."""
    sent = vectors.sparkSession.sparkContext.broadcast((a, b))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, c = sent.value
        for f in frames:
            if len(f):
                y = np.stack(f[column].to_numpy()).astype(np.float64) @ m.T + c
                y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
                yield f.assign(**{column: list(y)})

    schema = ", ".join(f"`{f.name}` {'array<double>' if f.name == column else f.dataType.simpleString()}" for f in vectors.schema.fields)
    return vectors.mapInPandas(run, schema)
