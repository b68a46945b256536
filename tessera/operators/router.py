"""The query router: channel weights from linear heads, targets from ranks, and training by L-BFGS."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Least share of a view, bounds of the lexical share, softness of the targets.
FLOOR, LOW, HIGH, SOFT = 0.05, 0.2, 0.8, 0.06
VIEWS = ("topic", "identity", "episode", "relation")


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.where(x >= 0, 1 / (1 + np.exp(-np.abs(x))), np.exp(-np.abs(x)) / (1 + np.exp(-np.abs(x))))


@dataclass
class Model:
    """Standardization and three linear heads; all-zero heads route evenly."""

    mean: np.ndarray
    scale: np.ndarray
    view: np.ndarray
    view_bias: np.ndarray
    share: np.ndarray
    share_bias: float
    trust: np.ndarray
    trust_bias: float
    temperatures: tuple[float, float, float] = (1.0, 1.0, 1.0)
    #: Added to the trust head's value after training.
    trust_shift: float = 0.0

    @classmethod
    def zero(cls, width: int) -> Model:
        return cls(np.zeros(width), np.ones(width), np.zeros((4, width)), np.zeros(4), np.zeros(width), 0.0, np.zeros(width), 0.0)


def outputs(x: np.ndarray, m: Model) -> np.ndarray:
    """(rows, 5) weights of the four views and of the lexical channel; they sum to 2.

    Standardized features are kept within 8. The views share 2 * share with a floor each, the lexical
    channel has 2 * (1 - share); low trust draws both to even.
    """
    z = np.clip((x - m.mean) / m.scale, -8, 8)
    view = FLOOR + (1 - 4 * FLOOR) * softmax((z @ m.view.T + m.view_bias) / m.temperatures[0])
    share = LOW + (HIGH - LOW) * sigmoid((z @ m.share + m.share_bias) / m.temperatures[1])
    trust = sigmoid((z @ m.trust + m.trust_bias + m.trust_shift) / m.temperatures[2])
    view = trust[:, None] * view + (1 - trust[:, None]) * 0.25
    share = 0.5 + trust * (share - 0.5)
    return np.concatenate([2 * share[:, None] * view, 2 * (1 - share)[:, None]], 1)


def route(queries: DataFrame, model: Model) -> DataFrame:
    """(query_id, channel, weight) of queries (query_id, features array); the model is broadcast."""
    sent = queries.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                w = outputs(np.stack(f.features.to_numpy()).astype(float), sent.value)
                yield pd.DataFrame({"query_id": np.repeat(f.query_id.to_numpy(), 5), "channel": [*VIEWS, "lexical"] * len(f), "weight": w.ravel()})

    kind = queries.schema["query_id"].dataType.simpleString()
    return queries.select("query_id", "features").mapInPandas(run, f"query_id {kind}, channel string, weight double")


def fused_ranking(ranks: DataFrame, weights: DataFrame, top: int | None = None, constant: int = 60) -> DataFrame:
    """(query_id, doc_id, score, rank): weighted reciprocal ranks; weights differ from query to query."""
    scored = ranks.join(weights, ["query_id", "channel"]).groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") / (constant + F.col("rank"))).alias("score"))
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "doc_id")))
    return out if top is None else out.where(F.col("rank") <= top)


def ranking_loss(scores: np.ndarray, positive: np.ndarray, softness: float = 0.002) -> float:
    """Mean over positives of softplus of how far all negatives together stand above each."""
    if positive.all() or not positive.any():
        return 0.0
    low = scores[~positive] / softness
    anchor = low.max() + np.log(np.exp(low - low.max()).sum())
    return float(np.logaddexp(0, anchor - scores[positive] / softness).mean())


def targets(ranks: np.ndarray, positive: np.ndarray, constant: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares of the views, the semantic share, and trust, for ranks (queries, candidates, 5) and a mask of positives.

    A channel's use is half the mean and half the least of 1 / log2(1 + rank) over positives. The
    views' shares are a softmax of their uses; the semantic share weighs the views' use against the
    lexical one; trust is what these weights gain over even ones in ranking loss, over 0.35.
    """
    views, shares, trusts = [], [], []
    for rank, mask in zip(ranks, positive):
        discount = 1 / np.log2(1.0 + rank[mask])
        use = 0.5 * discount.mean(0) + 0.5 * discount.min(0)
        view = softmax(use[:4] / SOFT)
        semantic = float(view @ use[:4])
        share = float(np.clip(semantic / max(semantic + float(use[4]), 1e-8), LOW, HIGH))
        reciprocal = 1 / (constant + rank.astype(float))
        even = ranking_loss(reciprocal @ np.array([0.25, 0.25, 0.25, 0.25, 1.0]), mask)
        best = ranking_loss(reciprocal @ np.append(2 * share * view, 2 * (1 - share)), mask)
        views.append(view)
        shares.append(share)
        trusts.append(float(np.clip((even - best) / 0.35, 0, 1)))
    return np.array(views), np.array(shares), np.array(trusts)


def lbfgs(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int = 100, memory: int = 10) -> np.ndarray:
    """Minimise a smooth function that returns its value and gradient: two-loop recursion, backtracking steps."""
    f, g = loss(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.abs(g).max() < 1e-8:
            break
        d, alphas = -g, []
        for s, y in reversed(pairs):
            a = s @ d / (s @ y)
            alphas.append(a)
            d = d - a * y
        if pairs:
            s, y = pairs[-1]
            d = d * (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(alphas)):
            d = d + s * (a - y @ d / (s @ y))
        slope, step = g @ d, 1.0
        if slope >= 0:
            pairs, d, slope = [], -g, -(g @ g)
        while step > 1e-12:
            new = x + step * d
            fn, gn = loss(new)
            if fn <= f + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        if (new - x) @ (gn - g) > 1e-12:
            pairs = [*pairs, (new - x, gn - g)][-memory:]
        x, f, g = new, fn, gn
    return x


def train(x: np.ndarray, view: np.ndarray, share: np.ndarray, trust: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-3) -> Model:
    """Fit the heads to targets by cross-entropy; columns without spread keep a scale of 1."""
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale < 1e-5, 1.0, scale)
    z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], 1)
    w = np.ones(len(x)) / len(x) if weight is None else weight / weight.sum()
    d = z.shape[1]
    lift = lambda t: np.clip((t - LOW) / (HIGH - LOW), 0.01, 0.99)

    def views(p: np.ndarray) -> tuple[float, np.ndarray]:
        m = p.reshape(4, d)
        q = softmax(z @ m.T)
        return -float((w[:, None] * view * np.log(q + 1e-300)).sum()) + ridge * float((m[:, :-1] ** 2).sum()), (((q * view.sum(1, keepdims=True) - view) * w[:, None]).T @ z + 2 * ridge * np.concatenate([m[:, :-1], np.zeros((4, 1))], 1)).ravel()

    def binary(aim: np.ndarray) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
        def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
            q = sigmoid(z @ p)
            value = -float((w * (aim * np.log(q + 1e-300) + (1 - aim) * np.log(1 - q + 1e-300))).sum()) + ridge * float((p[:-1] ** 2).sum())
            return value, z.T @ (w * (q - aim)) + 2 * ridge * np.append(p[:-1], 0)

        return loss

    v = lbfgs(views, np.zeros(4 * d)).reshape(4, d)
    s, t = lbfgs(binary(lift(share)), np.zeros(d)), lbfgs(binary(np.clip(trust, 0.01, 0.99)), np.zeros(d))
    return Model(mean, scale, v[:, :-1], v[:, -1], s[:-1], float(s[-1]), t[:-1], float(t[-1]))


def report(ranked: DataFrame, positives: DataFrame) -> DataFrame:
    """Quality by kind and over all (kind null): mean reciprocal rank of the best and of the worst positive, and recall of all at 10 and 30.

    ranked (query_id, doc_id, rank), positives (query_id, doc_id, kind); a positive without rank counts as last.
    """
    last = ranked.groupBy("query_id").agg(F.max("rank").alias("last"))
    p = positives.join(ranked, ["query_id", "doc_id"], "left").join(last, "query_id", "left").withColumn("rank", F.coalesce(F.col("rank"), F.col("last") + 1, F.lit(1_000_000)))
    q = p.groupBy("query_id", "kind").agg(F.min("rank").alias("best"), F.max("rank").alias("worst"))
    return q.rollup("kind").agg(F.count("*").alias("n"), F.avg(1 / F.col("best")).alias("mrr"), F.avg(1 / F.col("worst")).alias("worst_mrr"),
                                F.avg((F.col("worst") <= 10).cast("double")).alias("all_at_10"), F.avg((F.col("worst") <= 30).cast("double")).alias("all_at_30"), F.avg("worst").alias("worst_rank"))


def candidates(pools: DataFrame, limits: dict[str, int], most: int = 257) -> DataFrame:
    """(query_id, doc_id, pool, slot): pools (query_id, doc_id, pool, priority, n) joined in the order of priority, without repeats, within each pool's limit and most in all."""
    first = pools.withColumn("k", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("priority", "n"))).where("k = 1").drop("k")
    limit = F.lit(most)
    for name, value in limits.items():
        limit = F.when(F.col("pool") == name, value).otherwise(limit)
    capped = first.withColumn("k", F.row_number().over(Window.partitionBy("query_id", "pool").orderBy("n", "doc_id"))).where(F.col("k") <= limit).drop("k")
    slot = F.row_number().over(Window.partitionBy("query_id").orderBy("priority", "n", "doc_id"))
    return capped.withColumn("slot", slot).where(F.col("slot") <= most).select("query_id", "doc_id", "pool", "slot")
