"""Deterministic samples, splits and quotas by hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def digest(*parts: Column | str) -> Column:
    """The sha256 of parts joined by colons: an order that no run changes."""
    return F.sha2(F.concat_ws(":", *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts)).cast("binary"), 256)


def split_counts(n: int, shares: tuple[float, ...] = (0.70, 0.15, 0.15)) -> list[int]:
    """n rows dealt by shares: whole parts first, then the largest remainders."""
    exact = [n * s for s in shares]
    out = [int(x) for x in exact]
    for i in sorted(range(len(shares)), key=lambda i: (-(exact[i] - out[i]), i))[: n - sum(out)]:
        out[i] += 1
    return out


def hash_split(rows: DataFrame, key: str, seed: str, names: tuple[str, ...] = ("train", "validation", "test"), shares: tuple[float, ...] = (0.70, 0.15, 0.15)) -> DataFrame:
    """rows with split: the first share of all keys in the order of their digests, then the next.

    The cut-offs are found from counts of digest prefixes, so no window runs over all rows: only
    the prefixes in which a cut-off lies are ordered.
    """
    keyed = rows.withColumn("_digest", digest(F.lit(seed), F.col(key))).withColumn("_prefix", F.substring("_digest", 1, 3))
    sizes = {r["_prefix"]: r["n"] for r in keyed.groupBy("_prefix").agg(F.count("*").alias("n")).collect()}  # at most 4096 rows
    counts, before, at = split_counts(sum(sizes.values()), shares), {}, 0
    for prefix in sorted(sizes):
        before[prefix] = at
        at += sizes[prefix]
    table = rows.sparkSession.createDataFrame(sorted(before.items()) or [("", 0)], "_prefix string, _before long")
    order = Window.partitionBy("_prefix").orderBy("_digest", key)
    placed = keyed.withColumn("_n", F.row_number().over(order)).join(F.broadcast(table), "_prefix").withColumn("_n", F.col("_n") + F.col("_before"))
    split, bound = F.lit(names[-1]), sum(counts)
    for name, count in reversed(list(zip(names, counts))[:-1]):
        bound = sum(counts[: names.index(name) + 1])
        split = F.when(F.col("_n") <= bound, name).otherwise(split)
    return placed.withColumn("split", split).drop("_digest", "_prefix", "_n", "_before")


def stratified(rows: DataFrame, by: str, key: str, most: int, seed: str) -> DataFrame:
    """At most so many rows of each group, in the order of their digests."""
    order = Window.partitionBy(by).orderBy(digest(F.lit(seed), F.col(key)), key)
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def prefix_sample(rows: DataFrame, by: str, key: str, fraction: float, seed: str) -> DataFrame:
    """The first max(1, round(n * fraction)) rows of each group by digest; halves go to even numbers."""
    order = Window.partitionBy(by).orderBy(digest(F.lit(seed), F.col(key)), key)
    size = F.greatest(F.lit(1), F.rint(F.count("*").over(Window.partitionBy(by)) * fraction))
    return rows.withColumn("_n", F.row_number().over(order)).withColumn("_most", size).where("_n <= _most").drop("_n", "_most")


def quota_fill(rows: DataFrame, quotas: DataFrame, by: list[str], key: str, seed: str) -> DataFrame:
    """For each group the first quota rows by digest; quotas has by and quota."""
    order = Window.partitionBy(*by).orderBy(digest(F.lit(seed), F.col(key)), key)
    return rows.join(quotas, by).withColumn("_n", F.row_number().over(order)).where("_n <= quota").drop("_n", "quota")


def occurrence(rows: DataFrame, key: str, order: str) -> DataFrame:
    """rows with occurrence, the running number of each key, and unique_id, the key with __dupN from the second on."""
    w = Window.partitionBy(key).orderBy(order)
    rows = rows.withColumn("occurrence", F.row_number().over(w))
    text = F.col(key).cast("string")
    return rows.withColumn("unique_id", F.when(F.col("occurrence") == 1, text).otherwise(F.concat(text, F.lit("__dup"), F.col("occurrence").cast("string"))))


def page(rows: DataFrame, order: list[Column | str], offset: int, limit: int, most: int = 50) -> DataFrame:
    """limit rows from offset, with remaining, the number of rows behind them."""
    if offset < 0 or not 1 <= limit <= most:
        raise ValueError(f"offset must not be negative, and limit must be 1 to {most}")
    total = rows.agg(F.count("*").alias("_total"))
    out = rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))
    return out.withColumn("remaining", F.greatest(F.lit(0), F.col("_total") - offset - limit)).drop("_total")
