"""Checks of an atlas: views that collapse, vertices without edges, leaves of several parents, and how good a partition is."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Views whose edges overlap this much are one view.
COLLAPSED = 0.90


def isolated(documents: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id of documents at no end of an edge."""
    ends = edges.select(F.col("src").alias("doc_id")).unionByName(edges.select(F.col("dst").alias("doc_id"))).distinct()
    return documents.select("doc_id").join(ends, "doc_id", "left_anti")


def split_leaves(places: DataFrame) -> DataFrame:
    """(leaf, parents): leaves with documents of more than one parent; empty for a sound hierarchy."""
    return places.groupBy("leaf").agg(F.count_distinct("parent").alias("parents")).where("parents > 1")


def view_overlap(layers: dict[str, DataFrame], bound: float = COLLAPSED) -> DataFrame:
    """(left, right, jaccard, collapsed) for every two views; layers have distinct edges (src, dst). One pass over all edges."""
    names = list(layers)
    both = None
    for k, edges in enumerate(layers.values()):
        one = edges.select("src", "dst", F.lit(1 << k).alias("bit"))
        both = one if both is None else both.unionByName(one)
    masks = both.groupBy("src", "dst").agg(F.bit_or("bit").alias("mask"))
    pairs = list(combinations(range(len(names)), 2))
    has = lambda bits, every: (F.col("mask").bitwiseAND(bits) == bits) if every else (F.col("mask").bitwiseAND(bits) != 0)
    counts = masks.agg(*(F.count_if(has(1 << a | 1 << b, every)).alias(f"{'i' if every else 'u'}{a}_{b}") for a, b in pairs for every in (True, False)))
    share = lambda a, b: F.coalesce(F.col(f"i{a}_{b}") / F.nullif(F.col(f"u{a}_{b}"), F.lit(0)), F.lit(1.0))
    rows = F.array(*(F.struct(F.lit(names[a]).alias("left"), F.lit(names[b]).alias("right"), share(a, b).alias("jaccard"), (share(a, b) >= bound).alias("collapsed")) for a, b in pairs))
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def edge_gain(edges: DataFrame, communities: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(gain): how much more edge weight lies inside communities than their sizes explain, a weighted mean over layers.

    edges: layer, src, dst, weight; communities: doc_id, community. A layer without weight adds
    nothing, but counts among the weights.
    """
    a = communities.select(F.col("doc_id").alias("src"), F.col("community").alias("x"))
    b = communities.select(F.col("doc_id").alias("dst"), F.col("community").alias("y"))
    layer = edges.join(a, "src").join(b, "dst").groupBy("layer").agg(F.sum("weight").alias("total"), F.sum(F.when(F.col("x") == F.col("y"), F.col("weight")).otherwise(0.0)).alias("inside"))
    sizes = communities.groupBy("community").agg(F.count("*").alias("n"))
    null = sizes.agg((F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("null"))
    weight = F.lit(0.0)
    for name, value in weights.items():
        weight = F.when(F.col("layer") == name, value).otherwise(weight)
    gain = (F.col("inside") / F.col("total") - F.col("null")) / (1 - F.col("null"))
    rows = layer.where("total > 0").crossJoin(F.broadcast(null))  # one row
    return rows.agg((F.coalesce(F.sum(weight * gain), F.lit(0.0)) / sum(weights.values())).alias("gain"))


def adjacent_agreement(partitions: DataFrame) -> DataFrame:
    """(resolution, next_resolution, ari): the adjusted Rand index of each resolution's partition and the next one's.

    partitions: resolution, doc_id, community.
    """
    order = partitions.select("resolution").distinct().withColumn("next_resolution", F.lead("resolution").over(Window.orderBy("resolution")))  # few rows
    left = partitions.join(F.broadcast(order.where("next_resolution is not null")), "resolution")
    right = partitions.select(F.col("resolution").alias("next_resolution"), "doc_id", F.col("community").alias("other"))
    both = left.join(right, ["next_resolution", "doc_id"])
    cells = both.groupBy("resolution", "next_resolution", "community", "other").agg(F.count("*").alias("n"))
    keys = ["resolution", "next_resolution"]
    two = lambda n: n * (n - 1) / 2
    each = lambda by, name: cells.groupBy(*keys, by).agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sum(two(F.col("n"))).alias(name))
    sums = cells.groupBy(*keys).agg(F.sum(two(F.col("n"))).alias("s"), F.sum("n").alias("n")).join(each("community", "u"), keys).join(each("other", "v"), keys)
    chance = F.col("u") * F.col("v") / F.nullif(two(F.col("n")), F.lit(0.0))
    ari = (F.col("s") - chance) / F.nullif((F.col("u") + F.col("v")) / 2 - chance, F.lit(0.0))
    return sums.select(*keys, F.coalesce(ari, F.lit(1.0)).alias("ari"))


def resolution_score(communities: Column, target: Column, largest: Column, single: Column, seeds: Column, neighbours: Column, gain: Column, entropy: Column) -> Column:
    """The penalty of a resolution: communities against their aim, the largest and single ones' shares, agreement across seeds and resolutions, edge gain, size entropy."""
    return (
        0.20 * F.abs(F.log(communities / target)) + 3 * F.greatest(F.lit(0.0), largest - F.greatest(F.lit(0.08), 4 / target)) + 2 * single
        + 1.25 * (1 - seeds) + 0.35 * (1 - neighbours) + (1 - gain) + 0.35 * (1 - entropy)
    )


def best_resolution(rows: list[tuple[float, float]]) -> float:
    """The resolution of (resolution, score) rows with the least score, the lower of equal ones."""
    if not rows or any(math.isnan(s) for _, s in rows):
        raise ValueError("there must be resolutions with scores")
    return min(rows, key=lambda r: (r[1], r[0]))[0]


def complementary(all_views: set[str], parents: set[str], children: set[str]) -> None:
    """Raise unless the parents' and the children's views share none and are all views together."""
    if parents & children or parents | children != all_views:
        raise ValueError("parent and child views must be complementary")
