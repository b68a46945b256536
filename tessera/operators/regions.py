"""Regions: communities over several weighted layers, two levels deep, with representatives and cards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.vectors import bridges

#: Redundancy that a representative's centrality is lowered by.
REDUNDANCY = 0.18


def communities(n: int, layers: list[tuple[np.ndarray, np.ndarray, np.ndarray, float]], resolution: float = 1.0, seed: int = 0, rounds: int = 10) -> np.ndarray:
    """A label for each of n vertices: local moves and aggregation on the sum of the layers' modularities.

    A layer is (src, dst, weight, share). A vertex moves to the neighbouring community with the
    largest gain, sum of share * (links - resolution * degree * total / 2m). Labels are numbered by
    size, then by the first member.
    """
    rng = np.random.default_rng(seed)
    where = np.arange(n)
    levels = [(np.concatenate([s, d]), np.concatenate([d, s]), np.concatenate([w, w]).astype(float), share) for s, d, w, share in layers if len(s)]
    while True:
        size = int(where.max(initial=-1)) + 1
        folded = []
        for s, d, w, share in levels:
            key, at = np.unique(where[s].astype(np.int64) * size + where[d], return_inverse=True)
            folded.append((key // size, key % size, np.bincount(at, w), share))
        label = np.arange(size)
        degree = [np.bincount(s, w, size) for s, _, w, _ in folded]
        total = [x.copy() for x in degree]
        twice = [max(x.sum(), 1e-12) for x in degree]
        near: list[list[tuple[int, int, float]]] = [[] for _ in range(size)]
        for k, (s, d, w, share) in enumerate(folded):
            for i, j, x in zip(s.tolist(), d.tolist(), (w * share).tolist()):
                if i != j:
                    near[i].append((k, j, x))
        moved_ever = False
        for _ in range(rounds):
            moved = False
            for i in rng.permutation(size).tolist():
                links: dict[int, float] = {}
                for _, j, x in near[i]:
                    links[label[j]] = links.get(label[j], 0.0) + x
                own = int(label[i])
                for k in range(len(folded)):
                    total[k][own] -= degree[k][i]
                gain = lambda c: links.get(c, 0.0) - resolution * sum(folded[k][3] * degree[k][i] * total[k][c] / twice[k] for k in range(len(folded)))  # noqa: B023, E731
                best = max(sorted({own, *links}), key=lambda c: (gain(c) + (1e-12 if c == own else 0)))
                label[i] = best
                for k in range(len(folded)):
                    total[k][best] += degree[k][i]
                moved |= best != own
            moved_ever |= moved
            if not moved:
                break
        _, label = np.unique(label, return_inverse=True)
        where = label[where]
        if not moved_ever or len(np.unique(label)) == size:
            break
    sizes, first = np.bincount(where, minlength=1), {}
    for i, c in enumerate(where.tolist()):
        first.setdefault(c, i)
    order = sorted(first, key=lambda c: (-sizes[c], first[c]))
    rank = {c: k for k, c in enumerate(order)}
    return np.array([rank[c] for c in where.tolist()], np.int64)


def hierarchy(vertices: DataFrame, edges: DataFrame, parent_resolution: float = 1.0, leaf_resolution: float = 1.5, most_vertices: int = 200_000) -> DataFrame:
    """(id, parent, leaf): communities of the whole graph, then of each parent's own part, one task for each parent.

    The graph of parents is held on the driver, so vertices are limited to most_vertices; leaves
    are numbered over all parents in the order of parents.
    """
    ids = [r[0] for r in vertices.select("id").orderBy("id").limit(most_vertices + 1).collect()]
    if len(ids) > most_vertices:
        raise ValueError(f"more than {most_vertices} vertices: build the parents over a sample of leaves instead")
    at = {v: k for k, v in enumerate(ids)}
    e = edges.select("src", "dst", "weight").toPandas()
    label = communities(len(ids), [(e.src.map(at).to_numpy(), e.dst.map(at).to_numpy(), e.weight.to_numpy(), 1.0)], parent_resolution) if len(ids) else np.zeros(0, int)
    spark = vertices.sparkSession
    parents = spark.createDataFrame(pd.DataFrame({"id": ids, "parent": label.tolist()}), "id long, parent long") if ids else spark.createDataFrame([], "id long, parent long")
    inner = edges.join(parents.select(F.col("id").alias("src"), "parent"), "src").join(parents.select(F.col("id").alias("dst"), F.col("parent").alias("p")), "dst").where("parent = p")

    def split(key: tuple, members: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        members = members.sort_values("id")
        place = {v: k for k, v in enumerate(members.id)}
        layers = [(links.src.map(place).to_numpy(), links.dst.map(place).to_numpy(), links.weight.to_numpy(), 1.0)] if len(links) else []
        local = communities(len(members), layers, leaf_resolution) if layers else np.zeros(len(members), int)
        return pd.DataFrame({"id": members.id, "parent": members.parent, "local": local})

    out = parents.groupBy("parent").cogroup(inner.select("src", "dst", "weight", F.col("parent").alias("inside")).groupBy("inside")).applyInPandas(split, "id long, parent long, local long")
    numbers = out.select("parent", "local").distinct().withColumn("leaf", F.row_number().over(Window.orderBy("parent", "local")) - 1)  # a row for each leaf
    return out.join(numbers, ["parent", "local"]).select("id", "parent", "leaf")


def representatives(vectors: DataFrame, group: str, count: int, key: str = "id", column: str = "embedding") -> DataFrame:
    """(group, key, n): each group's members chosen one by one, by closeness to the centroid less 0.18 times the largest likeness to those chosen.

    The pool of a group is its 20 * count, at least 80, members nearest to the centroid, chosen
    before any task sees the group.
    """
    from tessera.functions.numbers import dot, unit
    from tessera.operators.vectors import centroids

    unit_vectors = vectors.select(group, key, unit(F.col(column)).alias("v"))
    near = unit_vectors.join(centroids(vectors, group, column), group).withColumn("centrality", F.round(dot(F.col("v"), F.col("centroid")), 9))
    order = Window.partitionBy(group).orderBy(F.col("centrality").desc(), key)
    pool = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= max(80, 20 * count)).select(group, key, "v", "centrality", "n")

    def choose(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("n")
        x, c = np.stack(f.v.to_numpy()), f.centrality.to_numpy()
        like, taken = np.zeros(len(f)), []
        while len(taken) < min(count, len(f)):
            score = c - REDUNDANCY * like
            score[taken] = -np.inf
            i = int(score.argmax())
            taken.append(i)
            like = np.maximum(like, x @ x[i])
        return pd.DataFrame({group: f[group].iloc[taken].to_numpy(), key: f[key].iloc[taken].to_numpy(), "n": range(1, len(taken) + 1)})

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    return pool.groupBy(group).applyInPandas(choose, f"`{group}` {kinds[group]}, `{key}` {kinds[key]}, n int")


def cards(membership: DataFrame, chosen: DataFrame, edges: DataFrame, titles: DataFrame) -> DataFrame:
    """(leaf, address, size, representatives, bridges) of each leaf; titles (id, title)."""
    numbered = membership.select("parent", "leaf").distinct().withColumn("k", F.row_number().over(Window.partitionBy("parent").orderBy("leaf")) - 1)
    numbered = numbered.withColumn("address", F.format_string("C%03d/S%02d", "parent", "k"))
    sizes = membership.groupBy("leaf").agg(F.count("*").alias("size"))
    heads = chosen.join(titles, "id").groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("n", "id", "title"))).alias("representatives"))
    links = bridges(edges, membership.select("id", "leaf")).join(numbered.select(F.col("leaf").alias("other"), F.col("address").alias("to")), "other")
    links = links.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("rank", "to", "weight"))).alias("bridges"))
    return numbered.select("leaf", "address").join(sizes, "leaf").join(heads, "leaf", "left").join(links, "leaf", "left")


def resolutions(n: int, edges: pd.DataFrame, grid: list[float], seeds: list[int]) -> Iterator[tuple[float, float, float]]:
    """(resolution, mean number of regions, mean agreement between neighbouring seeds) for each resolution."""
    for r in grid:
        labels = [communities(n, [(edges.src.to_numpy(), edges.dst.to_numpy(), edges.weight.to_numpy(), 1.0)], r, s) for s in seeds]
        same = [np.mean((a[:, None] == a) == (b[:, None] == b)) for a, b in zip(labels, labels[1:])]
        yield r, float(np.mean([x.max(initial=0) + 1 for x in labels])), float(np.mean(same)) if same else 1.0
