import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import projection, regions, router
from tessera.plans.navigator import Navigator, viewport


@pytest.fixture(scope="module")
def two_clusters(spark):
    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(size=(15, 6)) * 0.1 + c for c in (np.eye(6)[0], np.eye(6)[3])])
    return x, spark.createDataFrame([(i, i // 15, v.tolist()) for i, v in enumerate(x)], "id long, g long, embedding array<double>")


def clique(a, b):
    return [(i, j, 1.0) for i in range(a, b) for j in range(i + 1, b)]


def test_projection_is_unit_and_matches_numpy(two_clusters):
    x, frame = two_clusters
    a, b = projection.fit(frame, 3)
    values, parts = np.linalg.eigh(np.cov(x.T, bias=True))
    v = parts[:, np.argsort(-values)[:3]].T
    v *= np.sign(v[np.arange(3), np.abs(v).argmax(1)])[:, None]
    assert np.allclose(a, v * np.sort(values)[::-1][:3, None] ** -0.25) and np.allclose(b, -a @ x.mean(0))
    y = np.array([r.embedding for r in projection.project(frame, a, b).orderBy("id").collect()])
    assert np.allclose(np.linalg.norm(y, axis=1), 1)
    assert np.allclose(projection.fit(frame, 6)[0], np.eye(6))


def test_communities_and_hierarchy(spark):
    edges = clique(0, 6) + clique(6, 11) + clique(11, 16) + [(0, 6, 0.01), (6, 11, 0.8)]
    s, d, w = (np.array(c) for c in zip(*edges))
    label = regions.communities(16, [(s, d, w, 1.0)])
    assert label.tolist() == [0] * 6 + [1] * 5 + [2] * 5
    vertices = spark.range(17).select("id")
    out = regions.hierarchy(vertices, spark.createDataFrame(edges, "src long, dst long, weight double")).collect()
    assert len(out) == 17 and len({r.parent for r in out if r.id < 6}) == 1
    assert all(len({r.parent for r in out if r.leaf == k}) == 1 for k in {r.leaf for r in out})
    with pytest.raises(ValueError):
        regions.hierarchy(vertices, spark.createDataFrame(edges, "src long, dst long, weight double"), most_vertices=3)
    assert [n for _, n, _ in regions.resolutions(16, pd.DataFrame(edges, columns=["src", "dst", "weight"]), [1.0], [0, 1])] == [3.0]


def test_representatives_and_cards(spark, two_clusters):
    _, frame = two_clusters
    chosen = regions.representatives(frame, "g", 3)
    rows = chosen.collect()
    assert len(rows) == 6 and all(r.id // 15 == r.g for r in rows)
    membership = frame.select("id", F.lit(0).cast("long").alias("parent"), F.col("g").alias("leaf"))
    edges = spark.createDataFrame([(0, 16, 1.0)], "src long, dst long, weight double")
    cards = {r.leaf: r for r in regions.cards(membership, chosen.withColumnRenamed("g", "leaf"), edges, frame.select("id", F.lit("t").alias("title"))).collect()}
    assert cards[0].address == "C000/S00" and cards[0].size == 15 and len(cards[0].representatives) == 3 and cards[0].bridges[0].to == "C000/S01"


def test_router_weights_sum_to_two_and_learn(spark):
    assert np.allclose(router.outputs(np.zeros((1, 5)), router.Model.zero(5)), [[0.25, 0.25, 0.25, 0.25, 1.0]])
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 5))
    best = (x[:, 0] > 0).astype(int)
    ranks = np.full((300, 3, 5), 50.0)
    ranks[np.arange(300), 0, best] = 1
    positive = np.zeros((300, 3), bool)
    positive[:, 0] = True
    view, share, trust = router.targets(ranks, positive)
    assert np.allclose(view.sum(1), 1) and (share >= 0.2).all() and (share <= 0.8).all() and (trust >= 0).all() and (trust <= 1).all()
    m = router.train(x, view, share, trust)
    w = router.outputs(x, m)
    assert np.allclose(w.sum(1), 2) and (w[:, :2].argmax(1) == best).mean() > 0.95
    q = spark.createDataFrame([(1, [0.0] * 5)], "query_id long, features array<double>")
    assert router.route(q, router.Model.zero(5)).count() == 5


def test_lbfgs_and_report(spark):
    x = router.lbfgs(lambda p: (float(((p - 3) ** 2 * [1, 50]).sum()), 2 * (p - 3) * [1, 50]), np.zeros(2))
    assert np.allclose(x, 3)
    ranked = spark.createDataFrame([("q", 1, 1), ("q", 2, 20), ("r", 1, 4)], "query_id string, doc_id long, rank int")
    positives = spark.createDataFrame([("q", 1, "pair"), ("q", 2, "pair"), ("r", 1, "single")], "query_id string, doc_id long, kind string")
    got = {r.kind: r for r in router.report(ranked, positives).collect()}
    assert got["pair"].mrr == 1.0 and got["pair"].worst_mrr == 0.05 and got[None].n == 2 and got["single"].all_at_10 == 1.0


def test_candidates_respect_pools(spark):
    pools = spark.createDataFrame([("q", 1, "a", 1, 1), ("q", 2, "a", 1, 2), ("q", 1, "b", 2, 1), ("q", 3, "b", 2, 2), ("q", 4, "b", 2, 3)], "query_id string, doc_id long, pool string, priority int, n int")
    got = [(r.doc_id, r.slot) for r in router.candidates(pools, {"a": 1, "b": 2}).orderBy("slot").collect()]
    assert got == [(1, 1), (3, 2), (4, 3)]


def test_navigator(spark):
    docs = spark.createDataFrame([(1, "Title: Cedar\ncedar tree\noak", ""), (2, "oak oak tree", ""), (3, "ash", ""), (4, "birch wood", "")], "doc_id long, text string, url string")
    member = spark.createDataFrame([(1, 0, 0), (2, 0, 1), (3, 1, 2), (4, 1, 2)], "doc_id long, parent long, leaf long")
    scores = spark.createDataFrame([(1, 0.9), (2, 0.5), (3, 0.7), (4, 0.1)], "doc_id long, score double")
    n = Navigator(docs, member, scores)
    assert [r.address for r in n.overview().collect()] == ["C000", "C001"]
    assert [r.address for r in n.expand("C000").collect()] == ["C000/S00", "C000/S01"]
    assert [r.handle for r in n.files("C001/S00").collect()] == ["D3", "D4"]
    assert n.locate("D2").first().address == "C000/S01"
    assert {r.handle for r in n.search("cedar").collect()} == {"D1"} and n.search("oak", address="C001").count() == 0
    assert {r.handle for r in n.search("oak tree", "phrase").collect()} == {"D2"}
    assert n.route("oak").first().parent == 0
    assert [r.text for r in n.open("D1", start=2, lines=1).collect()] == ["cedar tree"]
    assert [r.line for r in n.open("D1", find="tree", context=0).collect()] == [2]
    with pytest.raises(ValueError):
        n.expand("X1")
    with pytest.raises(ValueError):
        n.overview(-1)
    v = viewport(scores.withColumn("query_id", F.lit(7)), member, 1, 1).collect()
    assert [(r.parent, r.doc_id) for r in v] == [(0, 1)]
