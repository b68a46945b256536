import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import chains, evaluation, lexical, sampling, vectors


def test_bm25_against_brute_force(spark):
    docs = {1: "the cedar tree", 2: "the oak and the ash", 3: "cedar cedar ash", 4: None, 5: ""}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    q = spark.createDataFrame([(7, ["cedar", "ash", "none"])], "query_id long, terms array<string>")
    got = {r.doc_id: r.score for r in lexical.bm25(frame, q).collect()}
    words = {k: (v or "").split() for k, v in docs.items()}
    mean = sum(map(len, words.values())) / 5
    want = {}
    for k, w in words.items():
        s = 0.0
        for t in ("cedar", "ash"):
            df = sum(t in x for x in words.values())
            idf = math.log((5 - df + 0.5) / (df + 0.5))
            tf = w.count(t)
            s += (idf if idf > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean)) if tf else 0
        if s:
            want[k] = s
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_matching_modes(spark):
    docs = spark.createDataFrame([(1, "A b c"), (2, "b a"), (3, "x")], "doc_id long, text string")
    ids = lambda mode: sorted(r[0] for r in lexical.matching(docs, ["a", "b"], mode).collect())
    assert ids("any") == [1, 2] and ids("all") == [1, 2] and ids("phrase") == [1]
    with pytest.raises(ValueError):
        lexical.matching(docs, ["a"], "raw")


def test_nearest_is_exact_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    x = np.random.default_rng(1).normal(size=(50, 8))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r.src, r["rank"]): r.dst for r in vectors.nearest(frame, 3).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    best = np.argsort(-s, axis=1)[:, :3]
    assert all(got[i, k + 1] == best[i, k] for i in range(50) for k in range(3))


def test_layer_and_agreement(spark):
    n = spark.createDataFrame([(0, 1, 0.9, 1), (1, 0, 0.9, 1), (2, 0, 0.5, 1)], "src long, dst long, sim double, rank int")
    edges = {(r.src, r.dst): r.weight for r in vectors.layer(n, 1).collect()}
    assert set(edges) == {(0, 1), (0, 2)} and edges[0, 1] > edges[0, 2]
    e = vectors.layer(n, 1)
    assert vectors.edge_jaccard(e, e).first()[0] == 1.0 and vectors.edge_jaccard(e.limit(0), e.limit(0)).first()[0] == 1.0
    labels = spark.createDataFrame([(0, 1), (0, 1), (1, 2), (1, 2)], "a int, b int")
    assert abs(vectors.partition_agreement(labels, "a", "b").first()[0] - 1) < 1e-12


def test_chains_and_overlap(spark):
    edges = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.8), (2, 3, 0.1)], "src long, dst long, weight double")
    assert sorted(map(tuple, chains.chains(edges).collect())) == [(1, 2, 3), (2, 1, 3), (3, 1, 2)]
    r = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "query_id long, doc_id long, rank int")
    assert abs(chains.rank_biased_overlap(r, r, 2).first().rbo - (0.1 + 0.09)) < 1e-12


def test_endpoint_and_costs(spark):
    rows = spark.createDataFrame([("a", True, True, 3, 2.0, 0.5), ("b", False, None, None, None, None)], "query_id string, is_correct boolean, terminal_valid boolean, turn_count int, agent_cost double, judge_cost double")
    s = evaluation.endpoint_summary(rows)
    r = s.first()
    assert (r.total, r.correct, r.agent_cost, r.judge_cost, r.turns, r.terminal_invalid) == (2, 1, 2.0, 0.5, 3, 0)
    assert evaluation.comparable_cost(s, "USD", "USD").first().comparable_cost == 2.5
    assert evaluation.comparable_cost(s, "USD", "CNY", ("agent",)).first().comparable_cost == 2.0
    with pytest.raises(ValueError):
        evaluation.comparable_cost(s, "USD", "CNY")
    with pytest.raises(ValueError):
        evaluation.comparable_cost(s, "USD", "USD", ("tools",))


def test_checkpoints_never_fill_back(spark):
    rows = spark.createDataFrame([(3, True)], "turn_count int, is_correct boolean")
    assert [(r.boundary, r.completed, r.correct) for r in evaluation.checkpoints(rows, [2, 3], "turn_count").orderBy("boundary").collect()] == [(2.0, 0, 0), (3.0, 1, 1)]


def test_ledger_and_trigger(spark):
    rows = spark.createDataFrame([("q", "D1", 1, 5, "search", "seen"), ("q", "D1", 2, 2, "route", "opened"), ("q", "D1", 3, 9, "search", "dismissed"), ("q", "D2", 4, 1, "route", "dismissed")],
                                 "query_id string, handle string, sequence int, rank int, source string, action string")
    got = {r.handle: r for r in evaluation.lead_ledger(rows).collect()}
    assert got["D1"].status == "opened" and got["D1"].best_rank == 2 and got["D1"].sources == ["search", "route"] and got["D2"].status == "dismissed"
    turns = evaluation.running_cost(spark.createDataFrame([("q", 1, 0.4), ("q", 2, 0.7), ("q", 3, 0.1)], "q string, t int, c double"), "q", ["t"], "c")
    assert evaluation.budget_trigger(turns, "q", 1.0, 99).first().turn == 2 and evaluation.budget_trigger(turns, "q", 9.0, 3).first().turn == 3


def test_running_costs_are_exact(spark):
    lists = {"tenths": [0.1] * 12, "null": [None, 0.1, None, 0.2], "third": [0.5, 1 / 3, 0.25], "large": [1e300, 1.0], "nan": [0.5, float("nan")], "below": [-0.1, 0.3]}
    rows = spark.createDataFrame([(q, t, c) for q, costs in lists.items() for t, c in enumerate(costs)], "q string, t int, c double")
    turns = evaluation.running_cost(rows, "q", ["t"], "c")
    got = {q: [r.running for r in turns.where(F.col("q") == q).orderBy("turn").collect()] for q in lists}
    assert got["tenths"] == [k / 10 for k in range(1, 13)] and got["null"] == [None, 0.1, 0.1, 0.3] and got["below"] == [-0.1, 0.2]
    assert got["third"] == [0.5, 0.5 + 1 / 3, 0.5 + 1 / 3 + 0.25] and got["large"] == [1e300, 1e300 + 1.0] and got["nan"][0] == 0.5 and got["nan"][1] != got["nan"][1]
    # ten doubles of 0.1 add up to 0.9999999999999999
    assert evaluation.budget_trigger(turns.where("q = 'tenths'"), "q", 1.0, 99).first().turn == 10


def test_graded_retrieval_counts_missing_runs(spark):
    ranks = spark.createDataFrame([("q", "a", 1)], "query_id string, doc_id string, rank int")
    grades = spark.createDataFrame([("q", "a", 1.0), ("q", "z", 0.0), ("r", "b", 2.0)], "query_id string, doc_id string, grade double")
    got = {r.query_id: (r.ndcg_at_10, r.recall_at_10) for r in evaluation.graded_retrieval(ranks, grades).collect()}
    assert got == {"q": (1.0, 1.0), "r": (0.0, 0.0)}


def test_samples(spark):
    rows = spark.range(1000).withColumn("g", F.col("id") % 3)
    got = {r.split: r["count"] for r in sampling.hash_split(rows, "id", "s").groupBy("split").count().collect()}
    assert got == {"train": 700, "validation": 150, "test": 150}
    assert sampling.split_counts(7) == [5, 1, 1]
    assert sampling.stratified(rows, "g", "id", 4, "s").count() == 12
    assert {r.unique_id for r in sampling.occurrence(spark.createDataFrame([("x", 2), ("x", 1)], "k string, o int"), "k", "o").collect()} == {"x", "x__dup2"}
    page = sampling.page(rows.select("id"), ["id"], 990, 20).collect()
    assert len(page) == 10 and page[0].remaining == 0
    with pytest.raises(ValueError):
        sampling.page(rows, ["id"], -1, 5)
