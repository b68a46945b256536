import re

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import atlas_checks, benchmarks, router, router_data, signatures


def plain_signature(view, doc_id, title, sentences, scores):
    """The same choice by a plain program, from the sentences and their scores."""
    words = lambda s: {t.lower() for t in re.findall(r"[^\W_]+(?:['’-][^\W_]+)*", s)}
    kept = []
    for k in sorted(range(len(sentences)), key=lambda k: (-scores[k], k)):
        w = words(sentences[k])
        if w and any(len(w & o) / len(w | o) >= 0.68 for _, o in kept):
            continue
        kept.append((sentences[k], w))
        if len(kept) == signatures.DIVERSE[view]:
            break
    n = signatures.UNIFORM[view]
    even = sentences if len(sentences) <= n else [sentences[int(p)] for p in np.linspace(0, len(sentences) - 1, n, dtype=np.int64)]
    budget = signatures.BUDGET[view]
    out = f"{signatures.DOCUMENT_INSTRUCTIONS[view]}\nView: {view}\nFile handle: D{doc_id}\nFilename/title: {title}\nSource domain: unknown-domain\nGrounded source excerpts:\n"
    for e in [s for s, _ in kept] + even:
        if len(out) + len(e) + 3 > budget:
            rest = budget - len(out) - 3
            out += "- " + e[:rest] if rest >= 80 else ""
            break
        out += f"- {e}\n"
    return out.strip()[:budget]


def test_document_signatures_equal_a_plain_program(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(1000, None), (1001, ""), (1002, "Short.")], "doc_id long, text string"))
    got = {(r.doc_id, r.view): r.signature for r in signatures.document_signatures(docs).collect()}
    held = docs.select("doc_id", X.clean_text(F.coalesce("text", F.lit(""))).alias("text")).select("doc_id", X.title(F.col("text"), F.col("doc_id")).alias("title"), X.usable_sentences(F.col("text")).alias("s"))
    each = held.select("doc_id", "title", F.posexplode_outer(F.when(F.size("s") > 0, F.col("s")).otherwise(F.array("title"))).alias("k", "sentence"))
    rows = each.select("doc_id", "title", "k", "sentence", *(v.alias(n) for n, v in X.view_scores(F.col("sentence")).items())).collect()
    texts = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.k)):
        texts.setdefault((r.doc_id, r.title), []).append(r)
    assert len(got) == 4 * len(texts) == 4 * 63
    for (doc_id, title), some in texts.items():
        for view in X.VIEWS:
            assert got[doc_id, view] == plain_signature(view, doc_id, title, [r.sentence for r in some], [float(r[view]) for r in some]), (doc_id, view)


def test_even_weights_and_targets():
    model = router.Model.zero(816)
    assert np.allclose(router.outputs(np.zeros((2, 816)), model), [[0.25] * 4 + [1.0]] * 2)
    r = np.random.default_rng(0)
    model.share, model.trust, model.view = r.normal(size=816), r.normal(size=816), r.normal(size=(4, 816))
    w = router.outputs(r.normal(size=(50, 816)) * 5, model)
    assert np.allclose(w.sum(1), 2, atol=2e-5) and (w > 0).all()
    ranks, positive = np.array([[[1, 2, 3, 4, 5], [3, 3, 3, 3, 3], [9, 8, 7, 6, 5]], [[1, 1, 1, 1, 90], [2, 9, 9, 9, 9], [3, 8, 8, 8, 1]]]), np.array([[True, False, False], [True, True, False]])
    view, share, trust = router.targets(ranks, positive)
    assert np.allclose(view.sum(1), 1) and ((share >= 0.2) & (share <= 0.8)).all() and ((trust >= 0) & (trust <= 1)).all()
    use = 0.5 * np.log2(10) ** -1 * 0 + np.array([1, 1 / np.log2(3), 0.5, 1 / np.log2(5)])
    e = np.exp((use - use.max()) / 0.06)
    assert np.allclose(view[0], e / e.sum())


def test_small_choices():
    assert atlas_checks.best_resolution([(0.4, 2.0), (0.2, 1.0), (0.1, 1.0)]) == 0.1
    found = router_data.calibration_grid(lambda a, b: (a * b, -b, a < 3), {"a": [1, 2, 3], "b": [1, 2]})
    assert found == {"a": 2, "b": 2} and router_data.calibration_grid(lambda a: (a, 0, False), {"a": [1, 5]}) == {"a": 5}
    assert sorted(router_data.permutation(9, 3)) == list(range(9)) and (router_data.permutation(9, 3) == router_data.permutation(9, 3)).all()


def test_features_are_assembled_in_order_or_raise(spark):
    import pytest

    vectors = spark.createDataFrame([(1, "a", [1.0, 2.0]), (1, "b", [3.0])], "query_id long, view string, values array<double>")
    stats = spark.createDataFrame([(1, "a", [4.0]), (1, "b", [5.0])], "query_id long, view string, values array<double>")
    form = spark.createDataFrame([(1, [6.0])], "query_id long, values array<double>")
    assert router_data.assemble(vectors, stats, form, ["a", "b"]).first().features == [1, 2, 3, 4, 5, 6]
    with pytest.raises(Exception, match="lacks a part"):
        router_data.assemble(vectors.limit(1), stats, form, ["a", "b"]).collect()


def test_nested_values_that_are_too_deep_raise(spark):
    import pytest

    rows = spark.createDataFrame([(1, '{"a": [[1, {"b": null}], "x"]}'), (2, "[]"), (3, "7"), (4, "not json")], "id long, j string")
    found = {(r.id, r.path): r.value for r in benchmarks.leaves(rows, "id", "j").collect()}
    assert found[1, "$/a/0/0"] == "1" and found[1, "$/a/1"] == "x" and found[3, "$"] == "7"
    with pytest.raises(Exception, match="too deep"):
        benchmarks.leaves(rows, "id", "j", levels=1).collect()
