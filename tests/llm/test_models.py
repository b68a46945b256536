import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from tessera.llm import langid, quality, toxicity
from tessera.llm.words import word_hashes

vocab = pytest.importorskip("public_tokenizers")
PATH = vocab.path("piece_bpe_32k.model")


def test_forward_sums_all_segmentations():
    names = langid.vocabulary(PATH)
    pieces, words = langid.Pieces(names), ["▁hello", "▁énsß", "▁漢字kanji", "▁" + "ab" * 20]
    chances = np.random.default_rng(0).random((len(names) + 1, 3)) * 1e-3
    got = langid.Lattice(words, pieces).scores(chances)
    for k, t in enumerate(words):
        alpha = [np.ones(3)]
        for i in range(1, len(t) + 1):
            options = [(j, names.get(t[j:i], len(names) if j == i - 1 else None)) for j in range(max(0, i - langid.PIECE), i)]
            alpha.append(sum((alpha[j] * chances[p] for j, p in options if p is not None), np.zeros(3)))
        assert np.allclose(np.log(alpha[-1]), got[k])


def test_long_words_and_pieces_are_summed_whole():
    import sentencepiece

    names = langid.vocabulary(PATH)
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert max(map(len, names)) == max(len(model.id_to_piece(i)) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    chances = np.random.default_rng(1).random((len(names) + 1, 2)) * 1e-3
    words = ["x" * 47 + "information" * 12, "representation", "ünd" * 900]
    scorer = langid.Scorer(langid.Model(PATH, ["a", "b"], chances))
    got = scorer.rows(words)
    weights = np.array([[1.0, 2.0]] * len(words))
    uses = sum(langid.Lattice([langid.START + w], scorer.pieces).expected(chances, weights[:1]) for w in words)
    want = np.zeros_like(chances)
    for k, w in enumerate(words):
        t, n = langid.START + w, len(w) + 1
        edges = [(j, i, p) for i in range(1, n + 1) for j in range(max(0, i - 16), i) if (p := names.get(t[j:i], len(names) if j == i - 1 else None)) is not None]
        alpha, beta = np.full((n + 1, 2), -np.inf), np.full((n + 1, 2), -np.inf)
        alpha[0] = beta[n] = 0
        for j, i, p in edges:
            alpha[i] = np.logaddexp(alpha[i], alpha[j] + np.log(chances[p]))
        for j, i, p in reversed(edges):
            beta[j] = np.logaddexp(beta[j], beta[i] + np.log(chances[p]))
        for j, i, p in edges:
            want[p] += np.exp(alpha[j] + np.log(chances[p]) + beta[i] - alpha[n]) * weights[0]
        assert np.allclose(scorer.table[got[k]], alpha[n])
    assert np.allclose(uses, want)


def test_language_id_on_held_out_rows(spark, sf, odd, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = langid.identify(docs, PATH).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 20 and sum(x.lang_pred == x.lang for x in rows) >= 0.97 * len(rows)
    found = {x.doc_id: x for x in langid.identify(odd, PATH).collect()}
    assert all(found[i].lang_pred == "und" for i in (4, 5, 6, 9)) and found[1].lang_pred == "xx" and 0 <= found[1].score <= 1
    assert langid.identify(empty, PATH).count() == 0
    assert {x.lang_pred for x in langid.identify(odd.withColumn("lang", F.lit(None).cast("string")), PATH).collect()} == {"und"}
    kept = langid.accepted(odd, PATH)
    assert kept.columns == odd.columns and not {4, 5, 6, 9} & {x.doc_id for x in kept.collect()}


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_base_counts_equal_brute_force():
    texts = ["a b c a b c d", "x\nx\n\n \nx y#", None, "", "one two", "w " * 80, prose(3, 300) + " $% | é ö"]
    got = quality.base_counts(texts, *word_hashes(texts, lower=False))
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c, mark = Counter(zip(w, w[1:], w[2:])), set()
        for k in range(len(w) - 2):
            if c[tuple(w[k : k + 3])] > 1:
                mark |= {k, k + 1, k + 2}
        filled = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(filled) - len(set(filled)), len(mark))
        assert tuple(int(got[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want


def test_quality_separates_held_out_rows(spark, odd, empty):
    r = random.Random(1)
    good = [(k, prose(k, 120)) for k in range(150)]
    bad = [(1000 + k, " ".join(w.upper() + "!!" for w in prose(k, 120).split())) for k in range(60)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    known = labels(spark, [(i, int(i < 1000), 0) for i, _ in good + bad if r.random() < 0.6])
    model = quality.train(docs, known)
    rows = quality.rate(docs, model).collect()
    assert all(x.kept == (x.doc_id < 1000) for x in rows if not x.base_failed) and all(0 <= x.chance <= 1 for x in rows)
    found = {x.doc_id: x for x in quality.rate(odd, model).collect()}
    assert all(found[i].base_failed and not found[i].kept and found[i].n_words == 0 for i in (4, 5, 6))
    assert quality.rate(empty, model).count() == 0
    none = quality.train(docs, known.limit(0))
    assert all(x.kept != x.base_failed for x in quality.rate(docs, none).collect())


def test_toxicity_is_learned_and_located(spark, odd, empty):
    r, rows, known = random.Random(2), [], []
    for k in range(300):
        text, bad = prose(k, 100), k % 4 == 0
        if bad:
            lines = text.split("\n")
            lines[3] = "you scumbag" + r.choice(["", "s"]) + " are trashy. " + lines[3]
            text = "\n".join(lines)
        rows.append((k, text))
        known.append((k, 1, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = toxicity.rate(docs, labels(spark, known)).collect()
    held = [x for x in found if x.held_out]
    assert len(held) > 30 and all(x.predicted == int(x.doc_id % 4 == 0) for x in held)
    texts = dict(rows)
    for x in held:
        for s in x.sentences:
            assert "scumbag" in texts[x.doc_id][s.start : s.end]
    model = toxicity.train(docs, labels(spark, known))
    strange = {x.doc_id: x for x in toxicity.score(odd, model).collect()}
    assert all(strange[i].score == 0 for i in (4, 5, 6)) and all(0 <= x.score <= 1 for x in strange.values())
    assert toxicity.score(empty, model).count() == 0
    assert {x.predicted for x in toxicity.rate(docs, labels(spark, [])).collect()} == {0}


def test_letters_and_words():
    assert [langid.has_letter(t) for t in ("½ ²", "Ⅷ", "12 _", "x", "漢", "²é")] == [False, False, False, True, True, True]
    assert langid.words_of("Ab\u00a0c d\x1ce\tF") == ["ab\u00a0c", "d\x1ce", "f"]


def test_calibration_and_samples_are_bounded(spark):
    from tessera.llm.learning import labelled_sample, platt, sigmoid

    r = np.random.default_rng(4)
    z = r.normal(0, 2, 4000)
    y = (r.random(4000) < sigmoid(1.7 * z - 0.4)).astype(float)
    slope, intercept = platt(z, y)
    assert abs(slope - 1.7) < 0.2 and abs(intercept + 0.4) < 0.15
    docs = spark.createDataFrame([(k % 3, f"t{k % 2}") for k in range(60)], "doc_id long, text string")
    found = labelled_sample(docs, labels(spark, [(0, 1, 0), (0, 0, 0), (1, 0, 0), (2, 1, 1)]), "quality", 2).collect()
    assert len(found) == 2 and {x.text for x in found} == {"t0"}


def test_toxicity_equals_brute_force(spark):
    """The score is one minus the product of the sentences' chances of being clean, from the model's weights."""
    weights = np.random.default_rng(5).normal(0, 1, toxicity.WEIGHTS)
    model = toxicity.Model(weights, -2.0)
    docs = spark.createDataFrame([(k, prose(k, 60 + k) + (" ... !!" if k % 2 else "")) for k in range(12)], "doc_id long, text string")
    texts = {x.doc_id: x.text for x in docs.collect()}
    for x in toxicity.score(docs, model).collect():
        clean = 1.0
        for sentence in re.findall(r"[^.!?\n]+[.!?\n]*", texts[x.doc_id]):
            words = {w.strip(toxicity.EDGES) for w in sentence.lower().split()} - {""}
            if words:
                z = sum(float(model.weights[toxicity.features(w)].sum()) for w in words) + model.bias
                clean *= 1 - 1 / (1 + np.exp(-z))
        assert abs(x.score - (1 - clean)) < 1e-4


def test_counting_words_frees_what_a_worker_kept_before():
    import pyarrow as pa

    from tessera.llm import langid, words

    words.worker("before", dict)
    batch = pa.record_batch([["en"], ["a text"]], names=["lang", "text"])
    assert sum(b.num_rows for b in langid._counts(iter([batch]))) == 2 and "before" not in words._kept
