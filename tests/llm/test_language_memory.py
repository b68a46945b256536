"""What a worker of language identification keeps."""

import pickle

import numpy as np

from tessera.llm import langid
from tessera.llm.queries import PIECES, vocabulary

PATH = vocabulary(PIECES)


def model():
    pieces = langid.Pieces(langid.vocabulary(PATH))
    return langid.Model(PATH, ["a", "b"], np.random.default_rng(2).random((pieces.other + 1, 2)) * 1e-3, pieces)


def test_words_that_stand_once_are_not_kept_and_results_are_the_same(monkeypatch):
    sent = model()
    texts = [f"the river and the hill junk{k}x{7 * k} {'é' * (k % 50)}" for k in range(300)]
    known = langid.Scorer(sent)
    first = known.predict(texts)
    assert {"the", "river", "hill"} <= set(known.memo) and not any(w.startswith("junk") for w in known.memo)
    assert known.predict(texts) == first
    each = [langid.Scorer(sent).predict([t]) for t in texts[:40]]
    assert [x[0][0] for x in each] == first[0][:40] and np.allclose([x[1][0] for x in each], first[1][:40])
    monkeypatch.setattr(langid, "MEMO", 8)
    few = langid.Scorer(sent)
    assert few.predict(texts[:150]) == (first[0][:150], first[1][:150]) and few.predict(texts[150:]) == (first[0][150:], first[1][150:])
    assert len(few.memo) <= max(8, 60)


def test_workers_get_the_pieces_with_the_model(monkeypatch):
    sent = pickle.loads(pickle.dumps(model()))
    monkeypatch.setattr(langid, "vocabulary", None)
    assert langid.Scorer(sent).predict(["hello there", ""])[0][1] == langid.UNKNOWN
