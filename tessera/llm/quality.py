"""Quality rules: base counts, and a calibrated hashed n-gram logistic regression (operator 5).

The features of a text are its words, pairs of words and character trigrams of words, hashed to a
fixed number of weights; each kind has a total of one in every text that has words. The model is
linear, so a word's share of the score is computed once per word and worker. Case counts.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from tessera.llm.learning import adam, labelled_sample, platt, sigmoid
from tessera.llm.words import PLACE, mix, parts, slices, word_hashes, worker

WEIGHTS = 1 << 18
#: A text is kept if its calibrated chance of good quality is at least this.
THRESHOLD = 0.5
#: The base rules: fewest words, and the largest percentage of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
SCALE = 30.0
MEMO = 250_000


def _grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character trigrams of words with marked ends, one word after the other, and their number for each word."""
    marked = [f"^{w.decode()}$" for w in words]
    code = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    length = np.fromiter(map(len, marked), np.int64, len(marked))
    if not len(code):
        return np.zeros(0, np.int64), length
    h = mix(code[:-2] * PLACE[11] + mix(code[1:-1]) * PLACE[12] + mix(code[2:] * PLACE[13]))
    inside = np.ones(len(code), bool)
    ends = np.cumsum(length)
    inside[ends - 1] = inside[ends - 2] = False
    return (h[inside[:-2]] % np.uint64(WEIGHTS)).astype(np.int64), length - 2


def _pairs(flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed pairs of neighbouring words, and the text of each."""
    owner = np.repeat(np.arange(len(counts)), counts)
    same = owner[1:] == owner[:-1] if len(flat) else np.zeros(0, bool)
    both = mix(flat[:-1] * PLACE[9] + mix(flat[1:]) * PLACE[10]) % np.uint64(WEIGHTS) if len(flat) else flat
    return both[same].astype(np.int64) if len(flat) else both.astype(np.int64), owner[1:][same] if len(flat) else owner


def _features(batches):
    """Sparse feature rows of labelled texts: (label, fold, at, value)."""
    for batch in (p for b in batches for p in parts(b)):
        texts = batch.column("text").to_pylist()
        flat, counts = word_hashes(texts, lower=False)
        pairs, owner = _pairs(flat, counts)
        ats, values = [], []
        for i, (a, b) in enumerate(slices(counts)):
            row = np.zeros(0, np.int64), np.zeros(0)
            if b > a:
                grams, each = _grams(texts[i].encode().split())
                pair = pairs[np.searchsorted(owner, i) : np.searchsorted(owner, i, "right")]
                at = np.concatenate([(flat[a:b] % np.uint64(WEIGHTS)).astype(np.int64), pair, grams])
                value = np.concatenate([np.full(b - a, 1 / (b - a)), np.full(len(pair), 1 / max(1, len(pair))), np.repeat(1 / each / (b - a), each)])
                at, k = np.unique(at, return_inverse=True)
                row = at, np.bincount(k, value)
            ats.append(row[0].astype(np.int32))
            values.append(row[1].astype(np.float32))
        fold = [xxhash.xxh64_intdigest(str(d)) % 5 for d in batch.column("doc_id").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("label"), pa.array(fold, pa.int32()), pa.array(ats, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))],
            names=["label", "fold", "at", "value"],
        )


class Model:
    """Weights, and the slope and intercept that calibrate their score."""

    def __init__(self, weights: np.ndarray, slope: float, intercept: float):
        self.weights, self.slope, self.intercept = weights.astype(np.float32), slope, intercept


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on four fifths of a bounded sample of labelled rows and calibrate on the rest.

    Without labels of both classes every text has the same chance, the share of good labels (1 if there are none).
    """
    found = labelled_sample(docs, labels, "quality").mapInArrow(_features, "label int, fold int, at array<int>, value array<float>").toArrow()
    y, fold = found.column("label").to_numpy().astype(float), found.column("fold").to_numpy()
    fit = fold > 0
    if len(set(y[fit].tolist())) < 2:
        mean = float(np.clip(y.mean(), 0.001, 0.999)) if len(y) else 0.999
        return Model(np.zeros(WEIGHTS), 1.0, float(np.log(mean / (1 - mean))))
    at = found.column("at").combine_chunks()
    rows = np.repeat(np.arange(len(y)), at.value_lengths().to_numpy())
    cols, values = at.flatten().to_numpy(), found.column("value").combine_chunks().flatten().to_numpy() * SCALE
    mine = fit[rows]
    r, c, v = rows[mine], cols[mine], values[mine]
    weight = np.where(y == 1, 0.5 / y[fit].mean(), 0.5 / (1 - y[fit].mean())) * fit / fit.sum()

    def gradient(w):
        g = weight * (sigmoid(np.bincount(r, v * w[c], len(y))) - y)
        return np.bincount(c, v * g[r], WEIGHTS) + 1e-5 * w

    w = adam(np.zeros(WEIGHTS), gradient, 60, 0.05)
    z = np.bincount(rows, values * w[cols], len(y))
    slope, intercept = platt(z[~fit], y[~fit])
    return Model(w * SCALE, slope, intercept)


def base_counts(texts: list[str | None], flat: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of texts, whose case-sensitive word hashes are flat."""
    chars, symbols, lines = [], [], []
    for t in texts:
        t = t or ""
        chars.append(len(t) - sum(map(t.count, SPACES)))
        symbols.append(sum(map(t.count, SYMBOLS)))
        seen = [x for x in t.split("\n") if x.strip(SPACES)] if "\n" in t else []
        lines.append(len(seen) - len(set(seen)))
    repeated = np.zeros(len(flat), bool)
    if len(flat) > 2:
        owner = np.repeat(np.arange(len(counts)), counts)
        inside = np.flatnonzero(owner[2:] == owner[:-2])
        key = mix(mix(flat[:-2] * PLACE[0] + mix(flat[1:-1]) * PLACE[1] + mix(flat[2:] * PLACE[2]))[inside] + owner[inside].astype(np.uint64) * PLACE[3])
        order = np.argsort(key)
        twin = key[order][1:] == key[order][:-1]
        some = inside[order[np.concatenate([twin, [False]]) | np.concatenate([[False], twin])]]
        for k in range(3):
            repeated[some + k] = True
    total = np.concatenate([[0], np.cumsum(repeated)])
    ends = np.cumsum(counts)
    return {
        "n_words": counts, "word_chars": np.array(chars, np.int64), "n_symbols": np.array(symbols, np.int64),
        "n_dup_lines": np.array(lines, np.int64), "n_repeat_words": total[ends] - total[ends - counts],
    }


class Scorer:
    """The chance of good quality; a word's share of it is computed once per worker."""

    def __init__(self, model: Model):
        self.model = model
        self.memo: dict[int, float] = {}

    def shares(self, texts: list[str | None], flat: np.ndarray) -> np.ndarray:
        """Each word's own weight and the mean weight of its trigrams."""
        known, first, at = np.unique(flat, return_index=True, return_inverse=True)
        keys = known.tolist()
        if len(self.memo) > MEMO:
            self.memo.clear()
        get = self.memo.get
        found = np.array([get(k, np.nan) for k in keys])
        new = np.flatnonzero(np.isnan(found))
        if len(new):
            words = [w for t in texts if t for w in t.encode().split()]
            grams, n = _grams([words[k] for k in first[new].tolist()])
            w = self.model.weights
            start = np.cumsum(n) - n
            found[new] = w[(known[new] % np.uint64(WEIGHTS)).astype(np.int64)] + np.add.reduceat(w[grams].astype(float), start) / n
            self.memo.update((keys[k], v) for k, v in zip(new.tolist(), found[new].tolist()))
        return found[at]

    def chances(self, texts: list[str | None], flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
        owner = np.repeat(np.arange(len(counts)), counts)
        z = np.bincount(owner, self.shares(texts, flat), len(counts)) / np.maximum(counts, 1)
        pairs, of = _pairs(flat, counts)
        z += np.bincount(of, self.model.weights[pairs], len(counts)) / np.maximum(counts - 1, 1)
        return sigmoid(self.model.slope * z + self.model.intercept)


def rate(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the base counts, base_failed, chance, kept of each row of docs (doc_id, text).

    base_failed: fewer than 50 words, or over half of the words in repeated 3-word windows. kept:
    not base_failed, and a chance of at least threshold. A null or wordless text has no words and
    is base_failed; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    model_id = uuid.uuid4().hex
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        scorer = worker(model_id, lambda: Scorer(sent.value))
        for batch in (p for b in batches for p in parts(b)):
            texts = batch.column("text").to_pylist()
            flat, counts = word_hashes(texts, lower=False)
            base = base_counts(texts, flat, counts)
            failed = (counts < LEAST_WORDS) | (100 * base["n_repeat_words"] > MOST_REPEATED * counts)
            chance = scorer.chances(texts, flat, counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(base[k], pa.int64()) for k in names), pa.array(failed), pa.array(chance, pa.float64()), pa.array(~failed & (chance >= threshold))],
                names=["doc_id", *names, "base_failed", "chance", "kept"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {', '.join(f'{k} long' for k in names)}, base_failed boolean, chance double, kept boolean")
