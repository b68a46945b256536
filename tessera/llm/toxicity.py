"""Toxicity by multiple-instance learning (operator 8).

A document is toxic if any of its sentences is: its chance is one minus the product of the
sentences' chances of being clean (noisy-or). A sentence's chance is a logistic function of its
hashed words and their beginnings. Only the documents' labels are learned from; the sentences' chances follow, and
tell where the offence is.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.learning import adam, labelled_sample, sigmoid
from tessera.llm.words import parts, slices, worker

WEIGHTS = 1 << 20
#: Labelled rows that are learned from at most, drawn by a hash of doc_id: rare offences need many.
SAMPLE_ROWS = 10_000
#: Words of the sample that a step looks at at once, to bound the driver's memory.
CHUNK = 1 << 20
#: Sampled documents that a hashed feature must be in, at least, to have a weight.
LEAST_DOCS = 5
SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")
#: What is cut from both ends of a lower-cased word.
EDGES = ".,;:!?\"'()[]{}<>|*#$%&-_"
#: A sentence with at least this chance is reported as offending.
OFFENDING = 0.5
#: Gradient steps, and the pull of weights towards zero.
ROUNDS, SHRINK = 150, 2e-4


def features(word: str) -> list[int]:
    """A word without edges as it is, and by its first four and five characters, where inflection adds more."""
    return [xxhash.xxh64_intdigest(x) % WEIGHTS for x in (word, *(f"^{word[:k]}" for k in (4, 5) if len(word) >= k))]


def words_of(sentence: str) -> set[str]:
    return {w for w in (x.strip(EDGES) for x in sentence.lower().split()) if w}


def _instances(batches):
    """(label, sizes, words): the hashed features of each sentence's words, one sentence after the other."""
    for batch in (p for b in batches for p in parts(b)):
        sizes, words = [], []
        for text in batch.column("text").to_pylist():
            found = [[f for w in sorted(words) for f in features(w)] for words in map(words_of, SENTENCE.findall(text or "")) if words]
            sizes.append(np.array([len(x) for x in found], np.int32))
            words.append(np.array([f for x in found for f in x], np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("label"), pa.array(sizes, pa.list_(pa.int32())), pa.array(words, pa.list_(pa.int32()))], names=["label", "sizes", "words"]
        )


class Model:
    """Word weights and the bias of a sentence."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), bias


def fit(y: np.ndarray, doc: np.ndarray, sentence: np.ndarray, word: np.ndarray, rounds: int = ROUNDS, keep: float = SHRINK) -> tuple[np.ndarray, float]:
    """Weights of words 0 to the largest and a sentence's bias, from document labels y alone.

    doc is the document of each sentence, sentence that of each word. Both classes weigh the same:
    one sentence is enough to offend, so few words of a long toxic document are to blame for it.
    """
    n = int(word.max(initial=-1)) + 1
    share = float(y.mean())
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / len(y)

    chunks = [slice(k, k + CHUNK) for k in range(0, len(word), CHUNK)]

    def gradient(x):
        z = np.full(len(doc), x[-1])
        for c in chunks:
            z += np.bincount(sentence[c], x[word[c]], len(doc))
        clean = np.bincount(doc, np.logaddexp(0, z), len(y))  # -log of the chance that all sentences are clean
        pull = (weight * np.where(y == 1, -1 / np.expm1(np.clip(clean, 1e-6, 50)), 1.0))[doc] * sigmoid(z)
        g = keep * x
        g[-1] = pull.sum()
        for c in chunks:
            g[:-1] += np.bincount(word[c], pull[sentence[c]], n)
        return g

    start = np.zeros(n + 1)
    start[-1] = np.log(max(1e-6, y.sum() / max(1, len(doc))))
    x = adam(start, gradient, rounds, 0.1)
    return x[:-1], float(x[-1])


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fit on a bounded sample of labelled documents; without labels of both classes no sentence offends.

    Documents of null or wordless text teach nothing; of several labels of one doc_id the largest counts.
    """
    found = labelled_sample(docs, labels, "toxic", rows).mapInArrow(_instances, "label int, sizes array<int>, words array<int>").toArrow()
    y = found.column("label").to_numpy().astype(float)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(WEIGHTS), -8.0)
    sizes, words = (found.column(c).combine_chunks() for c in ("sizes", "words"))
    doc = np.repeat(np.arange(len(y), dtype=np.int32), sizes.value_lengths().to_numpy())
    sentence = np.repeat(np.arange(len(doc), dtype=np.int32), sizes.flatten().to_numpy())
    word = words.flatten().to_numpy()
    seen = np.zeros(WEIGHTS, np.int32)
    for a, b in slices(words.value_lengths().to_numpy().astype(np.int64)):
        seen[np.unique(word[a:b])] += 1
    wide = seen >= LEAST_DOCS
    known = wide[word]
    sentence, word = sentence[known], (np.cumsum(wide, dtype=np.int32) - 1)[word[known]]
    weights = np.zeros(WEIGHTS)
    some, bias = fit(y, doc, sentence, word)
    weights[np.flatnonzero(wide)[: len(some)]] = some
    return Model(weights, bias)


class Weights(dict):
    """Weights of words as they are written, computed once per word and worker."""

    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, word: str) -> tuple[str, float]:
        if len(self) > 200_000:
            self.clear()
        bare = word.strip(EDGES)
        weight = float(self.model.weights[features(bare)].sum()) if bare else 0.0
        found = self[word] = (bare, weight)
        return found

    def sentences(self, text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
        """Where each sentence with a word starts and ends, and its chance."""
        spans, sums = [], []
        for m in SENTENCE.finditer(text):
            words = m.group().lower().split()
            if words:
                found = dict(map(self.__getitem__, words))  # a repeated word counts once
                found.pop("", None)
                if found:
                    spans.append(m.span())
                    sums.append(sum(found.values()))
        return spans, sigmoid(np.array(sums) + self.model.bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs' doc_id and score of each row, and the offending sentences: an array of (start, end, chance).

    start and end are places in the text's characters. A null or wordless text has score 0 and no
    sentences; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    model_id = uuid.uuid4().hex

    def run(batches):
        weights = worker(model_id, lambda: Weights(sent.value))
        for batch in (p for b in batches for p in parts(b)):
            scores, found = [], []
            for text in batch.column("text").to_pylist():
                spans, p = weights.sentences(text or "")
                scores.append(float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())) if len(p) else 0.0)
                found.append([{"start": a, "end": b, "chance": float(q)} for (a, b), q in zip(spans, p) if q >= OFFENDING])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("chance", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(found, kind)], names=["doc_id", "score", "sentences"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, sentences array<struct<start int, end int, chance double>>")


def held_out():
    """crc32 of doc_id's text modulo 5 is 0; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, sentences; labels of rows with held_out are not learned from."""
    model = train(docs, labels.where(~held_out()))
    found = score(docs, model).withColumn("held_out", held_out()).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    return found.select("doc_id", "held_out", "score", "predicted", "sentences")
