"""Language identification by segmentation-marginalised unigrams (operator 3).

Each language has a probability for every piece of a fixed public vocabulary. A word's probability
is the sum over all its segmentations into pieces, computed by a forward algorithm; a text's is
the product over its words. The piece probabilities are fitted by expectation maximisation over
the same segmentations, on a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.words import parts, worker

UNKNOWN = "und"
#: Labelled rows that are learned from, for each language; drawn by a hash of doc_id.
SAMPLE_ROWS = 300
#: Characters of the vocabulary's longest piece. Longer words than LONG are summed in logarithms, so many characters of them at once.
PIECE, LONG, CELLS = 16, 32, 100_000
#: Expectation maximisation rounds, and the count that every piece has besides.
ROUNDS, SMOOTH = 3, 0.02
#: Words whose scores a worker keeps; beyond it the memo starts anew, results don't depend on it.
MEMO = 250_000
#: New words that are scored at once.
WORDS_AT_ONCE = 1_000
#: Characters that may be letters; str.isalpha decides.
LETTER = re.compile(r"[^\W\d_]")
START = "▁"


def vocabulary(path: str) -> dict[str, int]:
    """The pieces of a sentencepiece file, and their numbers."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return {p: i for i, p in enumerate(dict.fromkeys(p.lower() for p in found))}


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in LETTER.finditer(text))


#: White space that str.split knows besides 0x20 and 0x09-0x0D.
OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words_of(text: str) -> list[str]:
    """Lower-cased words, cut at 0x20 and 0x09-0x0D, in training as in prediction."""
    low = text.lower()
    return [w for w in SPACE.split(low) if w] if OTHER_SPACE.search(low) else low.split()


def _counts(batches):
    worker("counts", dict)  # what an operator before has kept would stand beside the model
    for batch in (p for b in batches for p in parts(b)):
        found: Counter[tuple[str, str]] = Counter()
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            found.update((lang, w) for w in words_of(text))
        langs, words = zip(*found) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "word", "n"])


def portions(texts: list[str], most: int) -> Iterator[list[int]]:
    """The places of texts in portions of similar lengths, short ones and long ones apart: most at once, fewer if they are long."""
    part: list[int] = []
    for i in sorted(range(len(texts)), key=lambda i: len(texts[i])):
        size = len(texts[i])
        if part and (len(part) == most or size > LONG and (len(texts[part[0]]) <= LONG or size * (len(part) + 1) > CELLS)):
            yield part
            part = []
        part.append(i)
    if part:
        yield part


class Pieces:
    """A vocabulary's pieces by 64-bit hashes of their characters."""

    def __init__(self, pieces: dict[str, int]):
        self.other = len(pieces)
        names = list(pieces)
        hashes = np.zeros(len(names), np.uint64)
        size = np.fromiter(map(len, names), np.int64, len(names))
        self.longest = int(size.max())
        codes = np.zeros((len(names), self.longest), np.uint64)
        for i, name in enumerate(names):
            codes[i, : len(name)] = [ord(c) for c in name]
        self.begun = []  # by size: hashes of what longer pieces begin with
        for k in range(self.longest):
            hashes = np.where(codes[:, k] > 0, self.extend(hashes, codes[:, k]), hashes)
            self.begun.append(np.unique(hashes[size > k + 1]))
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array([pieces[n] for n in names], np.int64)[order]
        assert (np.diff(self.hashes) > 0).all()

    @staticmethod
    def extend(hashes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        h = (hashes + chars + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(32))

    def begins(self, hashes: np.ndarray, size: int) -> np.ndarray:
        """Whether a longer piece begins with these size characters."""
        known = self.begun[size - 1]
        return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes if len(known) else np.zeros(len(hashes), bool)

    def lookup(self, hashes: np.ndarray, other: bool) -> np.ndarray:
        """The pieces' numbers; without a piece the unknown character if other, else -1."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.ids[at], self.other if other else -1)


class Lattice:
    """All pieces of many runs as edges, in the order of their ends. A character outside the vocabulary is one piece."""

    def __init__(self, texts: list[str], pieces: Pieces):
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
        self.length = np.fromiter(map(len, texts), np.int32, len(texts))
        run = np.repeat(np.arange(len(texts), dtype=np.int32), self.length)
        last = np.cumsum(self.length)
        begin = np.arange(len(chars)) - (last - self.length)[run]
        room = last[run] - np.arange(len(chars))  # characters from here to the end of the run
        hashes, found = np.zeros(len(chars), np.uint64), []
        at = np.arange(len(chars))
        for size in range(1, pieces.longest + 1):
            hashes = pieces.extend(hashes, chars[at + size - 1])
            piece = pieces.lookup(hashes, other=size == 1)
            hit = piece >= 0
            where = at[hit]
            found.append((run[where], begin[where], begin[where] + size, piece[hit]))
            keep = (room[at] > size) & pieces.begins(hashes, size)
            at, hashes = at[keep], hashes[keep]
        run, begin, end, piece = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((run, end))
        self.run, self.begin, self.end, self.piece = (x[order].astype(np.int32) for x in (run, begin, end, piece))
        top = int(self.length.max(initial=0))
        self.at = np.searchsorted(self.end, np.arange(1, top + 2))

    def forward(self, chances: np.ndarray) -> np.ndarray:
        """(ends, runs, languages): the chance of everything up to each end, over all segmentations."""
        alpha = np.zeros((len(self.at), len(self.length), chances.shape[1]))
        alpha[0] = 1
        for i in range(1, len(self.at)):
            e = slice(self.at[i - 1], self.at[i])
            new = np.flatnonzero(np.diff(self.run[e], prepend=-1))
            if len(new):
                part = alpha[self.begin[e], self.run[e]] * chances[self.piece[e]]
                alpha[i, self.run[e][new]] = np.add.reduceat(part, new, axis=0)
        return alpha

    def long_forward(self, logs: np.ndarray) -> np.ndarray:
        """forward in logarithms, for words of any length."""
        alpha = np.full((len(self.at), len(self.length), logs.shape[1]), -np.inf)
        alpha[0] = 0
        for i in range(1, len(self.at)):
            e = slice(self.at[i - 1], self.at[i])
            new = np.flatnonzero(np.diff(self.run[e], prepend=-1))
            if len(new):
                part = alpha[self.begin[e], self.run[e]] + logs[self.piece[e]]
                alpha[i, self.run[e][new]] = np.logaddexp.reduceat(part, new, axis=0)
        return alpha

    def scores(self, chances: np.ndarray) -> np.ndarray:
        """(runs, languages) logarithms of the runs' chances."""
        if self.length.max(initial=0) > LONG:
            return self.long_forward(np.log(chances))[self.length, np.arange(len(self.length))]
        alpha = self.forward(chances)
        return np.log(np.maximum(alpha[self.length, np.arange(len(self.length))], 1e-300))

    def expected(self, chances: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """(pieces, languages) expected uses of each piece, if run r occurs weights[r, l] times in language l."""
        r = np.arange(len(self.length))
        if self.length.max(initial=0) > LONG:
            logs = np.log(chances)
            alpha = self.long_forward(logs)
            beta = np.full_like(alpha, -np.inf)
            beta[self.length, r] = 0
            for i in range(len(self.at) - 1, 0, -1):
                e = slice(self.at[i - 1], self.at[i])
                np.logaddexp.at(beta, (self.begin[e], self.run[e]), beta[i, self.run[e]] + logs[self.piece[e]])
            share = alpha[self.begin, self.run] + logs[self.piece] + beta[self.end, self.run] - alpha[self.length, r][self.run]
            return self._uses(np.exp(share) * weights[self.run], len(chances))
        alpha = self.forward(chances)
        beta = np.zeros_like(alpha)
        beta[self.length, r] = 1
        for i in range(len(self.at) - 1, 0, -1):
            e = slice(self.at[i - 1], self.at[i])
            np.add.at(beta, (self.begin[e], self.run[e]), beta[i, self.run[e]] * chances[self.piece[e]])
        total = np.maximum(alpha[self.length, r], 1e-300)
        uses = alpha[self.begin, self.run] * chances[self.piece] * beta[self.end, self.run] / total[self.run] * weights[self.run]
        return self._uses(uses, len(chances))

    def _uses(self, uses: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(self.piece, uses[:, k], n) for k in range(uses.shape[1])], 1)


class Model:
    """Piece chances of each language: (pieces + 1, languages). Workers get the pieces with it and needn't load the vocabulary."""

    def __init__(self, path: str, languages: list[str], chances: np.ndarray, pieces: Pieces | None = None):
        self.path, self.languages, self.chances, self.pieces = path, languages, chances, pieces


def held_out(divisor: int, rest: int):
    """crc32 of doc_id's text modulo divisor is rest; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor == rest, F.lit(False))


def train(docs: DataFrame, path: str, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from text and lang of the rows of docs that have both, sample_rows of each language at most.

    Rows that repeat a doc_id and lang count as one, with the text that is first in order. Rows without
    doc_id, text or lang teach nothing; without any other rows no language is known.
    """
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    drawn = docs.where("lang is not null and text is not null").select("doc_id", "lang")
    drawn = drawn.withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample_rows).drop("n").distinct()
    rows = docs.select("doc_id", "lang", "text").where("text is not null").join(F.broadcast(drawn), ["doc_id", "lang"])
    rows = rows.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))  # one row of each, however often it is repeated
    counts = rows.select("lang", "text").mapInArrow(_counts, "lang string, word string, n long")
    counts = counts.groupBy("lang", "word").agg(F.sum("n").alias("n")).toPandas()
    pieces = Pieces(vocabulary(path))
    languages = sorted(counts.lang.unique())
    if not languages:
        return Model(path, [], np.zeros((pieces.other + 1, 0)))
    column = {x: k for k, x in enumerate(languages)}
    weights: dict[str, np.ndarray] = {}
    for lang, word, n in zip(counts.lang, counts.word, counts.n):
        weights.setdefault(START + word, np.zeros(len(languages)))[column[lang]] += n
    texts = sorted(weights)
    chances = np.full((pieces.other + 1, len(languages)), 1 / (pieces.other + 1))
    for _ in range(ROUNDS):
        uses = np.zeros_like(chances)
        for at in portions(texts, 20_000):  # the lattice of all words needn't be held at once
            part = [texts[i] for i in at]
            uses += Lattice(part, pieces).expected(chances, np.stack([weights[t] for t in part]))
        uses[-1] = 0  # the unknown character has the same chance everywhere
        chances = (uses + SMOOTH) / (uses + SMOOTH).sum(0)
    return Model(path, languages, chances, pieces)


class Scorer:
    """Scores of words. Words that are new and stand twice among those asked for are kept for the worker's later texts."""

    def __init__(self, model: Model):
        self.model = model
        self.pieces = model.pieces or Pieces(vocabulary(model.path))
        self.memo: dict[str, int] = {}
        self.table = np.zeros((0, len(model.languages)))

    def rows(self, words: list[str]) -> np.ndarray:
        """The place of each word in table, until the next call."""
        self.table = self.table[: len(self.memo)].copy()
        found = list(map(self.memo.get, words))
        if None in found:
            counts = Counter(w for w, v in zip(words, found) if v is None)
            if len(self.memo) + sum(n > 1 for n in counts.values()) > MEMO:
                self.memo.clear()
                self.table = self.table[:0]
                counts, found = Counter(words), [None] * len(words)
            place = self._learn(counts)
            found = [place[w] if v is None else v for w, v in zip(words, found)]
        return np.array(found, np.int64)

    def _learn(self, counts: Counter[str]) -> dict[str, int]:
        """Where the scores of new words are in table. Most new words stand once in all texts, and would fill the memo for nothing."""
        often = sorted(w for w, n in counts.items() if n > 1)
        new = often + sorted(w for w, n in counts.items() if n == 1)
        texts = [START + w for w in new]
        scores = np.zeros((len(texts), self.table.shape[1]))
        for at in portions(texts, WORDS_AT_ONCE):
            scores[at] = Lattice([texts[i] for i in at], self.pieces).scores(self.model.chances)
        place = dict(zip(new, range(len(self.table), len(self.table) + len(new))))
        self.memo.update((w, place[w]) for w in often)
        self.table = np.concatenate([self.table, scores])
        return place

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lists = [words_of(t) if t and has_letter(t) else [] for t in texts]
        names = self.model.languages
        if not names:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        at = self.rows([w for x in lists for w in x])
        langs, scores, i = [], [], 0
        for x in lists:
            if not x:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            total = self.table[at[i : i + len(x)]].sum(0)
            i += len(x)
            best = int(total.argmax())
            langs.append(names[best])
            scores.append(float(1 / np.exp(total - total[best]).sum()))
        return langs, scores


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score: the most likely learned language and its share of the posterior.

    lang_pred is und with score 0 for texts that are null or have no letter, and for all texts if
    nothing could be learned. Equal posteriors go to the first language in alphabetical order.
    Columns of docs that have one of these names are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    model_id = uuid.uuid4().hex

    def run(batches):
        scorer = worker(model_id, lambda: Scorer(sent.value))
        for batch in batches:
            for part in parts(batch):
                langs, scores = scorer.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*part.schema.names, "lang_pred", "score"])

    docs = docs.drop("lang_pred", "score")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of docs; rows with held_out are not learned from.

    Repeated rows each get a row; null, empty and letterless texts are und; an empty table gives an
    empty result. Other columns are ignored.
    """
    docs = docs.select("doc_id", "text", "lang").withColumn("held_out", held_out(4, 2))
    model = train(docs.where("not held_out"), path)
    return predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def accepted(docs: DataFrame, path: str, least: float = 0.5) -> DataFrame:
    """The rows of docs whose language is known with a score of at least least; all their columns, whatever their names.

    Null, empty and letterless texts go; repeated rows all stay or go.
    """
    model = train(docs.select("doc_id", "text", "lang").where(~held_out(4, 2)), path)
    kept = [c for c in docs.columns]
    plain = docs.toDF(*(f"_{i}_{c}" if c.lower() in ("lang_pred", "score") else c for i, c in enumerate(kept)))
    found = predict(plain, model).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return found.drop("lang_pred", "score").toDF(*kept)
