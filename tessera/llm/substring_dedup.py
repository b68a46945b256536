"""Substring dedup by paragraph MinHash banding (operator 6).

Paragraphs are content-defined: a text is cut behind sentences and newlines, where the sentence
has at least ten words; shorter ones belong to the paragraph that follows. So a passage is cut the
same way wherever it stands. Paragraphs have small sketches of 64-bit minima, banded for recall:
six bands of two minima; at a Jaccard similarity of 0.75 one pair in 140 shares none, at 0.8 one
in 450, at 0.9 one in 21,000, and equal sets share all.

Texts are sketched once, and only fingerprints, places, band values and a parity sketch of 256 bits
are kept. Colliding paragraphs that the parity sketch, an upper bound, lets pass are verified by the exact Jaccard similarity of their full sets, which are computed
again for those that collide, and clustered by components. In a text neighbouring paragraphs with
partners are one passage, and passages of at least 25 words are reported. Where these paragraphs have
fewer words, all runs of 25 words that hold them are compared, so a passage that begins and ends inside
a paragraph is found by the paragraphs between; the text of its row is what these runs cover.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.joins import by_size, marked
from tessera.llm.neardup import CHUNK, Linker, Shape, clusters, parities, word_lists
from tessera.llm.words import BUCKET, distinct_sets, list_hashes, mix, parts, set_hashes, shingle_hashes, slices
from tessera.llm.workspace import Workspace

PARAGRAPH = Shape(6, 2, 256, None)
#: Words of a sentence that a paragraph may end with, and of a passage that is reported.
SENTENCE_WORDS, PASSAGE_WORDS = 10, 25
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SENTENCE = re.compile(rb"[^.!?\n]*(?:[.!?]+(?=[ \t-\r]|\Z)|[.!?\n]|\Z)[ \t-\r]*")


def cut(text: bytes, sentence_words: int = SENTENCE_WORDS) -> tuple[list[tuple[int, int]], list[list[bytes]]]:
    """Where each paragraph of a text starts and ends, in bytes, and its words in lower case; together they are the whole text."""
    spans, words, start, held = [], [], 0, []
    low, size = text.lower(), len(text)
    for m in SENTENCE.finditer(low):
        found = m.group().split()
        held += found
        if len(found) >= sentence_words:
            spans.append((start, m.end()))
            words.append(held)
            start, held = m.end(), []
    if start < size:
        spans.append((start, size))
        words.append(held)
    return spans, words


def _characters(text: bytes, at: np.ndarray) -> np.ndarray:
    """Places in bytes as places in characters."""
    if text.isascii():
        return at
    first = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    return np.concatenate([[0], np.cumsum(first)])[at]


def minima(hashes: np.ndarray, n: np.ndarray, shape: Shape = PARAGRAPH) -> np.ndarray:
    """(sets, bands) band values of the sets that follow one another in hashes, none of them empty: each mixes some minima."""
    out = np.empty((len(n), shape.bands), np.uint64)
    ends = np.cumsum(n)
    a = 0
    while a < len(n):
        start = ends[a] - n[a]
        b = max(a + 1, int(np.searchsorted(ends, start + CHUNK, "right")))
        part, at = hashes[start : ends[b - 1]], ends[a:b] - n[a:b] - start
        for k in range(shape.bands):
            value = np.zeros(b - a, np.uint64)
            for j in range(shape.lanes):
                value = mix(value + np.minimum.reduceat(mix(part * BUCKET[k * shape.lanes + j]), at))
            out[a:b, k] = value
        a = b
    return out.view(np.int64)


def _paragraphs(docs: DataFrame, sentence_words: int) -> DataFrame:
    """(doc_id, print, number, start, end, n_words, n, node, sketch, parity) of the paragraphs with words of docs (doc_id, print, text)."""

    def run(batches):
        for batch in (p for b in batches for p in parts(b)):
            rows, numbers, places, lists = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                if not text:
                    continue
                raw = text.encode()
                spans, words = cut(raw, sentence_words)
                some = [k for k, w in enumerate(words) if w]
                rows += [i] * len(some)
                numbers += some
                places.append(_characters(raw, np.array(spans, np.int64).reshape(-1, 2))[some])
                lists += [words[k] for k in some]
            if not rows:
                continue
            counts = np.fromiter(map(len, lists), np.int64, len(lists))
            sets, n = distinct_sets(*shingle_hashes(set_hashes(lists, int(counts.sum())), counts))
            sketch = minima(sets, n)
            raw = memoryview(sets).cast("B")
            prints = [xxhash.xxh128_digest(raw[8 * a : 8 * b]) for a, b in slices(n)]
            place = np.concatenate(places).astype(np.int32)
            of = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(of), batch.column("print").take(of), pa.array(numbers, pa.int32()), pa.array(place[:, 0]), pa.array(place[:, 1]),
                    pa.array(counts.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(prints, pa.binary()), word_lists(sketch, n), word_lists(parities(sets, n, PARAGRAPH.parity), n),
                ],
                names=["doc_id", "print", "number", "start", "end", "n_words", "n", "node", "sketch", "parity"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, print long, number int, start int, end int, n_words int, n int, node binary, sketch array<long>, parity array<long>")


class ParagraphSets:
    """Shingle sets of wanted paragraphs, computed again from the texts of the documents that a filter lets pass."""

    def __init__(self, docs: DataFrame, space: Workspace, sentence_words: int):
        self.docs, self.space, self.sentence_words = docs, space, sentence_words

    def __call__(self, wanted: DataFrame) -> DataFrame:
        sentence_words = self.sentence_words

        def run(batches):
            for batch in (p for b in batches for p in parts(b)):
                lists, ids = [], []
                for text, numbers, some in zip(*(batch.column(c).to_pylist() for c in ("text", "numbers", "ids"))):
                    words = cut(text.encode(), sentence_words)[1]
                    lists += [words[k] for k in numbers]
                    ids += some
                counts = np.fromiter(map(len, lists), np.int64, len(lists))
                sets, n = distinct_sets(*shingle_hashes(set_hashes(lists, int(counts.sum())), counts))
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(sets.view(np.int64)))], names=["id", "shingles"])

        # a document's paragraphs are no more than its text, so a list of them is bounded as the text is
        by_doc = wanted.groupBy(F.col("key.doc_id").alias("of"), F.col("key.print").alias("of_print")).agg(F.collect_list(F.struct("key.number", "id")).alias("asked"))
        by_doc = self.space.save(by_doc.select("of", "of_print", F.col("asked.number").alias("numbers"), F.col("asked.id").alias("ids")), "asked")
        rows = marked(self.docs, F.col("print"), by_doc.select(F.xxhash64("of_print").alias("h"))).where("passed").drop("passed")
        rows = rows.join(by_doc, (F.col("print") == F.col("of_print")) & F.col("doc_id").eqNullSafe(F.col("of")))
        return rows.dropDuplicates(["doc_id", "print"]).select("text", "numbers", "ids").mapInArrow(run, "id long, shingles array<long>")


def repeated_paragraphs(docs: DataFrame, space: Workspace, percent: int = 75, sentence_words: int = SENTENCE_WORDS) -> DataFrame:
    """(doc_id, print, number, start, end, n_words, cluster, first): paragraphs that have partners.

    cluster is the key (doc_id, print, number) of the cluster's first paragraph; first tells whether
    it is this one. print is a hash of the text; rows that are equal in both count as one document.
    """
    docs = docs.select("doc_id", "text").where("text is not null").withColumn("print", F.xxhash64("text"))
    found = space.save(_paragraphs(docs.select("doc_id", "print", "text"), sentence_words), "paragraphs")
    key = F.struct("doc_id", "print", "number")
    nodes = found.groupBy("node").agg(F.min(key).alias("key"), F.max(key).alias("last"), F.count("*").alias("size"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("parity").alias("parity"))
    nodes = space.save(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    rows = space.save(found.select("doc_id", "print", "number", "start", "end", "n_words", "node"), "places")
    space.drop(found)
    space.sweep()
    linker = Linker(nodes, ParagraphSets(docs, space, sentence_words), space, percent, PARAGRAPH)
    rows = clusters(rows, linker).where("cluster <> last_key")
    return rows.withColumn("first", key == F.col("cluster")).drop("node", "last_key")


def _windows(docs: DataFrame, runs: DataFrame, size: int, space: Workspace) -> DataFrame:
    """(doc_id, print, asked, at, start, end, h): the size words from word at, with their hash, wherever they hold all of a run of runs, which is asked."""
    kept = runs.select(F.struct("run", "start", "end", "n_paragraphs", "n_removed", "first_doc_id").alias("asked"), F.col("doc_id").alias("of"), F.col("print").alias("of_print"))
    # a document's runs are no more than its text
    by_doc = space.save(kept.groupBy("of", "of_print").agg(F.collect_list("asked").alias("asked")), "short-runs")

    def run(batches):
        for batch in (p for b in batches for p in parts(b)):
            docs, which, at, begin, end, lists, counts = [], [], [], [], [], [], []
            for i, (text, starts, ends) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("text", "starts", "ends")))):
                places = np.array([m.span() for m in WORD.finditer(text)], np.int64).reshape(-1, 2)
                for k, (a, b) in enumerate(zip(starts, ends)):
                    first, last = np.searchsorted(places[:, 0], [a, b])
                    low, high = max(0, int(last) - size), min(len(places), int(first) + size)
                    n = high - low - size + 1
                    if n < 1:
                        continue
                    lists.append([text[x:y].encode().lower() for x, y in places[low:high].tolist()])
                    counts.append(n)
                    docs += [i] * n
                    which += [k] * n
                    at.append(np.arange(low, low + n))
                    begin.append(places[low : low + n, 0])
                    end.append(places[low + size - 1 : high, 1])
            if docs:
                n = np.array(counts)
                words = list_hashes(lists, int((n + size - 1).sum()))
                # the windows of all runs side by side; before each run's words stand those of the runs before
                first = np.arange(int(n.sum())) + (size - 1) * np.repeat(np.arange(len(n)), n)
                h = np.zeros(len(first), np.uint64)
                for j in range(size):
                    h = mix(h + words[first + j])
                of = pa.array(docs)
                numbers = [pa.array(np.concatenate(x).astype(kind)) for x, kind in ((at, np.int32), (begin, np.int32), (end, np.int32), ([h.view(np.int64)], np.int64))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(of), batch.column("print").take(of), pa.array(which, pa.int32()), *numbers], names=["doc_id", "print", "k", "at", "start", "end", "h"])

    rows = marked(docs, F.col("print"), by_doc.select(F.xxhash64("of_print").alias("h"))).where("passed").drop("passed")
    same = (F.col("print") == F.col("of_print")) & F.col("doc_id").eqNullSafe(F.col("of"))
    rows = rows.join(by_doc, same).dropDuplicates(["doc_id", "print"])
    rows = rows.select("doc_id", "print", "text", F.col("asked.start").alias("starts"), F.col("asked.end").alias("ends"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"doc_id {kind}, print long, k int, at int, start int, end int, h long")
    return found.join(by_doc, same).select("doc_id", "print", F.col("asked")[F.col("k")].alias("asked"), "at", "start", "end", "h")


def _reached(docs: DataFrame, runs: DataFrame, size: int, space: Workspace) -> DataFrame:
    """The passages of at least size words, word for word, around runs of fewer: rows as runs has them."""
    windows = space.save(_windows(docs, runs, size, space), "windows")
    place = F.struct("doc_id", "print", "at")
    groups = windows.groupBy("h").agg(F.count("*").alias("size"), F.min(place).alias("one"), F.max(place).alias("other")).where("one <> other")
    found = by_size(windows, space.save(groups.select("h", "size"), "shared-windows"), "h").groupBy("doc_id", "print", "asked").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), (F.max("at") - F.min("at") + size).cast("long").alias("n_words"))
    return found.select("doc_id", "print", "asked.run", "start", "end", "n_words", "asked.n_paragraphs", "asked.n_removed", "asked.first_doc_id")


def passages(docs: DataFrame, percent: int = 75, least_words: int = PASSAGE_WORDS, sentence_words: int = SENTENCE_WORDS, around: bool = False) -> DataFrame:
    """(doc_id, start, end, n_words, n_paragraphs, n_removed, first_doc_id): repeated passages, one row for each.

    start and end are places in the text's characters. n_removed of the n_paragraphs aren't their
    cluster's first and are to be removed; first_doc_id is the least doc_id with a first paragraph
    of the passage's clusters. With around, a passage whose whole paragraphs have fewer words than least_words is
    reported too, as far as runs of least_words words that hold them occur elsewhere word for word; it
    may reach into the passage beside it. least_words and sentence_words bound what counts as a passage and as
    the end of a paragraph; with 1 each, every sentence that occurs again is reported.

    Documents without repeated passages have no row, nor do null, empty and wordless texts; an empty
    table gives an empty result. Rows with equal doc_id and text count as one document, rows that
    share only the doc_id are several. Other columns of docs are ignored.
    """
    space = Workspace(docs.sparkSession, "substrings")
    rows = space.save(repeated_paragraphs(docs, space, percent, sentence_words), "repeated-paragraphs")
    rows = rows.dropDuplicates(["doc_id", "print", "number"])
    order = Window.partitionBy("doc_id", "print").orderBy("number")
    rows = rows.withColumn("run", F.col("number") - F.row_number().over(order))
    found = rows.groupBy("doc_id", "print", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_words").alias("n_words"), F.count("*").alias("n_paragraphs"),
        F.sum((~F.col("first")).cast("long")).alias("n_removed"), F.min("cluster.doc_id").alias("first_doc_id"),
    )
    if not around:
        return found.where(F.col("n_words") >= least_words).drop("run", "print")
    found = space.save(found, "runs")
    texts = docs.select("doc_id", "text").where("text is not null").withColumn("print", F.xxhash64("text"))
    short = _reached(texts, found.where(F.col("n_words") < least_words), least_words, space)
    return found.where(F.col("n_words") >= least_words).unionByName(short).drop("run", "print")
