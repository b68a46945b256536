"""Packing token ids into windows by non-negative least squares (operator 2).

Documents become ids, and ids are cut into pieces: whole windows, and one rest for each document.
The histogram of lengths is all that the driver sees. Combinations of at most three lengths, in
steps of eight tokens, that fill a window are enumerated; non-negative least squares finds how
often each is repeated; the counts are rounded to what the histogram has. What is left over is
packed greedily by exact lengths, and a piece that doesn't fit is cut, so that windows are full.

The plan is a list of runs: pieces of one length, from one rank to another, and the sequences and
places that they go to. It has a bounded number of rows whatever the input, and as lengths are
exact in it, a piece finds its sequence and offset by its rank among the pieces of its length.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.joins import marked
from tessera.llm.tokens import encoder
from tessera.llm.words import parts
from tessera.llm.workspace import Workspace

WINDOW = 2048
#: Tokens that lengths are rounded up to where combinations are solved for: a piece of these wastes less than this.
STEP = 8
#: Parts that a length's pieces are ranked in, so that one length of a third of all rows is spread.
SALTS = 256


def token_pieces(docs: DataFrame, path: str, end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens) of the ids of each document with its end id.

    ids holds little-endian unsigned 32-bit integers. A null or empty text has its end id alone;
    repeated rows are documents of their own; other columns of docs are left out.
    """
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        encode = encoder(path, words=True).encode
        for batch in batches:
            for part in parts(batch):
                rows: list[tuple[int, int, int, bytes]] = []
                for i, ids in enumerate(encode(part.column("text").to_pylist())):
                    ids += end
                    n = len(ids) // 4
                    rows += [(i, s, n, ids[4 * s : 4 * (s + window)]) for s in range(0, n, window)]
                owner, start, total, ids = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(owner)), pa.array(start, pa.int64()),
                        pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64()),
                    ],
                    names=["doc_id", "start", "length", "ids", "doc_tokens"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long")


def combinations(units: int) -> np.ndarray:
    """(units, combinations) how often each length 1..units is used by one to three lengths that sum to units."""
    found = [(units,)]
    found += [(a, units - a) for a in range(1, units // 2 + 1)]
    found += [(a, b, units - a - b) for a in range(1, units // 3 + 1) for b in range(a, (units - a) // 2 + 1)]
    out = np.zeros((units, len(found)))
    for j, parts in enumerate(found):
        for p in parts:
            out[p - 1, j] += 1
    return out


def nnls(a: np.ndarray, y: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """x >= 0 with the least |a x - y|, by the active-set method of Lawson and Hanson."""
    x = np.zeros(a.shape[1])
    used = np.zeros(a.shape[1], bool)
    loss = float(y @ y)
    for _ in range(rounds):
        slope = a.T @ (y - a @ x)
        slope[used] = -np.inf
        j = int(np.argmax(slope))
        if slope[j] <= 1e-9:
            break
        used[j] = True
        while True:
            at = np.flatnonzero(used)
            some = a[:, at]
            z = np.linalg.solve(some.T @ some + 1e-10 * np.eye(len(at)), some.T @ y)
            if (z > 0).all():
                x[:] = 0
                x[at] = z
                break
            low = z <= 0
            step = np.min(x[at][low] / np.maximum(x[at][low] - z[low], 1e-300))
            x[at] += step * (z - x[at])
            used[at[x[at] <= 1e-12]] = False
            x[~used] = 0
            if not used.any():
                break
        rest = y - a @ x
        if loss - float(rest @ rest) <= 1e-9 * loss:
            break
        loss = float(rest @ rest)
    return x


class Run(NamedTuple):
    """Pieces of a length with ranks lo to hi: from token cut_from on, cut_len tokens go u to a sequence from first on, one after the other from base."""

    length: int
    lo: int
    hi: int
    cut_from: int
    cut_len: int
    k0: int
    u: int
    first: int
    base: int


class Stock:
    """Pieces by what is left of them: runs of ranks of an original length, cut at some token."""

    def __init__(self, histogram: dict[int, int], window: int):
        self.count = np.zeros(window + 1, np.int64)
        self.parts: list[list[tuple[int, int, int, int]]] = [[] for _ in range(window + 1)]
        for length, n in histogram.items():
            self.put(length, (length, 0, n, 0))

    def put(self, left: int, part: tuple[int, int, int, int]) -> None:
        self.parts[left].append(part)
        self.count[left] += part[2] - part[1]

    def take(self, left: int, n: int) -> list[tuple[int, int, int, int]]:
        out = []
        self.count[left] -= n
        while n:
            length, lo, hi, at = self.parts[left].pop()
            some = min(n, hi - lo)
            if some < hi - lo:
                self.parts[left].append((length, lo + some, hi, at))
            out.append((length, lo, lo + some, at))
            n -= some
        return out


def plan(histogram: dict[int, int], window: int, step: int = STEP) -> list[Run]:
    """Where the pieces of each length (1 to window) go; every token of each in exactly one run."""
    stock, runs, first = Stock(histogram, window), [], 0

    def emit(pattern: list[tuple[int, int, int]], n: int) -> None:
        """n sequences of (length left, how many of them, tokens of each); what is cut off goes back."""
        nonlocal first
        base = 0
        for left, u, size in pattern:
            k = 0
            for length, lo, hi, at in stock.take(left, u * n):
                runs.append(Run(length, lo, hi, at, size, k, u, first, base))
                k += hi - lo
                if size < left:
                    stock.put(left - size, (length, lo, hi, at + size))
            base += u * size
        first += n

    if stock.count[window]:  # pieces that fill a window need no partner
        emit([(window, 1, window)], int(stock.count[window]))
    units = window // step
    total = int(stock.count.sum())
    if total and units > 1 and window % step == 0:
        bins = np.zeros(units, np.int64)
        np.add.at(bins, (np.arange(1, window + 1) - 1) // step, stock.count[1:])
        a = combinations(units)[:-1, 1:]
        x = nnls(a, bins[:-1] / total) * total
        for j in np.argsort(-x, kind="stable"):
            if x[j] < 1:
                break
            uses = a[:, j].astype(np.int64)
            at = np.flatnonzero(uses)
            n = int(min(round(x[j]), (bins[at] // uses[at]).min()))
            if not n:
                continue
            bins[at] -= n * uses[at]
            sides = []
            for b in (int(b) for b in at for _ in range(uses[b])):  # exact lengths of each place, the longest first
                side, want = [], n
                for left in range((b + 1) * step, b * step, -1):
                    taken = sum(m for other in sides for x_left, m in other if x_left == left)
                    some = min(want, int(stock.count[left]) - taken)
                    if some > 0:
                        side.append((left, some))
                        want -= some
                sides.append(side)
            done = 0
            at_run, used = [0] * len(sides), [0] * len(sides)
            while done < n:  # lengths change at different sequences in the places
                some = min(side[i][1] - u for side, i, u in zip(sides, at_run, used))
                emit([(side[i][0], 1, side[i][0]) for side, i in zip(sides, at_run)], some)
                done += some
                for k, side in enumerate(sides):
                    used[k] += some
                    if used[k] == side[at_run[k]][1]:
                        at_run[k], used[k] = at_run[k] + 1, 0
    while stock.count.any():
        pattern, free, rest = [], window, stock.count.copy()
        while free:
            fits = np.flatnonzero(rest[: free + 1])
            if len(fits):
                left = int(fits[-1])
                u = min(free // left, int(rest[left]))
                pattern.append((left, u, left))
            else:
                longer = np.flatnonzero(rest)
                if not len(longer):
                    break
                left, u = int(longer[-1]), 1
                pattern.append((left, 1, free))
            rest[left] -= u
            free -= u * pattern[-1][2]
        uses = np.zeros(window + 1, np.int64)
        for left, u, _ in pattern:
            uses[left] += u
        at = np.flatnonzero(uses)
        emit(pattern, int((stock.count[at] // uses[at]).min()))
    return runs


def place(pieces: DataFrame, space: Workspace, window: int = WINDOW, step: int = STEP) -> DataFrame:
    """pieces, a saved table (piece, a number of its own; length, 1 to window; any other columns), with cut_from, cut_len, sequence_id and offset.

    A piece has a row for each part that it is cut into. Each sequence has at most window tokens,
    without gaps from offset 0. Which of several pieces of one length goes where follows the pieces'
    numbers. An empty table gives an empty result.
    """
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("piece"), F.lit(SALTS)).cast("int"))
    counts = space.save(salted.groupBy("length", "_salt").agg(F.count("*").alias("n")), "counts")
    before = counts.withColumn("_before", F.sum("n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("n")).drop("n")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row per length
    runs = [tuple(map(int, r)) for r in plan(histogram, window, step)]
    slots = space.spark.createDataFrame(runs, "length long, lo long, hi long, cut_from long, cut_len long, k0 long, u long, first long, base long").coalesce(1)
    order = Window.partitionBy("length", "_salt").orderBy("piece")
    ranked = salted.withColumn("_rank", F.row_number().over(order)).join(before, ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_before") - 1)
    # the plan's rows are bounded by the lengths and the combinations' size, not by the input
    found = ranked.join(F.broadcast(slots), "length").where("_rank >= lo and _rank < hi").withColumn("_k", F.expr("k0 + _rank - lo"))
    return found.select(*pieces.columns, "cut_from", "cut_len", F.expr("first + _k div u").alias("sequence_id"), F.expr("base + (_k % u) * cut_len").alias("offset"))


def pack_documents(docs: DataFrame, path: str, end_id: int = 1, window: int = WINDOW, step: int = STEP) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): the pieces of all documents, as token_pieces states, and their places."""
    space = Workspace(docs.sparkSession, "packing")
    pieces = space.save(token_pieces(docs, path, end_id, window).withColumn("piece", F.monotonically_increasing_id()), "pieces")
    placed = place(pieces.select("piece", "length"), space, window, step).select("piece", "cut_from", "cut_len", "sequence_id", "offset")
    ids = F.expr("substring(ids, cast(4 * cut_from + 1 as int), cast(4 * cut_len as int))")
    found = pieces.join(placed, "piece").withColumn("ids", ids)
    return found.select("doc_id", (F.col("start") + F.col("cut_from")).alias("start"), F.col("cut_len").alias("length"), "ids", "doc_tokens", "sequence_id", "offset")


def piece_digests(docs: DataFrame, path: str, end_id: int = 1, window: int = WINDOW, step: int = STEP) -> DataFrame:
    """As pack_documents, with ids_crc32, a checksum of each piece's ids, instead of them: only ids of pieces that are cut move."""
    space = Workspace(docs.sparkSession, "packing")
    pieces = token_pieces(docs, path, end_id, window).withColumn("ids_crc32", F.crc32("ids")).withColumn("piece", F.monotonically_increasing_id())
    pieces = space.save(pieces.withColumn("ids", F.when(F.col("length") < window, F.col("ids"))), "pieces")
    placed = space.save(place(pieces.drop("ids"), space, window, step), "placed")
    cut = placed.where("cut_len < length").drop("ids_crc32")
    numbers = space.save(cut.select(F.xxhash64("piece").alias("h")).distinct(), "cut")
    ids = marked(pieces.where(F.col("length") < window).select("piece", "ids"), F.col("piece"), numbers).where("passed").drop("passed")
    part = F.expr("substring(ids, cast(4 * cut_from + 1 as int), cast(4 * cut_len as int))")
    cut = cut.join(ids, "piece").withColumn("ids_crc32", F.crc32(part)).select(placed.columns)
    found = placed.where("cut_len = length").unionByName(cut)
    return found.select("doc_id", (F.col("start") + F.col("cut_from")).alias("start"), F.col("cut_len").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset")
