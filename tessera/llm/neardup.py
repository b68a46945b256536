"""Near-duplicate linking by HyperMinHash sketches, for documents, and by bands of any kind.

A sketch has 128 buckets. Each keeps the least hash of a text's shingles under its own
multiplier, compressed to 15 bits: the count of leading zeros (5 bits, at most 31) and the ten
mantissa bits after the first one. Four registers make a 60-bit word, and each word is one band.

Texts with equal shingle sets are one node from the start. A first pass counts hashed band values,
and only nodes with a value that occurs again go on. The Jaccard similarity of two nodes of a
bucket is first estimated from the registers, corrected for chance collisions of compressed
registers, and bounded from above by a parity sketch of the set: each shingle flips one of 2048
bits, so two sketches differ in no more bits than the sets do in shingles. Candidates that may
reach the threshold are then verified on the full sets of 64-bit shingle hashes, which are
computed again from the texts.

A bucket of copies isn't expanded into pairs. First each node is held against the least node of
each of its buckets, then what has not joined its bucket's largest component against a
member drawn by hash. What is still outside its bucket's largest component is held against all of
the bucket; where that is more than a few hundred nodes, they are met by the rarest shingles of their
full sets instead, which loses none. Links inside a component can't change the components, so none is lost.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import compiled
from tessera.llm.components import components
from tessera.llm.joins import by_size, marked
from tessera.llm.words import BUCKET, distinct_sets, parts, shingle_hashes, slices, word_hashes, worker
from tessera.llm.workspace import METHOD_BYTES, METHOD_SETTING, Workspace

MANTISSA = 10
#: Numbers of shingles hashed at once: few enough for the processor's cache.
CHUNK = 1 << 15
#: Nodes outside a bucket's largest component that are held against all of its nodes; with more, they meet by their rarest shingles.
FEW = 256
#: Nodes of a bucket that a task holds another node against.
DEAL = 128
#: Chance that two distinct minima of sets of n and m shingles share a register is about
#: COLLIDE * n * m / (n + m)^2: the mean register width over its distance from zero is 1 / (2 ln 2).
COLLIDE = 0.5 / np.log(2) / 2**MANTISSA


class Shape(NamedTuple):
    """bands words of lanes registers each; parity: bits of a parity sketch; slack: how far below the threshold an estimate from the words may be, None for no estimate."""

    bands: int
    lanes: int
    parity: int
    slack: float | None

    @property
    def buckets(self) -> int:
        return self.bands * self.lanes


#: Documents: at a similarity of 0.75 one pair in 190,000 shares no band; the estimate's deviation is 0.038.
DOCUMENT = Shape(32, 4, 2048, 0.15)


def registers(hashes: np.ndarray, n: np.ndarray, buckets: int) -> np.ndarray:
    """(texts with shingles, buckets) 15-bit registers of the sets that follow one another in hashes."""
    n = n[n > 0]
    out = np.empty((len(n), buckets), np.int64)
    ends = np.cumsum(n)
    a = 0
    while a < len(n):
        start = ends[a] - n[a]
        b = max(a + 1, int(np.searchsorted(ends, start + CHUNK, "right")))
        part, at = hashes[start : ends[b - 1]], (ends[a:b] - n[a:b] - start)
        low = np.empty((buckets, b - a), np.uint64)
        for k in range(buckets):
            low[k] = np.minimum.reduceat(part * BUCKET[k], at)
        m, e = np.frexp(low.T.astype(np.float64))
        zeros = np.clip(64 - e, 0, 31)
        mantissa = np.clip((m * 2 - 1) * 2**MANTISSA, 0, 2**MANTISSA - 1).astype(np.int64)
        out[a:b] = (zeros.astype(np.int64) << MANTISSA) | mantissa
        a = b
    return out


def packed(regs: np.ndarray, lanes: int) -> np.ndarray:
    """Registers packed, lanes to a 64-bit word, each in 15 bits; regs may have no rows, as where all texts of a batch are blank."""
    return (regs.reshape(len(regs), regs.shape[1] // lanes, lanes) << (15 * np.arange(lanes)[::-1])).sum(2)


def parities(hashes: np.ndarray, n: np.ndarray, bits: int) -> np.ndarray:
    """(texts with shingles, bits / 64) words of the parity sketches of sets without repeats."""
    n = n[n > 0]
    starts = np.cumsum(n) - n
    out = []
    step = max(1, (1 << 19) // bits)  # so many sketches at once take little memory
    for k in range(0, len(n), step):
        some = n[k : k + step]
        part = hashes[starts[k] : starts[k] + int(some.sum())]
        at = np.repeat(np.arange(len(some)), some) * bits + (part >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64)
        odd = np.bincount(at, minlength=len(some) * bits).reshape(len(some), bits) & 1
        out.append(np.packbits(odd.astype(np.uint8), axis=1, bitorder="little").view("<i8"))
    return np.concatenate(out) if out else np.zeros((0, bits // 64), np.int64)


def word_lists(words: np.ndarray, n: np.ndarray) -> pa.ListArray:
    """One list of words for each text with shingles, an empty one for the others."""
    ends = np.cumsum(np.where(n > 0, words.shape[1], 0))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(words.ravel()))


def _sketch(batches):
    worker("sketches", dict)  # nothing is kept, but what an operator before has kept goes
    for batch in (p for b in batches for p in parts(b)):
        texts = batch.column("text").to_pylist()
        hashes, n = shingle_hashes(*word_hashes(texts))
        sets, n = distinct_sets(hashes, n)
        prints = [xxhash.xxh128_digest(sets[a:b].tobytes()) if b > a else None for a, b in slices(n)]
        words = packed(registers(sets, n, DOCUMENT.buckets), DOCUMENT.lanes)
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), word_lists(words, n), word_lists(parities(sets, n, DOCUMENT.parity), n)],
            names=["key", "n", "node", "sketch", "parity"],
        )


def sketches(items: DataFrame) -> DataFrame:
    """(key, n, node, sketch, parity) of each (key, text): node is a fingerprint of the shingle set, null if it is empty."""
    kind = items.schema["key"].dataType.simpleString()
    return items.select("key", "text").mapInArrow(_sketch, f"key {kind}, n long, node binary, sketch array<long>, parity array<long>")


def estimate(equal: Column, n: Column, m: Column, shape: Shape) -> Column:
    """Jaccard similarity from the number of equal registers, without the expected chance collisions."""
    chance = F.lit(float(COLLIDE)) * n * m / ((n + m) * (n + m))
    return (equal / F.lit(float(shape.buckets)) - chance) / (1 - chance)


class Linker:
    """Links nodes with a Jaccard similarity of at least percent / 100.

    nodes is a saved table, which is deleted: id (long, one for each row), node (fingerprint), key,
    last, size, n, sketch (an array of band values) and parity. fetch gives (id, shingles) of the nodes in a table
    (id, node, key): their distinct 64-bit hashes.
    """

    def __init__(self, nodes: DataFrame, fetch: Callable[[DataFrame], DataFrame], space: Workspace, percent: int, shape: Shape):
        self.space, self.percent, self.shape, self.fetch = space, percent, shape, fetch
        self.columns = ["n", "parity"] if shape.slack is None else ["n", "parity", "sketch"]
        # a join with all its columns can take more code than one method may have
        space.settings[METHOD_SETTING] = str(METHOD_BYTES)
        bands = self.bands(nodes)
        repeated = space.save(bands.groupBy("h").agg(F.count("*").alias("size")).where("size > 1"), "repeated")
        found = space.save(by_size(bands, repeated, "h"), "found")
        space.drop(repeated)
        space.sweep()
        # only nodes that share a value are needed from here on
        active = marked(nodes, F.col("id"), found.select(F.xxhash64("id").alias("h")), repeats=True).where("passed").drop("passed")
        # sketches as bytes, which are compared without making objects of their words
        words = {c: compiled.call(space.spark, "tessera_words", c) for c in self.columns if c != "n"}
        self.active = space.save(active.select("id", "node", "key", "n", *(x.alias(c) for c, x in words.items())), "active")
        # the least key: an original tends to stand before its copies
        keyed = found.join(self.active.select("id", "key"), "id")
        pivots = keyed.groupBy("h").agg(F.min(F.struct("key", "id"))["id"].alias("pivot"), F.count("*").alias("size"))
        pivots = space.save(pivots, "pivots")
        self.buckets = space.save(by_size(found, pivots, "h"), "buckets")
        # what the clusters need in the end, without the sketches
        self.nodes = space.save(nodes.select("id", "node", "key", "last", "size"), "plain-nodes")
        space.drop(found, pivots, nodes)
        space.sweep()
        self.labels = None

    def bands(self, nodes: DataFrame, *more: str) -> DataFrame:
        values = nodes.select("id", *more, F.posexplode("sketch").alias("band", "value"))
        return values.select("id", *more, F.xxhash64("band", "value").alias("h"))

    def likely(self) -> Column:
        n, m, spark = F.col("n_a"), F.col("n_b"), self.space.spark
        fits = 100 * F.least(n, m) >= self.percent * F.greatest(n, m)
        # 100 * (n + m - bits) >= percent * (n + m + bits), for so many bits at most
        most = F.floor((100 - self.percent) * (n + m) / (100 + self.percent)).cast("long")
        may = fits & (compiled.call(spark, "tessera_apart", "parity_a", "parity_b", most) <= most)
        if self.shape.slack is None:
            return may
        equal = compiled.call(spark, "tessera_equal", "sketch_a", "sketch_b", F.lit(self.shape.lanes))
        return may & (estimate(equal, n, m, self.shape) >= self.percent / 100 - self.shape.slack)

    def ends(self, end: str) -> DataFrame:
        return self.active.select(F.col("id").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in self.columns))

    def screen(self, pairs: DataFrame) -> DataFrame:
        """Distinct pairs that sizes and estimates leave."""
        return pairs.select("a", "b").distinct().join(self.ends("a"), "a").join(self.ends("b"), "b").where(self.likely()).select("a", "b")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """Those of the screened pairs whose full sets reach the threshold."""
        pairs = self.space.save(pairs, "screened")
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        wanted = self.space.save(self.active.select("id", "node", "key").join(wanted, "id"), "wanted")
        found = self.space.save(self.fetch(wanted), "sets")
        both = pairs.join(found.select(F.col("id").alias("a"), F.col("shingles").alias("s")), "a")
        both = both.join(found.select(F.col("id").alias("b"), F.col("shingles").alias("t")), "b")
        both = both.select("a", "b", (F.size("s") + F.size("t")).alias("total"), F.size(F.array_intersect("s", "t")).alias("common"))
        links = self.space.save(both, "compared").where(100 * F.col("common") >= self.percent * (F.col("total") - F.col("common"))).select("a", "b")
        self.space.drop(found, pairs, wanted)
        self.space.sweep()
        return links

    def add(self, links: DataFrame) -> None:
        """Components of the links up to now; those known before are stars around their labels."""
        if self.labels is not None:
            links = links.unionByName(self.labels.select(F.col("node").alias("a"), F.col("comp").alias("b")))
        self.labels = components(links, self.space)

    def mixed(self, buckets: DataFrame) -> DataFrame:
        """Rows (h, id, comp) of the buckets whose nodes are in more than one component, with the largest one, main, and the numbers of nodes and of those outside it."""
        rows = buckets.select("h", "id").join(self.labels, F.col("id") == F.col("node"), "left").select("h", "id", F.coalesce("comp", "id").alias("comp"))
        rows = self.space.save(rows, "labelled")
        sizes = rows.groupBy("h", "comp").agg(F.count("*").alias("n")).groupBy("h").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("size"))
        sizes = sizes.where("top.n < size").select("h", "size", F.col("size").alias("n_bucket"), F.col("top.comp").alias("main"), (F.col("size") - F.col("top.n")).alias("n_left"))
        return self.space.save(by_size(rows, self.space.save(sizes, "sizes"), "h"), "mixed")

    def run(self) -> DataFrame:
        """(node, comp) of the ids of nodes that have a link."""
        self.add(self.verify(self.screen(self.buckets.where("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")))))
        mixed = self.mixed(self.buckets)
        large = mixed.where(F.col("n_left") > FEW)
        if not large.isEmpty():
            drawn = large.groupBy("h").agg(F.expr("min_by(struct(id, comp), xxhash64(id))").alias("d"), F.count("*").alias("size"))
            drawn = self.space.save(drawn, "drawn")
            some = by_size(large, drawn, "h").where("comp <> d.comp").select(F.col("id").alias("a"), F.col("d.id").alias("b"))
            new = self.verify(self.screen(some))
            if not new.isEmpty():
                self.add(new)
                mixed = self.mixed(mixed)
        new = self.verify(self.inside(mixed.where(F.col("n_left") <= FEW)))
        if not new.isEmpty():
            self.add(new)
        large = mixed.where(F.col("n_left") > FEW)
        if not large.isEmpty():
            new = self.verify(self.inside(self.mixed(self.prefixes(self.mixed(large)))))
            if not new.isEmpty():
                self.add(new)
        return self.labels

    def prefixes(self, mixed: DataFrame) -> DataFrame:
        """(h, id): buckets of the nodes of mixed that have one of their rarest shingles in common.

        Sets of n and m shingles that reach the threshold share at least percent / 100 of the larger
        one, so they share one of the first n - that + 1 in the order of all these nodes' frequencies.
        No pair is lost, and what many texts have in common comes last.
        """
        wanted = self.space.save(self.active.select("id", "node", "key").join(mixed.select("id").distinct(), "id"), "wanted")
        sets = self.space.save(self.fetch(wanted), "sets")
        each = sets.select("id", F.size("shingles").alias("m"), F.explode("shingles").alias("h"))
        repeated = each.groupBy("h").agg(F.count("*").alias("size")).where("size > 1").withColumn("often", F.col("size"))
        shared = by_size(each, self.space.save(repeated, "shared"), "h")
        # shingles of one node only stand first, and meet nothing
        some = F.col("m") - F.ceil(F.col("m") * self.percent / 100).cast("int") + 1 - (F.col("m") - F.size("o"))
        rows = shared.groupBy("id", "m").agg(F.sort_array(F.collect_list(F.struct("often", "h"))).alias("o"))
        rows = rows.select("id", F.explode(F.slice("o", F.lit(1), F.greatest(some, F.lit(0)))).alias("x")).select("id", "x.h")
        rows = self.space.save(rows, "prefixes")
        self.space.drop(sets, wanted)
        self.space.sweep()
        return rows

    def inside(self, mixed: DataFrame) -> DataFrame:
        """Pairs (a, b) of one bucket whose ends are in different components; the largest component's nodes needn't meet one another.

        A bucket's nodes are dealt out by salts, and screening is part of the join, so its size has no bound.
        """
        rows = mixed.withColumn("salts", F.ceil(F.col("n_bucket") / DEAL).cast("int")).join(self.active.select("id", *self.columns), "id")

        def side(rows: DataFrame, end: str, *more) -> DataFrame:
            return rows.select("h", F.col("id").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in ("comp", *self.columns)), *more)

        left = side(rows.where("comp <> main"), "a", "main", F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"))
        right = side(rows, "b", F.expr("pmod(xxhash64(id), salts)").cast("int").alias("salt"))
        met = (F.col("l.h") == F.col("r.h")) & (F.col("l.salt") == F.col("r.salt")) & F.expr("comp_a <> comp_b and (comp_b = main or a < b)") & self.likely()
        return left.alias("l").join(right.alias("r"), met).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


class TextSets:
    """Shingle sets of wanted nodes, computed again from the texts of the rows that a filter of their keys lets pass."""

    def __init__(self, items: DataFrame):
        self.items = items

    def __call__(self, wanted: DataFrame) -> DataFrame:
        def sets(batches):
            for batch in (p for b in batches for p in parts(b)):
                hashes, n = distinct_sets(*shingle_hashes(*word_hashes(batch.column("text").to_pylist())))
                prints = [xxhash.xxh128_digest(hashes[a:b].tobytes()) if b > a else None for a, b in slices(n)]
                lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int64()), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(prints, pa.binary()), lists.cast(pa.list_(pa.int64()))], names=["node", "shingles"])

        rows = marked(self.items, F.col("key"), wanted.select(F.xxhash64("key").alias("h"))).where("passed").select("text")
        found = rows.mapInArrow(sets, "node binary, shingles array<long>")
        # rows that repeat a text bring its set again
        return found.join(wanted.select("node", "id"), "node").groupBy("node", "id").agg(F.first("shingles").alias("shingles")).drop("node")


def clusters(members: DataFrame, linker: Linker) -> DataFrame:
    """members (with node, its fingerprint) with cluster, the least key of its component, null where no other key is in it.

    The linker's nodes have key and last, the least and the most key, and size, the number of members.
    """
    space, labels = linker.space, linker.run()
    rows = linker.nodes.join(labels.withColumnRenamed("node", "of"), F.col("id") == F.col("of"), "left")
    rows = space.save(rows.withColumn("comp", F.coalesce("comp", "id")).select("node", "comp", "key", "last", F.col("size").alias("rows")), "nodes-labelled")
    least = rows.groupBy("comp").agg(
        F.min("key").alias("cluster"), F.max("last").alias("last_key"), F.sum("rows").alias("total"), F.count("*").alias("size"))
    least = space.save(least.where("total > 1 or size > 1").select("comp", "cluster", "last_key", "size"), "least")
    groups = by_size(rows.select("node", "comp", F.col("rows")), least, "comp").select("node", "cluster", "last_key", F.col("rows").alias("size"))
    return by_size(members, space.save(groups, "groups"), "node", "left")


def near_duplicates(items: DataFrame, space: Workspace, percent: int = 75) -> DataFrame:
    """(key, n, cluster) of each row of items (key, text).

    cluster is the least key that links and equal shingle sets reach; it is null for rows that reach
    no other row and for texts without words.
    """
    members = space.save(sketches(items), "sketches")
    nodes = members.where("node is not null").groupBy("node").agg(
        F.min("key").alias("key"), F.max("key").alias("last"), F.count("*").alias("size"),
        F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("parity").alias("parity"),
    )
    nodes = space.save(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    plain = space.save(members.select("key", "n", "node"), "members")
    space.drop(members)
    space.sweep()
    return clusters(plain, Linker(nodes, TextSets(items), space, percent, DOCUMENT)).select("key", "n", "cluster")
