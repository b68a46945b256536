"""Sketches are compared in Java as the definitions in Python have it, by expressions of a few nodes."""

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import compiled, neardup
from tessera.llm.joins import marked
from tessera.llm.substring_dedup import PARAGRAPH
from tessera.llm.workspace import Workspace


def test_bits_and_registers_equal_numpy(spark):
    r = np.random.default_rng(5)
    words = r.integers(-(2**63), 2**63, (40, 2, 32))
    regs = r.integers(0, 2**15, (40, 2, 128))
    regs[:, 1] = np.where(r.random((40, 128)) < 0.6, regs[:, 0], regs[:, 1])
    words[3, 1], regs[3, 1] = words[3, 0], regs[3, 0]
    regs[4] = 2**15 - 1
    packed = np.stack([neardup.packed(regs[:, k], 4) for k in (0, 1)], 1)
    rows = [(k, *(x.tolist() for x in (*words[k], *packed[k]))) for k in range(40)]
    table = spark.createDataFrame(rows, "k int, p array<long>, q array<long>, s array<long>, t array<long>")
    table = table.select("k", *(compiled.call(spark, "tessera_words", c).alias(c) for c in "pqst"))
    apart = lambda most: compiled.call(spark, "tessera_apart", "p", "q", F.lit(most).cast("long"))
    got = table.select("k", apart(2048).alias("all"), (apart(1000) <= 1000).alias("near"), compiled.call(spark, "tessera_equal", "s", "t", F.lit(4)).alias("equal"))
    bits = [sum(int(v & (2**64 - 1)).bit_count() for v in map(int, a ^ b)) for a, b in words]
    assert {tuple(x) for x in got.collect()} == {(k, bits[k], bits[k] <= 1000, int((regs[k, 0] == regs[k, 1]).sum())) for k in range(40)}


def test_conditions_of_pairs_stay_small(spark):
    """Each task makes code of them anew where Spark doesn't compile a whole stage."""
    linker = neardup.Linker.__new__(neardup.Linker)
    linker.space, linker.percent = Workspace(spark, "t"), 75
    for shape in (neardup.DOCUMENT, PARAGRAPH):
        linker.shape = shape
        assert len(str(linker.likely())) < 2_000


def test_keys_that_repeat_are_counted_once(spark):
    keys = spark.range(3000).select(F.xxhash64(F.col("id") % 30).alias("h"))
    rows = marked(spark.range(1000), F.col("id"), keys, most=30, repeats=True)
    assert rows.where("passed").count() < 100 and rows.where("passed and id < 30").count() == 30
