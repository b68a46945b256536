"""Batches in which no text has a word, as line dedup leaves them where a corpus holds whole copies."""

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import minhash_dedup, neardup
from tests.llm.conftest import prose


def test_sketches_of_blank_texts():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["", None, " \n\t"])], names=["key", "text"])
    (out,) = neardup._sketch([batch])
    assert out.to_pylist() == [{"key": k, "n": 0, "node": None, "sketch": [], "parity": []} for k in (1, 2, 3)]


def test_tables_of_blank_texts(spark):
    blank = spark.range(30).select(F.col("id").alias("doc_id"), F.expr("element_at(array('', null, ' \n\t'), cast(id % 3 + 1 as int))").alias("text")).coalesce(1)
    rows = minhash_dedup.dedup(blank).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows) == [(i, 0, i, True) for i in range(30)]
    assert minhash_dedup.keep_one(blank).count() == 30


def test_near_dedup_after_line_dedup_of_copies(spark, sf):
    """The copies are rows with other ids in files of their own, so line dedup leaves their tasks blank texts only."""
    docs = spark.createDataFrame([(i, prose(i, 60)) for i in range(20)], "doc_id long, text string").coalesce(1)
    both = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1000))
    stages = dict(corpus_pipeline.STAGES)
    left = stages["MinHash near-dedup"](spark, stages["line dedup"](spark, both, sf), sf).collect()
    assert {r.doc_id: r.text for r in left} == {r.doc_id: r.text for r in docs.collect()} | {i + 1000: "" for i in range(20)}
