from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_near_duplicates import brute
from tests.llm.test_tokens import check_packing


def test_every_stage_on_odd_rows(spark, odd, empty, sf):
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns, name
            out.count()
        check_packing(corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect())


def test_pipeline_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    one = stages["language ID"](spark, docs, sf)
    assert docs.join(one, "doc_id", "left_anti").where(F.regexp_like("text", F.lit(r"\p{L}"))).count() <= 2
    two = stages["line dedup"](spark, one, sf)
    assert two.count() == one.count() and two.where("n_chars <> length(text)").count() == 0
    three = stages["MinHash near-dedup"](spark, two, sf)
    want = {i for i, (_, comp) in brute([(r.doc_id, r.text) for r in two.collect()]).items() if i == comp}
    assert {r.doc_id for r in three.collect()} == want
    four = stages["benchmark decontamination"](spark, three, sf)
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert all(not any(i in r.text for i in items) for r in four.collect())
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in four.collect()} and check_packing(rows) > 0.8
