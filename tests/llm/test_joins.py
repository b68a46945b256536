import pytest
from pyspark.sql import functions as F

from tessera.llm.joins import by_size


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("kind", ["long", "binary", "string"])
def test_rows_of_groups_that_are_not_hot_go_through_no_anti_join(spark, monkeypatch, how, kind):
    """Two hot groups, small ones, keys without a group and null keys give the rows of a plain join."""
    monkeypatch.setattr("tessera.llm.joins.LEAST_HOT", 5)
    made = F.expr("case when id < 20 then 1L when id < 33 then 2L when id % 9 > 0 then id div 3 end")
    rows = spark.range(90).select("id", (made if kind == "long" else made.cast("string").cast(kind)).alias("h"))
    groups = rows.where("h is not null").groupBy("h").agg(F.count("*").alias("size"), F.max("id").alias("most")).where("size > 1")
    got = by_size(rows, groups, "h", how)
    want = rows.join(groups.drop("size"), "h", how)
    assert sorted(map(str, got.select("id", "h", "most").collect())) == sorted(map(str, want.select("id", "h", "most").collect()))
    assert groups.where("size > 5").count() == 2 and want.count() > 40
    assert "LeftAnti" not in got._jdf.queryExecution().toString()


def test_few_groups_are_broadcast_and_more_give_the_same_rows(spark, monkeypatch):
    """Groups far under any hot one need no exchange of rows; beyond the number of few ones the other way has the same rows."""
    rows = spark.range(90).select("id", F.expr("case when id % 9 > 0 then id div 3 end").alias("h"))
    groups = rows.where("h is not null").groupBy("h").agg(F.count("*").alias("size"), F.max("id").alias("most"))
    for how in ("inner", "left"):
        few = by_size(rows, groups, "h", how)
        assert "SortMergeJoin" not in few._jdf.queryExecution().sparkPlan().toString()
        with monkeypatch.context() as m:
            m.setattr("tessera.llm.joins.FEW_GROUPS", 0)
            more = by_size(rows, groups, "h", how)
        assert "SortMergeJoin" in more._jdf.queryExecution().sparkPlan().toString()
        assert sorted(map(str, few.select("id", "h", "most").collect())) == sorted(map(str, more.select("id", "h", "most").collect()))
