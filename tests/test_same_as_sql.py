"""Queries on rows that the shared tables lack, against their SQL."""

import duckdb
from pyspark.sql import functions as F

from tessera import catalog
from tessera.functions import text as X
from tessera.operators import router_data


def held_against_sql(spark, folder, names, **tables):
    con = duckdb.connect()
    for table, rows in tables.items():
        rows.write.parquet(f"{folder}/{table}.parquet")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    for name in names:
        got = catalog.queries()[name](spark, str(folder))
        want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({catalog.oracles()[name]})").fetchall()
        assert sorted(str(tuple(x)) for x in got.collect()) == sorted(map(str, want)), name


def test_events_without_time_or_id_come_last(spark, tmp_path):
    rows = [(1, 10, 7, 900.0), (2, None, 7, 1500.0), (3, 20, 7, 600.0), (4, 30, 7, 700.0), (None, 20, 7, 1.0), (5, 10, 8, 2000.0)]
    rows = spark.createDataFrame(rows, "event_id long, t long, user_id long, value double")
    held_against_sql(spark, tmp_path, ["budget_trigger", "running_cost"], events=rows.select("event_id", F.timestamp_seconds("t").alias("ts"), "user_id", "value"))


def test_capitals_of_several_characters_null_atoms_and_commas(spark, tmp_path):
    texts = ["Erßie x y z u v", "ŉa ǰb ﬁc ᾳd λόγος ẞe v", "1,2,3 a b 1,23 c 4,5,6 d", "one two", "Σας İx a b c d e", ""]
    rows = [(i, t) for i, t in enumerate(8 * texts)]
    held_against_sql(spark, tmp_path, ["fanout_scores"], benchmark=spark.createDataFrame(rows, "item_id long, text string"))


def test_simple_case_of_all_characters(spark):
    made = [c for c in map(chr, range(1, 0x10000)) if not 0xD800 <= ord(c) < 0xE000 and len(c.upper()) > 1] + ["aß", "ΑΣ", "İ"]
    rows = spark.createDataFrame([(c,) for c in made], "c string").select("c", X.simple_upper(F.col("c")).alias("u"), X.simple_lower(F.col("c")).alias("l"))
    con = duckdb.connect()
    assert [tuple(x) for x in rows.collect()] == [(c, *con.execute("SELECT upper(?), lower(?)", [c, c]).fetchall()[0]) for c in made]


def test_negatives_are_ranked_once_for_all_queries_of_a_document(spark):
    places = spark.range(40).select(F.col("id").alias("doc_id"), (F.col("id") % 4).alias("leaf"), (F.col("id") % 2).alias("parent"))
    positives = spark.range(300).select(F.col("id").alias("query_id"), (F.col("id") % 3).alias("doc_id"))
    found = router_data.region_negatives(positives.unionByName(positives), places, 4)
    rows = found.collect()
    assert len(rows) == 300 * 8 and {x.n for x in rows} == {1, 2, 3, 4}
    assert len({(x.query_id % 3, x.doc_id, x.pool, x.n) for x in rows}) == 3 * 8
    windows = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in line]
    assert windows and not any("query_id" in line for line in windows)


def test_copies_are_one_class_until_the_last_join(spark, tmp_path):
    """Large groups of copies, near copies and rows without tokens give the SQL's pairs, and no token array meets another copy's."""
    base, other = [f"w{k}" for k in range(30)], [f"v{k}" for k in range(9)]
    texts = [" ".join(base)] * 20 + [" ".join(base[::-1])] * 5 + [" ".join([*base[:26], f"x{k % 3}", f"y{k % 3}"]) for k in range(9)] + [" ".join(other[: 4 + k % 6]) for k in range(18)] + ["...", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held_against_sql(spark, tmp_path, ["near_token_pairs"], documents=rows)
    found = catalog.queries()["near_token_pairs"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    arrays = plan[plan.index("array_intersect") :]
    assert "min(doc_id" in arrays and "first(t" in arrays
