import math

import duckdb
import pytest

from tessera import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: The others run in the driver's own comparison; these cover each module quickly.
SOME = ["titles", "token_sets", "domain_counts", "bm25_top10", "endpoint_summary", "lead_ledger", "exact_knn", "bridges", "hash_split", "rrf_fusion", "breakdown", "paired_outcomes", "duplicate_texts"]


#: The same without cuts: whole ranks, texts and tables, or every hundredth vector as a query.
WHOLE = ["region_route_whole", "query_similarity_whole", "rrf_fusion_whole", "set_operations_whole", "paired_outcomes_whole", "final_texts_whole"]


def text(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    return str(v)


@pytest.mark.parametrize("name", SOME + WHOLE)
def test_query_equals_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = catalog.queries()[name](spark, sf)
    want = con.sql(catalog.oracles()[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    rows = lambda cols, data: sorted(tuple(text(r[cols.index(c)]) for c in order) for r in data)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_flagship_fuses_whole_ranks(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    cut = catalog.oracles()["rrf_fusion"]
    whole = cut.replace(" WHERE rank <= 50", "")
    assert cut.count(" WHERE rank <= 50") == 2 and " <= 50" not in whole
    want = con.sql(f"SELECT query_id, doc_id, rank_, score FROM ({whole})").fetchall()
    rows = lambda data: sorted(tuple(map(text, r)) for r in data)
    assert rows(catalog.flagship(spark, sf).collect()) == rows(want) != rows(con.sql(f"SELECT query_id, doc_id, rank_, score FROM ({cut})").fetchall())


def test_entry(spark, sf):
    import __spark_entry__

    assert __spark_entry__.queries().keys() >= __spark_entry__.oracle_sql().keys()
    assert __spark_entry__.entry(spark).count() >= 0


@pytest.mark.parametrize("module", ["trajectory_queries", "benchmark_queries", "router_queries"])
def test_whole_modules_equal_their_oracles(spark, sf, module):
    import importlib

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    for name, (query, sql) in importlib.import_module(f"tessera.plans.{module}").QUERIES.items():
        df = query(spark, sf)
        order = sorted(df.columns)
        if sql is None:
            assert df.collect() is not None
            continue
        want = con.sql(sql)
        assert order == sorted(want.columns), name
        rows = lambda cols, data: sorted(tuple(text(r[cols.index(c)]) for c in order) for r in data)  # noqa: E731, B023
        assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall()), name
