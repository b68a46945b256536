import duckdb
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from tessera.llm import decontaminate, line_dedup, sharding


def test_line_dedup_equals_oracle(spark, sf):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = sorted(duckdb.sql(f"SELECT doc_id, text, n_lines, n_removed FROM ({line_dedup.ORACLE})").fetchall())
    got = line_dedup.dedup(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", "text", "n_lines", "n_removed")
    assert sorted(map(tuple, got.collect())) == want


def test_line_dedup_of_odd_rows(odd, empty):
    out = line_dedup.dedup(odd)
    rows = out.collect()
    assert out.columns == [*odd.columns, "n_lines", "n_removed"] and len(rows) == odd.count()
    by = {(x.doc_id): x for x in rows}
    assert by[4].text is None and by[4].n_lines == 0 and by[5].text == "" and by[5].n_lines == 1 and by[6].text == " \t\n "
    assert by[2].n_removed > 0 and by[1].n_removed > 0  # the row without doc_id comes first
    assert line_dedup.dedup(empty).count() == 0 and line_dedup.deduped(odd).columns == odd.columns


def test_a_shared_passage_is_found_behind_other_lines(spark):
    passage = prose(41, 240)
    rows = [(1, passage), (2, prose(42, 60) + "\n" + passage), (3, prose(43, 60))]
    got = {x.doc_id: x for x in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_removed == 0 and got[3].n_removed == 0 and got[2].n_removed >= 14


def test_whole_passages_go_in_the_pipeline(spark):
    rows = [(1, prose(50, 60))]
    for n in (2, 3, 4, 7):
        passage = prose(50 + n, 12 * n)
        rows += [(10 * n, prose(100 + n, 48) + "\n" + passage + "\n" + prose(200 + n, 48)), (10 * n + 1, prose(300 + n, 36) + "\n" + passage + "\n" + prose(400 + n, 36))]
    rows.append((90, "one\n\n\ntwo\n" + prose(90, 24)))
    rows.append((91, "zero\none\n\n\ntwo\nthree"))
    got = {x.doc_id: x.text for x in line_dedup.deduped(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == t for i, t in rows if i % 10 == 0)
    assert all(got[10 * n + 1] == prose(300 + n, 36) + "\n" + prose(400 + n, 36) for n in (2, 3, 4, 7)) and got[91] == "zero\nthree"


def test_line_pairs_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen, want = set(), {}
    for i, text in sorted((r.doc_id, r.text) for r in docs.collect()):
        lines = text.split("\n")
        filled = [k for k, x in enumerate(lines) if x.strip()]
        lost = set()
        for a, b in zip(filled, filled[1:]):
            pair = "\n".join(lines[a : b + 1])
            if pair in seen:
                lost |= set(range(a, b + 1))
            seen.add(pair)
        want[i] = "\n".join(x for k, x in enumerate(lines) if k not in lost)
    assert {x.doc_id: x.text for x in line_dedup.deduped(docs).collect()} == want


def test_hits_equal_brute_force_and_oracle(spark, sf):
    for name in ("documents", "benchmark"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    want = sorted(duckdb.sql(f"SELECT doc_id, item_id, n_item, n_shared FROM ({decontaminate.ORACLE})").fetchall())
    docs, items = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "benchmark"))
    assert sorted(map(tuple, decontaminate.hits(docs, items).select("doc_id", "item_id", "n_item", "n_shared").collect())) == want


def test_items_in_long_and_edited_documents(spark, odd, empty):
    item = prose(60, 50)
    words = item.split(" ")
    edited = " ".join(words[:20] + ["changed"] + words[21:])
    half = " ".join(words[: len(words) // 2])
    docs = spark.createDataFrame([(1, prose(61, 9000) + " " + item.upper() + " " + prose(62, 50)), (2, prose(63, 99) + "\t" + edited), (3, prose(64, 99) + " " + half), (4, "only this"), (5, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, "Only  this"), (9, ""), (10, None)], "item_id long, text string")
    assert sorted((x.doc_id, x.item_id) for x in decontaminate.hits(docs, items).collect()) == [(1, 7), (2, 7), (4, 8)]
    left = decontaminate.clean(docs, items)
    assert left.columns == docs.columns and sorted(x.doc_id for x in left.collect()) == [3, 5]
    one = odd.where("doc_id = 1").select(F.lit(1).alias("item_id"), "text")
    assert {x.doc_id for x in decontaminate.hits(odd, one).collect()} == {1, 2, 3, None}
    assert decontaminate.hits(empty, items).count() == 0 and decontaminate.hits(docs, items.limit(0)).count() == 0
    assert decontaminate.clean(odd, one).columns == odd.columns


def test_lookup_table_is_balanced_and_stable(spark, odd, empty):
    a = sharding.lookup_table([f"s{i}" for i in range(10)], 1009)
    assert len(a) == 1009 and max(a.count(i) for i in range(10)) - min(a.count(i) for i in range(10)) <= 1
    b = sharding.lookup_table([f"s{i}" for i in range(9)], 1009)
    assert sum(x == y for x, y in zip(a, b) if x < 9) > 0.7 * 908
    out = sharding.shard(odd, "doc_id")
    rows = out.collect()
    table = sharding.lookup_table([f"shard-{i}" for i in range(64)])
    assert len(rows) == odd.count() and all(x.shard == table[x.slot] for x in rows) and len({x.slot for x in rows if x.doc_id == 2}) == 1
    assert out.columns == [*odd.columns, "slot", "shard"] and sharding.shard(empty, "doc_id").count() == 0


def test_shards_are_written_and_read_whole(spark, odd, empty, tmp_path):
    sharding.write_shards(odd, "doc_id", f"{tmp_path}/a")
    rows = sharding.read_shards(odd, f"{tmp_path}/a")
    assert rows.columns == [*odd.columns, "slot", "shard"]
    assert sorted(map(str, rows.collect())) == sorted(map(str, sharding.shard(odd, "doc_id").collect()))
    sharding.write_shards(empty, "doc_id", f"{tmp_path}/b")
    assert sharding.read_shards(empty, f"{tmp_path}/b").count() == 0


def test_sketches_that_are_too_many_to_broadcast_find_the_same(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "benchmark"))
    few, many = (sorted(map(tuple, decontaminate.hits(docs, items, broadcast_rows=n).collect())) for n in (decontaminate.BROADCAST_ROWS, 0))
    assert few == many and few


def test_a_chunk_of_a_third_of_all_rows(spark, monkeypatch):
    """Hot chunks are joined apart from the others, with the same result."""
    monkeypatch.setattr("tessera.llm.joins.LEAST_HOT", 3)
    passage = prose(41, 120)
    rows = [(k, prose(500 + k, 48) + "\n" + (passage if k % 3 == 0 else prose(900 + k // 2, 60))) for k in range(60)]
    got = {x.doc_id: x for x in line_dedup.deduped(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(passage not in got[k].text for k in range(3, 60, 3)) and passage in got[0].text
