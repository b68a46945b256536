"""Benchmark decontamination by size-partitioned MinHash containment search (operator 7), in DataFrame functions only.

An item's sketch has one element per mask: the shingle hash that is least after exclusive-or with
the mask. Items are partitioned by their number of shingles, in powers of two; for the items of
one partition documents are searched in overlapping windows of twice the partition's upper bound,
so that a short item is never held against the minima of a whole long document.

A window is a candidate for an item if they agree on the minimum of some mask. The search for
agreeing minima starts from the sketch elements, which are joined with the documents' shingle
hashes; only the windows around them are sketched. Candidates are verified: the item's distinct
shingles, as texts, that the whole document has.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.joins import marked
from tessera.llm.workspace import Workspace

SHINGLE = 5
#: Fixed masks. At a containment of 0.75 a window has a Jaccard similarity with its item of 0.17 or more.
MASKS = [int(x) for x in np.random.Generator(np.random.PCG64(7)).integers(-(2**63), 2**63 - 1, 64)]
#: Sketch elements up to this number are broadcast; beyond it they are joined by a shuffle, with the same result.
BROADCAST_ROWS = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """A-Z in lower case, cut at 0x20 and 0x09-0x0D; a null text has no words."""
    found = F.filter(F.split(F.translate(text, UPPER, LOWER), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.coalesce(found, F.array().cast("array<string>"))


def shingle_hashes(w: Column) -> Column:
    """Hashes of all places' shingles; fewer than five words are one shingle, no words none."""
    run = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(w) - SHINGLE + 1, F.lit(1))),
        lambda i: F.xxhash64(*(F.get(w, i - 1 + k) for k in range(SHINGLE))),
    )
    return F.when(F.size(w) > 0, run).otherwise(F.array().cast("array<bigint>"))


def shingle_texts(w: Column) -> Column:
    """Distinct shingles as texts."""
    run = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - SHINGLE + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, SHINGLE), " "))
    return F.when(F.size(w) > 0, F.array_distinct(run)).otherwise(F.array().cast("array<string>"))


def least(hashes: Column) -> Column:
    """The element that is least under each mask."""

    def under(mask: int) -> Column:
        return F.array_min(F.transform(hashes, lambda x: x.bitwiseXOR(F.lit(mask)))).bitwiseXOR(F.lit(mask))

    return F.array(*map(under, MASKS))


def hits(docs: DataFrame, items: DataFrame, percent: int = 75, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared): items of which a document has at least percent % of the distinct 5-word shingles.

    Items without words are found nowhere, and items of fewer than five words only in documents
    with exactly these words; null and wordless texts of documents have nothing. Rows that repeat
    an item_id or a doc_id are tested one by one and reported once, with their largest overlap.
    Rows without doc_id or item_id are reported with a null. Other columns are ignored.
    """
    space = Workspace(docs.sparkSession, "decontaminate")
    items = items.select("item_id", F.monotonically_increasing_id().alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    items = items.withColumn("shingles", shingle_texts(F.col("w"))).withColumn("hashes", shingle_hashes(F.col("w")))
    items = items.withColumn("n_item", F.size("shingles")).withColumn("sketch", least(F.col("hashes")))
    # a window of the item's partition has twice its upper bound
    items = items.withColumn("stride", F.expr("cast(greatest(8, power(2, ceil(log2(n_item)))) as int)"))
    items = space.save(items.select("item_id", "item", "shingles", "n_item", "sketch", "stride"), "items")
    wanted = items.select("item", "n_item", "stride", F.explode(F.array_distinct("sketch")).alias("hash"))
    spread = F.broadcast if wanted.count() <= broadcast_rows else lambda d: d

    held = docs.select("doc_id", "text").withColumn("w", words(F.col("text"))).withColumn("h", shingle_hashes(F.col("w")))
    # posexplode_outer: the filter that Spark infers for posexplode would compute the hashes twice
    places = held.select("doc_id", F.posexplode_outer("h").alias("at", "hash")).join(spread(wanted), "hash")
    # of an item's elements a document may lack as many as the threshold lets it lack shingles
    distinct = wanted.groupBy("item").agg(F.count("*").alias("n_elements"))
    window = F.floor(F.col("at") / F.col("stride")).cast("int")
    found = places.groupBy("doc_id", "item").agg(
        F.count_distinct("hash").alias("n"),
        F.collect_set(window).alias("windows"),
    )
    found = found.join(spread(items.select("item", "n_item").join(distinct, "item")), "item")
    found = found.where(F.col("n") >= F.greatest(F.lit(1), F.col("n_elements") - F.floor(F.col("n_item") * (100 - percent) / 100)))
    found = space.save(found.select("doc_id", "item", "windows"), "found")

    known = space.save(found.select(F.xxhash64("doc_id").alias("h")).distinct(), "known")
    texts = marked(docs.select("doc_id", "text"), F.col("doc_id"), known)
    texts = texts.where("passed").select(F.col("doc_id").alias("of"), "text")
    pairs = found.join(texts, F.col("doc_id").eqNullSafe(F.col("of"))).join(items, "item")
    pairs = pairs.withColumn("w", words(F.col("text"))).withColumn("h", shingle_hashes(F.col("w")))
    # each place lies in the window that starts at its stride and in the one before
    agrees = F.exists(
        F.array_distinct(F.flatten(F.transform("windows", lambda k: F.array(k, F.greatest(k - 1, F.lit(0)))))),
        lambda k: F.exists(
            F.arrays_zip(F.array(*(F.lit(m) for m in MASKS)).alias("m"), F.col("sketch").alias("s")),
            lambda z: F.array_min(F.transform(F.slice(F.col("h"), k * F.col("stride") + 1, 2 * F.col("stride")), lambda x: x.bitwiseXOR(z["m"]))) == z["s"].bitwiseXOR(z["m"]),
        ),
    )
    shared = F.size(F.array_intersect("shingles", shingle_texts(F.col("w"))))
    judged = pairs.select("doc_id", "item_id", "n_item", (agrees & (F.size("h") > 0)).alias("near"), shared.alias("n_shared"))
    # written before it is filtered: a filter would be pushed below and compute the hashes inside the loops
    pairs = space.save(judged, "judged").where("near").where(100 * F.col("n_shared") >= percent * F.col("n_item"))
    return pairs.groupBy("doc_id", "item_id").agg(
        F.max_by(F.struct(F.col("n_item").cast("long").alias("n_item"), F.col("n_shared").cast("long").alias("n_shared")), F.col("n_shared") / F.col("n_item")).alias("best")
    ).select("doc_id", "item_id", "best.n_item", "best.n_shared")


def clean(docs: DataFrame, items: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of docs that have no item; all their columns."""
    space = Workspace(docs.sparkSession, "decontaminate")
    bad = space.save(hits(docs, items, percent).select(F.col("doc_id").alias("_bad_id")).distinct(), "bad")
    names = docs.columns
    id_name = F.col(f"c{names.index('doc_id')}")
    held = marked(docs.toDF(*(f"c{i}" for i in range(len(names)))), id_name, bad.select(F.xxhash64("_bad_id").alias("h")))
    some = held.where("passed").join(bad, id_name.eqNullSafe(F.col("_bad_id")), "left_anti")
    return held.where("not passed").unionByName(some).drop("passed").toDF(*names)


ORACLE = r"""
WITH cut AS (
  SELECT 'd' AS kind, doc_id AS id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') FROM benchmark
), shingle AS (
  SELECT DISTINCT kind, id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM cut WHERE len(w) > 0
), n AS (SELECT id, count(*) AS n_item FROM shingle WHERE kind = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, any_value(n.n_item) AS n_item, count(*) AS n_shared
FROM shingle d JOIN shingle i ON d.s = i.s AND d.kind = 'd' AND i.kind = 'i' JOIN n ON n.id = i.id
GROUP BY d.id, i.id HAVING 100 * count(*) >= 75 * any_value(n.n_item)
"""
