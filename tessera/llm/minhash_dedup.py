"""Near-duplicate documents by HyperMinHash (operator 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.joins import marked
from tessera.llm.neardup import near_duplicates
from tessera.llm.workspace import Workspace


def dedup(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked if their sets of 5-word shingles have a Jaccard similarity of at least
    percent / 100. component_id is the least doc_id that links reach, kept is doc_id = component_id.

    Null and wordless texts have an empty set and are linked with nothing. Repeated rows of one
    doc_id each get a row; equal texts are one group whatever their ids. A null doc_id is never a
    group's least id unless all its ids are null. Other columns of docs are ignored, whatever
    their names; an empty table gives an empty result.
    """
    space = Workspace(docs.sparkSession, "minhash")
    rows = near_duplicates(docs.select(F.col("doc_id").alias("key"), "text"), space, percent)
    component = F.coalesce("cluster", "key")
    return rows.select(F.col("key").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("key").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of docs, with one row of each near-duplicate group; all their columns.

    Rows are told apart by doc_id and text: the group's row with the least doc_id stays, one with a
    null doc_id only if there is no other, and of several texts of that doc_id the one whose hash is
    least. Of rows that are equal in both, one stays. Null and wordless texts all stay.
    """
    space = Workspace(docs.sparkSession, "minhash")
    names = docs.columns
    held = docs.toDF(*(f"c{i}" for i in range(len(names))))
    doc_id, text = F.col(f"c{names.index('doc_id')}"), F.col(f"c{names.index('text')}")
    key = F.struct(doc_id.isNull().alias("unknown"), doc_id.alias("doc_id"), F.xxhash64(text).alias("print"))
    rows = near_duplicates(held.select(key.alias("key"), text.alias("text")), space, percent).where("cluster is not null")
    grouped = rows.groupBy("key").agg(F.first(F.col("key") == F.col("cluster")).alias("kept"), F.count("*").alias("copies"))
    grouped = space.save(grouped, "grouped")
    held = marked(held.withColumn("key", key), F.col("key"), grouped.select(F.xxhash64("key").alias("h")))
    some = held.where("passed").join(grouped.withColumnRenamed("key", "of"), F.col("key").eqNullSafe(F.col("of")), "left")
    single = some.where("kept is null or kept and copies = 1")
    one = some.where("kept and copies > 1").dropDuplicates(["key"])
    columns = [f"c{i}" for i in range(len(names))]
    return held.where("not passed").select(columns).unionByName(single.select(columns)).unionByName(one.select(columns)).toDF(*names)
