"""Line dedup by content-defined chunks of lines (operator 4), in DataFrame functions only.

A rolling hash over the hashes of two neighbouring lines decides where a chunk ends, so chunks of
equal passages agree even if lines before them were added or removed. A chunk with several lines
that are not blank, whose bytes occur elsewhere too, stays only at its first place: the least
doc_id, then the least chunk number.

Hashes only narrow the search. Two filters of hashed keys, sized by their number, are broadcast:
one tells which chunks may be repeated, the other which documents lose any. So texts that have
nothing to lose never move between executors. Chunks with very many copies are joined as hot groups.

Chunks are cut where the hash says, so the ends of a passage, and short passages, may stay: that
is dedup, which the oracle defines. deduped, the pipeline's stage, removes these chunks, and then
compares all pairs of neighbouring lines of the whole texts, which overlap and so grow to whole
passages of two lines or more.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.joins import by_size, marked
from tessera.llm.workspace import Workspace

#: A chunk ends after a line if the rolling hash is a multiple of this; it has so many lines on average.
MEAN_LINES = 3


def chunks(docs: DataFrame) -> DataFrame:
    """docs with lines, and chunks: an array of (number, first, last, text) with line numbers from 1.

    The rolling hash of line i is 31 * h(i - 1) + h(i), where h is the number of the first seven
    hexadecimal digits of a line's md5, and h(0) is 0.
    """
    docs = docs.withColumn("lines", F.split(F.col("text"), "\n"))
    docs = docs.withColumn("hashes", F.transform("lines", lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 7), 16, 10).cast("long")))
    ends = F.filter(
        F.sequence(F.lit(1), F.size("lines")),
        lambda i: (i == F.size("lines")) | ((F.when(i == 1, F.lit(0)).otherwise(F.try_element_at("hashes", F.greatest(i - 1, F.lit(1)))) * 31 + F.element_at("hashes", i)) % MEAN_LINES == 0),
    )
    docs = docs.withColumn("ends", F.when(F.col("text").isNotNull(), ends))
    begins = F.concat(F.array(F.lit(1)), F.transform("ends", lambda e: e + 1))
    docs = docs.withColumn("begins", begins)
    parts = F.transform(
        F.arrays_zip(F.col("begins"), F.col("ends")),
        lambda z: F.struct(z["begins"].alias("first"), z["ends"].alias("last")),
    )
    docs = docs.withColumn("spans", F.filter(parts, lambda z: z["last"].isNotNull()))
    text = F.transform(
        "spans",
        lambda z, k: F.struct(
            k.alias("number"), z["first"].alias("first"), z["last"].alias("last"),
            F.array_join(F.slice("lines", z["first"], z["last"] - z["first"] + 1), "\n").alias("text"),
        ),
    )
    return docs.withColumn("chunks", text).drop("hashes", "ends", "begins", "spans")


def pairs(docs: DataFrame) -> DataFrame:
    """docs with lines, and chunks: every two neighbouring lines that are not blank, with the blank ones between them, in the same shape."""
    docs = docs.withColumn("lines", F.split(F.col("text"), "\n"))
    docs = docs.withColumn("filled", F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: F.regexp_like(F.element_at("lines", i), F.lit(r"\S"))))
    spans = F.transform("filled", lambda i, k: F.struct(i.alias("first"), F.get("filled", k + 1).alias("last")))
    docs = docs.withColumn("spans", F.when(F.col("text").isNotNull(), F.filter(spans, lambda z: z["last"].isNotNull())))
    text = F.transform(
        "spans",
        lambda z: F.struct(
            z["first"].alias("number"), z["first"].alias("first"), z["last"].alias("last"),
            F.array_join(F.slice("lines", z["first"], z["last"] - z["first"] + 1), "\n").alias("text"),
        ),
    )
    return docs.withColumn("chunks", text).drop("filled", "spans")


def _several(text: Column) -> Column:
    """There are at least two lines that are not blank."""
    return F.regexp_count(text, F.lit(r"(?m)^.*\S")) >= 2


def removals(docs: DataFrame, space: Workspace, cut: Callable[[DataFrame], DataFrame] = chunks) -> DataFrame:
    """(doc_id, number, hash) of every chunk, or pair of lines, that is not at its first place; SHA-256 stands for its bytes."""
    # explode_outer: the filter that Spark infers for explode would compute the chunks anew, in nested loops
    parts = cut(docs.select("doc_id", "text")).select("doc_id", F.explode_outer("chunks").alias("c")).where(_several(F.col("c.text")))
    hashed = parts.select(F.xxhash64("c.text").alias("hash"))
    repeated = space.save(hashed.groupBy("hash").agg(F.count("*").alias("size")).where("size > 1"), "repeated")
    rows = parts.select("doc_id", "c.number", "c.text", F.xxhash64("c.text").alias("hash"))
    rows = marked(rows, F.col("hash"), repeated.select(F.xxhash64("hash").alias("h"))).where("passed").drop("passed")
    rows = rows.select("doc_id", "number", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), "hash")
    rows = space.save(rows, "maybe")  # the texts are cut once, whichever way they are joined
    rows = space.save(by_size(rows, repeated, "hash"), "candidates")
    first = rows.groupBy("digest").agg(F.min(F.struct("doc_id", "number")).alias("at"), F.count("*").alias("size"))
    joined = by_size(rows, space.save(first, "first"), "digest")
    return joined.where("not (doc_id <=> at.doc_id and number = at.number)").select("doc_id", "number", "hash")


def dedup(docs: DataFrame, *more: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """docs without repeated chunks, all columns, and n_lines and n_removed, their numbers of lines before and removed.

    more are other ways to cut the whole texts, as pairs is, whose repeated parts go as well.

    Every row of docs stays, with an empty text if nothing is left of it. A null text stays null
    with 0 lines; an empty one is one blank line. Rows of one doc_id with equal texts are one
    document, and so are rows without doc_id. An empty table gives an empty result. Columns of
    docs that have one of the added names are replaced.
    """
    space = Workspace(docs.sparkSession, "lines")
    cuts = (chunks, *more)
    gone = reduce(DataFrame.unionByName, (removals(docs, space, cut).withColumn("way", F.lit(way)) for way, cut in enumerate(cuts)))
    gone = space.save(gone.groupBy("doc_id").agg(F.collect_set(F.struct("way", "number", "hash")).alias("gone")), "gone")
    plain = docs.drop("n_lines", "n_removed")
    names = plain.columns
    held = plain.toDF(*(f"c{i}" for i in range(len(names)))).select(
        F.struct(F.lit(0).alias("none"), *(f"c{i}" for i in range(len(names)) if names[i] != "text")).alias("row"),
        F.col(f"c{names.index('doc_id')}").alias("doc_id"), F.col(f"c{names.index('text')}").alias("text"),
    )
    held = marked(held, F.col("doc_id"), gone.select(F.xxhash64("doc_id").alias("h")))
    # merge: the removals grow with the corpus, so no size is right for a broadcast
    touched = held.where("passed").drop("passed").join(gone.withColumnRenamed("doc_id", "of").hint("merge"), F.col("doc_id").eqNullSafe(F.col("of")), "left")
    for way, cut in enumerate(cuts):
        touched = cut(touched).withColumn("way", F.lit(way))
        lost = F.filter("chunks", lambda c: F.array_contains("gone", F.struct(F.col("way"), c["number"].alias("number"), F.xxhash64(c["text"]).alias("hash"))))
        touched = touched.withColumn(f"lost{way}", F.flatten(F.transform(lost, lambda c: F.sequence(c["first"], c["last"])))).drop("chunks")
    lost = F.concat(*(F.col(f"lost{way}") for way in range(len(cuts))))  # the parts overlap
    every = F.sequence(F.lit(1), F.size("lines"))
    touched = touched.withColumn("left", F.when(F.col("gone").isNull(), every).otherwise(F.array_except(every, lost))).select(
        "row", F.when(F.col("text").isNotNull(), F.array_join(F.transform("left", lambda i: F.element_at("lines", i)), "\n")).alias("text"),
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size("lines") - F.size("left")).cast("long").alias("n_removed"),
    )
    whole = held.where("not passed").select("row", "text", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"))
    whole = whole.withColumn("n_lines", F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(F.col("n_lines")))
    touched = touched.withColumn("n_lines", F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(F.col("n_lines")))
    both = touched.unionByName(whole)
    columns = [F.col("text") if c == "text" else F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)]
    return both.select(*columns, "n_lines", "n_removed")


def deduped(docs: DataFrame) -> DataFrame:
    """docs without the lines of passages of two lines or more that stand elsewhere before, in docs' own columns.

    n_chars, if there, is the text's new length.
    """
    found = dedup(docs, pairs)  # the chunks go first; pairs, compared exactly, find what their cuts miss
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        found = found.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents
), numbered AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM lines
), hashed AS (
  SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS h FROM numbered
), rolled AS (
  SELECT *, (coalesce(lag(h) OVER w, 0) * 31 + h) % 3 = 0 AS cut FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), placed AS (
  SELECT *, coalesce(sum(cut::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS number FROM rolled
), chunk AS (
  SELECT doc_id, number, string_agg(line, chr(10) ORDER BY i) AS t, count(*) AS n,
         count(*) FILTER (regexp_matches(line, '\S')) AS filled
  FROM placed GROUP BY doc_id, number
), judged AS (
  SELECT *, filled >= 2 AND row_number() OVER (PARTITION BY t ORDER BY doc_id, number) > 1 AS gone FROM chunk
)
SELECT d.doc_id, coalesce(string_agg(j.t, chr(10) ORDER BY j.number) FILTER (NOT j.gone), '') AS text,
       sum(j.n)::BIGINT AS n_lines, coalesce(sum(j.n) FILTER (j.gone), 0)::BIGINT AS n_removed
FROM documents d JOIN judged j ON d.doc_id = j.doc_id GROUP BY d.doc_id
"""
