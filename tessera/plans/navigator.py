"""Interactive navigation of a corpus: regions, search, routes, leads and documents, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import all_tokens, clean_field, title
from tessera.operators import lexical
from tessera.operators.sampling import page


class Navigator:
    """Verbs over documents (doc_id, text, url) and membership (doc_id, parent, leaf).

    Handles are D<doc_id>, addresses C<parent> and C<parent>/S<place of the leaf in it>. Each verb
    returns a DataFrame; what was sighted is appended to sightings and folded by lead_ledger.
    """

    def __init__(self, documents: DataFrame, membership: DataFrame, scores: DataFrame | None = None):
        self.documents = documents
        leaves = membership.select("parent", "leaf").distinct()
        leaves = leaves.withColumn("k", F.row_number().over(Window.partitionBy("parent").orderBy("leaf")) - 1)
        self.leaves = leaves.withColumn("address", F.format_string("C%03d/S%02d", "parent", "k")).drop("k")
        self.membership = membership.join(self.leaves, ["parent", "leaf"])
        self.scores = scores if scores is not None else membership.select("doc_id", F.lit(0.0).alias("score"))

    def _region(self, address: str) -> DataFrame:
        if not (address.startswith("C") and address[1:4].isdigit()):
            raise ValueError(f"an address is C000 or C000/S00, not {address!r}")
        inside = self.membership.where(F.col("parent") == int(address[1:4]))
        return inside.where(F.col("address") == address) if "/" in address else inside

    def overview(self, offset: int = 0, limit: int = 20) -> DataFrame:
        """Parents by their best document's score, with sizes and numbers of leaves."""
        rows = self.membership.join(self.scores, "doc_id").groupBy("parent").agg(
            F.count("*").alias("size"), F.count_distinct("leaf").alias("leaves"), F.round(F.max("score"), 9).alias("best"))
        return page(rows.withColumn("address", F.format_string("C%03d", "parent")), [F.col("best").desc(), F.col("parent")], offset, limit, 100)

    def expand(self, address: str, offset: int = 0, limit: int = 20) -> DataFrame:
        """A parent's leaves by their best document's score; a leaf's files."""
        if "/" in address:
            return self.files(address, offset, limit)
        rows = self._region(address).join(self.scores, "doc_id").groupBy("address").agg(F.count("*").alias("size"), F.round(F.max("score"), 9).alias("best"))
        return page(rows, [F.col("best").desc(), F.col("address")], offset, limit)

    def files(self, address: str, offset: int = 0, limit: int = 20) -> DataFrame:
        rows = self._region(address).join(self.scores, "doc_id").join(self.documents, "doc_id").select(
            F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("handle"), "address", F.round("score", 9).alias("score"), title(F.col("text"), F.col("doc_id")).alias("title"))
        return page(rows, [F.col("score").desc(), F.col("handle")], offset, limit)

    def locate(self, handle: str) -> DataFrame:
        """The address of a handle."""
        found = F.concat(F.lit("D"), F.col("doc_id").cast("string")) == handle
        return self.membership.where(found).select(F.lit(handle).alias("handle"), F.format_string("C%03d", "parent").alias("parent"), "address")

    def _hits(self, query: str, mode: str, address: str | None) -> DataFrame:
        spark = self.documents.sparkSession
        terms = [r[0] for r in spark.createDataFrame([(query,)], "q string").select(F.explode(lexical.query_terms(F.col("q"), 16))).collect()]
        docs = self.documents
        if mode != "any":
            docs = docs.join(lexical.matching(docs, terms, mode), "doc_id", "left_semi")
        wanted = spark.createDataFrame([(0, terms)], "query_id int, terms array<string>")
        # the whole corpus gives the terms' weights; the region is a filter on its matches
        hits = lexical.bm25(self.documents, wanted).join(docs.select("doc_id"), "doc_id", "left_semi")
        inside = self._region(address) if address else self.membership
        return hits.join(inside, "doc_id")

    def search(self, query: str, mode: str = "any", address: str | None = None, limit: int = 20) -> DataFrame:
        """Best documents, in a region or everywhere, each with a preview."""
        best = self._hits(query, mode, address).orderBy(F.round("score", 9).desc(), "doc_id").limit(limit)
        return best.join(self.documents, "doc_id").select(
            F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("handle"), "address", F.round("score", 6).alias("score"),
            title(F.col("text"), F.col("doc_id")).alias("title"), clean_field(F.col("text"), 260).alias("preview"))

    def route(self, query: str, mode: str = "any", limit: int = 20) -> DataFrame:
        """Parents by their number of hits, with the best hit of each."""
        order = F.struct(-F.round("score", 9), F.col("doc_id"))
        rows = self._hits(query, mode, None).groupBy("parent").agg(F.count("*").alias("hits"), F.min_by("doc_id", order).alias("best"))
        return rows.orderBy(F.col("hits").desc(), "parent").limit(limit)

    def open(self, handle: str, find: str | None = None, start: int = 1, lines: int = 40, context: int = 2) -> DataFrame:
        """(line, text): lines from start, or around the first 12 lines that have find, else all its tokens, else any of them."""
        doc = self.documents.where(F.concat(F.lit("D"), F.col("doc_id").cast("string")) == handle)
        rows = doc.select(F.posexplode(F.split("text", "\n")).alias("n", "text")).select((F.col("n") + 1).alias("line"), "text")
        if not find:
            return rows.where((F.col("line") >= start) & (F.col("line") < start + lines)).orderBy("line")
        found = all_tokens(F.lit(find))
        own = all_tokens(F.col("text"))
        level = F.when(F.contains(F.lower("text"), F.lower(F.lit(find))), 1).when(F.size(F.array_except(found, own)) == 0, 2).when(F.arrays_overlap(found, own), 3)
        ranked = rows.withColumn("level", level)
        best = ranked.agg(F.min("level").alias("best"))
        hits = ranked.join(F.broadcast(best)).where("level = best").orderBy("line").limit(12)
        near = hits.select(F.explode(F.sequence(F.col("line") - context, F.col("line") + context)).alias("line")).distinct()
        return rows.join(near, "line").orderBy("line").limit(lines)


def viewport(scores: DataFrame, membership: DataFrame, parents: int = 6, anchors: int = 2) -> DataFrame:
    """(query_id, parent, place, leaf, doc_id, n): the first parents of each query by their best document, and the best documents of their best leaves."""
    held = scores.join(membership, "doc_id")
    key = F.struct(-F.round("score", 9), F.col("doc_id"))
    leaf = held.groupBy("query_id", "parent", "leaf").agg(F.min(key).alias("best"))
    parent = leaf.groupBy("query_id", "parent").agg(F.min("best").alias("best"), F.min_by("leaf", "best").alias("leaf"))
    parent = parent.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("best"))).where(F.col("place") <= parents)
    inside = held.join(parent.select("query_id", "parent", "leaf", "place"), ["query_id", "parent", "leaf"])
    order = Window.partitionBy("query_id", "parent").orderBy(F.round("score", 9).desc(), "doc_id")
    return inside.withColumn("n", F.row_number().over(order)).where(F.col("n") <= anchors).select("query_id", "parent", "place", "leaf", "doc_id", "n")
