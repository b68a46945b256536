"""Signatures of documents and queries for four views, and the viewport that a ranking opens on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X

# Fixed values that results depend on.
DOCUMENT_INSTRUCTIONS = {
    "topic": "Represent this FILE by its overall subjects and independent content areas.",
    "identity": "Represent this FILE by named people, works, organizations, aliases, and identity-bearing titles.",
    "episode": "Represent this FILE by time periods, places, events, stages, and chronology.",
    "relation": "Represent this FILE by relations, roles, causes, comparisons, quantities, and distinguishing attributes.",
}
QUERY_INSTRUCTIONS = {
    "topic": "Retrieve files by the question's overall subject and content areas.",
    "identity": "Retrieve files by named entities, aliases, works, organizations, and requested identity.",
    "episode": "Retrieve files by time period, place, event, stage, and chronology.",
    "relation": "Retrieve files by relations, roles, causes, comparisons, quantities, and exact distinguishing attributes.",
}
DIVERSE = {"topic": 8, "identity": 12, "episode": 12, "relation": 12}
UNIFORM = {"topic": 8, "identity": 3, "episode": 3, "relation": 3}
BUDGET = {"topic": 6144, "identity": 4096, "episode": 4096, "relation": 4096}
CEILING, LEAST_REST = 0.68, 80


def uniform(values: Column, limit: int) -> Column:
    """limit values at even places from the first to the last; all of them if there are no more."""
    last = F.size(values) - 1
    picked = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda i: F.get(values, F.floor(i * last / F.lit(max(1, limit - 1))).cast("int")))
    return F.when(F.size(values) <= limit, values).otherwise(picked)


def diverse(ranked: Column, limit: int) -> Column:
    """The first limit sentences of ranked (an array of structs of sentence and tokens) whose tokens overlap less than 0.68 with each one kept before.

    The fold keeps at most limit sentences, so its cost is in proportion to the text's length.
    """
    kind = "array<struct<sentence:string,tokens:array<string>>>"
    similar = lambda a, b: F.size(F.array_intersect(a, b)) >= CEILING * F.size(F.array_union(a, b))

    def step(kept: Column, s: Column) -> Column:
        blocked = (F.size(s["tokens"]) > 0) & F.exists(kept, lambda k: similar(s["tokens"], k["tokens"]))
        return F.when((F.size(kept) >= limit) | blocked, kept).otherwise(F.array_append(kept, s))

    return F.transform(F.aggregate(ranked, F.array().cast(kind), step), lambda k: k["sentence"])


def render(head: Column, excerpts: Column, budget: int) -> Column:
    """head and as many excerpts as fit, one to a line; of the first that doesn't fit, a part if at least 80 characters are left."""
    start = F.struct(head.alias("text"), F.lit(False).alias("full"))

    def step(acc: Column, e: Column) -> Column:
        rest = budget - F.length(acc["text"]) - 3
        part = F.when(rest >= LEAST_REST, F.concat(acc["text"], F.lit("- "), F.substring(e, F.lit(1), rest))).otherwise(acc["text"])
        whole = F.concat(acc["text"], F.lit("- "), e, F.lit("\n"))
        over = F.length(whole) > budget
        return F.when(acc["full"], acc).otherwise(F.struct(F.when(over, part).otherwise(whole).alias("text"), over.alias("full")))

    text = F.aggregate(excerpts, start, step, lambda acc: acc["text"])
    return F.substring(F.regexp_replace(text, r"\A\s+|\s+\z", ""), 1, budget)


def document_signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, view, signature) of docs (doc_id, text, and url if there): a header and the excerpts that a view is told by.

    Excerpts are a view's best sentences that differ, then some at even places. A null text is empty;
    its signature is its header with the title as the only excerpt.
    """
    url = F.col("url") if "url" in docs.columns else F.lit(None).cast("string")
    held = docs.select("doc_id", url.alias("url"), X.clean_text(F.coalesce("text", F.lit(""))).alias("text"))
    held = held.select("doc_id", X.domain(F.col("url")).alias("domain"), X.title(F.col("text"), F.col("doc_id")).alias("title"), X.usable_sentences(F.col("text")).alias("s"))
    held = held.withColumn("s", F.when(F.size("s") > 0, F.col("s")).otherwise(F.array("title")))
    each = held.select("doc_id", F.posexplode("s").alias("position", "sentence"))
    each = each.select("doc_id", "position", "sentence", X.tokens(F.col("sentence")).alias("tokens"), *(v.cast("double").alias(k) for k, v in X.view_scores(F.col("sentence")).items()))
    # a document's sentences are its own text, so gathering them again is bounded by it
    ranked = each.groupBy("doc_id").agg(*(
        F.transform(F.sort_array(F.collect_list(F.struct((-F.col(v)).alias("score"), "position", "sentence", "tokens"))), lambda x: F.struct(x["sentence"].alias("sentence"), x["tokens"].alias("tokens"))).alias(v)
        for v in X.VIEWS
    ))
    head = lambda v: F.concat(
        F.lit(f"{DOCUMENT_INSTRUCTIONS[v]}\nView: {v}\nFile handle: D"), F.col("doc_id").cast("string"), F.lit("\nFilename/title: "), F.col("title"),
        F.lit("\nSource domain: "), F.col("domain"), F.lit("\nGrounded source excerpts:\n"))
    joined = held.join(ranked, "doc_id")
    rows = F.array(*(F.struct(F.lit(v).alias("view"), render(head(v), F.concat(diverse(F.col(v), DIVERSE[v]), uniform(F.col("s"), UNIFORM[v])), BUDGET[v]).alias("signature")) for v in X.VIEWS))
    return joined.select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.*")


def query_signatures(query: Column) -> dict[str, Column]:
    """A query's text for each view."""
    flat = X.clean_field(query, 8000)
    return {v: F.concat(F.lit(f"Instruct: {t}\nQuery: "), flat) for v, t in QUERY_INSTRUCTIONS.items()}


def viewport(scores: DataFrame, places: DataFrame, parents: int = 10, anchors: int = 3) -> DataFrame:
    """(query_id, parent, leaf, doc_id, score, route_rank, anchor_rank, lead_rank): where a ranking opens.

    scores: query_id, doc_id, score; places: doc_id, leaf, parent. A leaf stands for its best
    document, a parent for its best leaf; the first parents and their first leaves are shown.
    """
    held = scores.join(places.select("doc_id", "leaf", "parent"), "doc_id")
    best = held.groupBy("query_id", "parent", "leaf").agg(F.max_by(F.struct("score", "doc_id"), F.struct("score", (-F.col("doc_id")).alias("d"))).alias("b"))
    best = best.select("query_id", "parent", "leaf", "b.score", "b.doc_id")
    inside = best.withColumn("anchor_rank", F.row_number().over(Window.partitionBy("query_id", "parent").orderBy(F.col("score").desc(), "leaf")))
    route = best.groupBy("query_id", "parent").agg(F.max("score").alias("top"))
    route = route.withColumn("route_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("top").desc(), "parent"))).where(F.col("route_rank") <= parents)
    out = inside.where(F.col("anchor_rank") <= anchors).join(route.drop("top"), ["query_id", "parent"])
    return out.withColumn("lead_rank", (F.col("route_rank") - 1) * anchors + F.col("anchor_rank")).select("query_id", "parent", "leaf", "doc_id", "score", "route_rank", "anchor_rank", "lead_rank")


def label(given: Column, machine: Column, titles: Column, default: Column) -> Column:
    """The first of a given label, a machine's one, and up to three titles that isn't blank, else default."""
    usable = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(usable(given), usable(machine), usable(F.array_join(F.slice(titles, 1, 3), " | ")), default)


def address(parent: Column, leaf: Column | None = None) -> Column:
    return F.format_string("C%03d", parent) if leaf is None else F.format_string("C%03d/S%02d", parent, leaf)


def record_line(*fields: Column) -> Column:
    """One line of tab-separated fields; white space inside a field is collapsed."""
    return F.concat_ws("\t", *(X.clean_field(f.cast("string"), 4000) for f in fields))


def palette(labels: DataFrame, most: int = 5) -> DataFrame:
    """(parent, palette): the labels of a parent's first leaves, in their order; labels: parent, leaf, label."""
    order = Window.partitionBy("parent").orderBy("leaf")
    some = labels.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    return some.groupBy("parent").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "label"))), lambda x: x["label"]).alias("palette"))

