"""What the router learns from: support tasks from graphs and regions, candidate ranks, and feature tables."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.sampling import digest

#: Excerpts that a usable document has, their least length, and the bounds of a question's length.
EXCERPTS, LEAST_EXCERPT, QUESTION = 2, 45, (45, 900)


def usable_excerpts(sentences: DataFrame, seed: str = "excerpt") -> DataFrame:
    """(doc_id, n, excerpt): the first two distinct long sentences of sentences (doc_id, sentence) by digest; documents with fewer are left out."""
    long = sentences.where(F.length("sentence") >= LEAST_EXCERPT).select("doc_id", "sentence").distinct()
    order = Window.partitionBy("doc_id").orderBy(digest(F.lit(seed), F.col("doc_id"), F.col("sentence")), "sentence")
    held = long.withColumn("n", F.row_number().over(order)).where(F.col("n") <= EXCERPTS)
    return held.withColumn("found", F.count("*").over(Window.partitionBy("doc_id"))).where(F.col("found") == EXCERPTS).select("doc_id", "n", F.col("sentence").alias("excerpt"))


def programmatic(question: Column, forbidden: Iterable[str]) -> Column:
    """A question of 45 to 900 characters that ends with a question mark and names none of the forbidden words."""
    flat = F.trim(F.regexp_replace(question, r"\s+", " "))
    return F.length(flat).between(*QUESTION) & flat.endswith("?") & ~F.regexp_like(flat, F.lit(rf"(?i)\b({'|'.join(forbidden)})\b"))


def accepted(row_flags: list[str], decoy: str, question: Column, forbidden: Iterable[str]) -> Column:
    """All flags are true, the decoy isn't needed, and the question is programmatic; nulls don't accept."""
    ok = programmatic(question, forbidden) & ~F.coalesce(F.col(decoy), F.lit(False))
    for name in row_flags:
        ok = ok & F.coalesce(F.col(name), F.lit(False))
    return F.coalesce(ok, F.lit(False))


def task_edges(edges: DataFrame, places: DataFrame) -> DataFrame:
    """(src, dst, split, weight): edges (src, dst, weight) with both ends among places (doc_id, leaf, split), inside one split and across leaves."""
    a = places.select(F.col("doc_id").alias("src"), F.col("leaf").alias("leaf_a"), F.col("split").alias("split"))
    b = places.select(F.col("doc_id").alias("dst"), F.col("leaf").alias("leaf_b"), F.col("split").alias("split"))
    return edges.join(a, "src").join(b, ["dst", "split"]).where("leaf_a <> leaf_b").select("src", "dst", "split", "weight")


def support_tasks(places: DataFrame, edges: DataFrame, chains: DataFrame, seed: str = "task") -> DataFrame:
    """(task_id, kind, split, support): single documents, pairs along edges, and triples along chains (left, middle, right, split), as one table."""
    single = places.select(F.lit("single").alias("kind"), "split", F.array("doc_id").alias("support"))
    pair = edges.select(F.lit("pair").alias("kind"), "split", F.array("src", "dst").alias("support"))
    triple = chains.select(F.lit("triple").alias("kind"), "split", F.array("left", "middle", "right").alias("support"))
    tasks = single.unionByName(pair).unionByName(triple)
    name = F.substring(digest(F.lit(seed), F.col("kind"), F.array_join(F.transform("support", lambda x: x.cast("string")), "-")), 1, 16)
    return tasks.select(name.alias("task_id"), "kind", "split", "support")


def split_leaks(places: DataFrame) -> DataFrame:
    """Parents whose documents are in more than one split: a table that must be empty."""
    return places.groupBy("parent").agg(F.count_distinct("split").alias("splits")).where("splits > 1")


def decoys(tasks: DataFrame, seed: str = "decoy") -> DataFrame:
    """(task_id, decoy_id): for each task the next one of its split, in a circle from a digest's offset, that shares no document; null if all share one.

    tasks: task_id, split, support. A task tries the positions of its split one after the other, so
    no pairs of all tasks are made; it stops at the first that fits.
    """
    order = Window.partitionBy("split").orderBy("task_id")
    placed = tasks.withColumn("at", F.row_number().over(order) - 1)
    sizes = tasks.groupBy("split").agg(F.count("*").alias("n"))
    start = F.expr("pmod(cast(conv(substring(d, 1, 12), 16, 10) as bigint), n)")
    left = placed.join(sizes, "split").withColumn("d", digest(F.lit(seed), F.col("task_id"))).withColumn("start", start).drop("d")
    index = placed.select("split", F.col("at").alias("target"), F.col("task_id").alias("decoy_id"), F.col("support").alias("other"))
    done, step = None, 0
    while True:
        tried = left.withColumn("target", (F.col("start") + step) % F.col("n")).join(index, ["split", "target"])
        tried = tried.withColumn("fits", ~F.arrays_overlap("support", "other"))
        hit = tried.where("fits").select("task_id", "decoy_id")
        done = hit if done is None else done.unionByName(hit)
        step += 1
        left = tried.where("not fits").select("split", "task_id", "support", "at", "n", "start").where(F.col("n") > step)
        if left.isEmpty():
            return tasks.select("task_id").join(done, "task_id", "left")


def calibrated_ranks(similarities: DataFrame, calibration: DataFrame, documents: int) -> DataFrame:
    """(query_id, doc_id, rank): ranks in a corpus of so many documents, estimated from a sample's similarities.

    similarities and calibration: query_id, doc_id, sim. rank = 1 + the sample's rows above, scaled
    to the corpus and rounded half to even, within 1 and documents. Rows and sample are merged by
    one ordered window for each query; equal similarities don't count as above.
    """
    both = similarities.select("query_id", "doc_id", "sim", F.lit(0).alias("own")).unionByName(calibration.select("query_id", F.lit(None).cast(similarities.schema["doc_id"].dataType).alias("doc_id"), "sim", F.lit(1).alias("own")))
    above = Window.partitionBy("query_id").orderBy(F.col("sim").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy("query_id", "sim")
    counted = both.withColumn("tail", F.sum("own").over(above) - F.sum("own").over(same)).withColumn("size", F.sum("own").over(Window.partitionBy("query_id")))
    rank = 1 + F.rint(F.col("tail") * (documents - 1) / F.greatest(F.col("size"), F.lit(1)))
    return counted.where("own = 0").select("query_id", "doc_id", F.least(F.greatest(rank, F.lit(1.0)), F.lit(float(documents))).cast("long").alias("rank"))


def lexical_channel(candidates: DataFrame, ranks: DataFrame, documents: int, constant: int = 60) -> DataFrame:
    """candidates with lexical_rank and lexical_rrf; those without a match rank last and score 0."""
    found = candidates.join(ranks.select("query_id", "doc_id", F.col("rank").alias("_r")), ["query_id", "doc_id"], "left")
    return found.withColumn("lexical_rank", F.coalesce("_r", F.lit(documents))).withColumn("lexical_rrf", F.coalesce(1 / (constant + F.col("_r")), F.lit(0.0))).drop("_r")


def region_negatives(positives: DataFrame, places: DataFrame, most: int = 16, seed: str = "negative") -> DataFrame:
    """(query_id, doc_id, pool, n): for each positive up to most other documents of its leaf, and as many of its parent's other leaves, by digest."""
    # the digests know no query, so each source's documents are ranked once, however many queries it is a positive of
    sources = positives.select("doc_id").distinct()
    at = sources.join(places.select("doc_id", "leaf", "parent"), "doc_id").select(F.col("doc_id").alias("source"), "leaf", "parent")
    other = places.select("doc_id", F.col("leaf").alias("other_leaf"), F.col("parent").alias("other_parent"))
    same = at.join(other, F.col("leaf") == F.col("other_leaf")).where("doc_id <> source").withColumn("pool", F.lit("same_leaf"))
    near = at.join(other, F.col("parent") == F.col("other_parent")).where("leaf <> other_leaf").withColumn("pool", F.lit("same_parent_other_leaf"))
    order = Window.partitionBy("source", "pool").orderBy(digest(F.lit(seed), F.col("source"), F.col("doc_id")), "doc_id")
    both = same.unionByName(near).select("source", "doc_id", "pool").withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    both = both.join(positives.select("query_id", F.col("doc_id").alias("source")).distinct(), "source")
    return both.groupBy("query_id", "doc_id", "pool").agg(F.min("n").alias("n"))


def sample_weights(positives: DataFrame, train: DataFrame) -> DataFrame:
    """(query_id, weight): the mean over a query's positives of 1 / sqrt(their frequency), over its mean for the queries in train."""
    counted = positives.withColumn("f", F.count("*").over(Window.partitionBy("doc_id")))
    raw = counted.groupBy("query_id").agg(F.avg(1 / F.sqrt("f")).alias("raw"))
    mean = raw.join(train.select("query_id").distinct(), "query_id").agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("query_id", (F.col("raw") / F.col("mean")).alias("weight"))  # one row


def rare_queries(positives: DataFrame, places: DataFrame) -> DataFrame:
    """(query_id, rare): whether a positive lies in a leaf no larger than the 25th percentile of leaf sizes."""
    sizes = places.groupBy("leaf").agg(F.count("*").alias("size"))
    bound = sizes.agg(F.expr("percentile(size, 0.25)").alias("bound"))
    held = positives.join(places.select("doc_id", "leaf"), "doc_id").join(sizes, "leaf").crossJoin(F.broadcast(bound))  # one row
    return held.groupBy("query_id").agg(F.bool_or(F.col("size") <= F.col("bound")).alias("rare"))


def pool_union(calibration: DataFrame, lexical: DataFrame) -> DataFrame:
    """(query_id, doc_id, sim, origin): calibration rows, and the lexical rows that aren't among them."""
    novel = lexical.join(calibration.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    return calibration.select("query_id", "doc_id", "sim", F.lit("calibration").alias("origin")).unionByName(novel.select("query_id", "doc_id", "sim", F.lit("lexical").alias("origin")))


def view_statistics(calibration: DataFrame, lexical: DataFrame, places: DataFrame, top: int = 64) -> DataFrame:
    """(query_id, std, q95, q99, top8, sharpness, parent_share, leaf_share, lexical_mean) for one view.

    std and quantiles are of the calibration similarities, the rest of the top rows of their union
    with the lexical ones; shares are of the 32 best; lexical_mean is the median without matches.
    """
    base = calibration.groupBy("query_id").agg(F.stddev_pop("sim").alias("std"), F.expr("percentile(sim, array(0.5, 0.95, 0.99))").alias("q"))
    order = Window.partitionBy("query_id").orderBy(F.col("sim").desc(), "doc_id")
    best = pool_union(calibration, lexical).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).join(places.select("doc_id", "leaf", "parent"), "doc_id")
    top8 = best.where("rank <= 8").groupBy("query_id").agg(F.avg("sim").alias("top8"))

    def share(column: str) -> DataFrame:
        sizes = best.where("rank <= 32").groupBy("query_id", column).agg(F.count("*").alias("n"))
        return sizes.groupBy("query_id").agg((F.max("n") / F.sum("n")).alias(f"{column}_share"))

    lex = lexical.groupBy("query_id").agg(F.avg("sim").alias("mean"))
    out = base.join(top8, "query_id").join(share("parent"), "query_id").join(share("leaf"), "query_id").join(lex, "query_id", "left")
    sharp = (F.col("top8") - F.col("q")[1]) / F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(1e-5))
    return out.select(
        "query_id", "std", F.col("q")[1].alias("q95"), F.col("q")[2].alias("q99"), "top8", F.least(F.greatest(sharp, F.lit(0.0)), F.lit(20.0)).alias("sharpness"),
        "parent_share", "leaf_share", F.coalesce("mean", F.col("q")[0]).alias("lexical_mean"),
    )


def assemble(vectors: DataFrame, statistics: DataFrame, form: DataFrame, views: Iterable[str]) -> DataFrame:
    """(query_id, features): each view's vector, each view's statistics, then the question's form, in this order.

    vectors and statistics: query_id, view, values; form: query_id, values. A query that lacks a part raises.
    """
    names = list(views)
    part = lambda df, v, out: df.where(F.col("view") == v).select("query_id", F.col("values").alias(out))
    out = form.select("query_id", F.col("values").alias("form"))
    for k, v in enumerate(names):
        out = out.join(part(vectors, v, f"v{k}"), "query_id", "left").join(part(statistics, v, f"s{k}"), "query_id", "left")
    whole = F.concat(*(F.col(f"v{k}") for k in range(len(names))), *(F.col(f"s{k}") for k in range(len(names))), F.col("form"))
    return out.select("query_id", F.when(whole.isNull(), F.raise_error(F.lit("a query lacks a part of its features")).cast("array<double>")).otherwise(whole).alias("features"))


def share_usage(total: Column, parts: Column, index: Column) -> Column:
    """The index-th of parts whole shares of total; the first ones have what is left over."""
    return F.floor(total / parts).cast("long") + (index < total % parts).cast("long")


def calibration_grid(score: Callable[..., tuple[float, float, bool]], grids: dict[str, Iterable[float]]) -> dict[str, float]:
    """The settings of a small grid with the largest (score, tie) among the eligible ones, among all if none is; score gives (score, tie, eligible)."""
    trials = [(dict(zip(grids, values)), *score(*values)) for values in itertools.product(*grids.values())]
    eligible = [t for t in trials if t[3]] or trials
    return max(eligible, key=lambda t: (t[1], t[2]))[0]


def permutation(n: int, seed: int) -> np.ndarray:
    """A seeded order of 0 to n - 1."""
    return np.random.default_rng(seed).permutation(n)
