"""Queries over runs, events, vectors and tables, with their oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import numbers as M
from tessera.functions.text import tokens
from tessera.operators import chains, evaluation, lexical, sampling, vectors
from tessera.plans.text_queries import _bm25, _index, _ordered, _t
from tessera.streaming import ledger


def _rows(spark, d):
    """Endpoint rows from labelled documents: quality is correctness, length the number of turns."""
    docs, labels = _t(spark, d, "documents"), _t(spark, d, "labels")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("query_id"), "source", "lang", (F.col("quality") == 1).alias("is_correct"), (F.col("toxic") == 0).alias("terminal_valid"),
        (F.col("n_chars") % 40).alias("turn_count"), (F.col("n_chars") / 1000.0).alias("agent_cost"), F.lit(0.01).alias("judge_cost"))


_R = "r AS (SELECT d.doc_id AS query_id, source, lang, quality = 1 AS is_correct, toxic = 0 AS terminal_valid, n_chars % 40 AS turn_count, n_chars / 1000.0::DOUBLE AS agent_cost, 0.01::DOUBLE AS judge_cost FROM documents d JOIN labels l USING (doc_id))"
_W = "(correct / total + 3.8414588206941254 / (2 * total) {} 1.959963984540054 * sqrt(correct / total * (1 - correct / total) / total + 3.8414588206941254 / (4 * total * total))) / (1 + 3.8414588206941254 / total)"
_SUM = "count(*) AS total, count(*) FILTER (is_correct) AS correct, sum(agent_cost) AS agent_cost, sum(judge_cost) AS judge_cost, sum(turn_count)::BIGINT AS turns, count(*) FILTER (NOT terminal_valid) AS terminal_invalid"


def _round(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def endpoint_summary(spark, d):
    return _round(evaluation.endpoint_summary(_rows(spark, d)), "agent_cost", "judge_cost", "accuracy", "lower", "upper")


def wilson_by_source(spark, d):
    return _round(evaluation.endpoint_summary(_rows(spark, d), ["source"]).select("source", "total", "correct", "lower", "upper"), "lower", "upper")


def passive_checkpoints(spark, d):
    return _round(evaluation.checkpoints(_rows(spark, d), [5, 15, 30], "turn_count"), "accuracy")


def cost_checkpoints(spark, d):
    return _round(evaluation.checkpoints(_rows(spark, d), [0.5, 1.5, 4.0], "agent_cost"), "accuracy")


def paired_outcomes_whole(spark, d):
    """Customers in credit against customers with an open order; those without orders are unpaired."""
    left = _t(spark, d, "customer").select(F.col("c_custkey").alias("query_id"), (F.col("c_acctbal") > 0).alias("is_correct"))
    right = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("query_id")).agg(F.bool_or(F.col("o_orderstatus") == "O").alias("is_correct"))
    return evaluation.paired_outcomes(left, right)


def paired_outcomes(spark, d):
    rows = _rows(spark, d)
    return evaluation.paired_outcomes(rows.select("query_id", "is_correct"), rows.where("query_id % 7 <> 0").select("query_id", F.col("terminal_valid").alias("is_correct")))


def breakdown(spark, d):
    """Means by language, by source, and over all, in one pass."""
    rows = _rows(spark, d).withColumn("value", F.when(F.col("is_correct"), F.col("turn_count") * 2.5).otherwise(0.0))
    out = rows.groupingSets([["lang"], ["source"], []], "lang", "source").agg(F.count("*").alias("n"), F.round(F.avg("value"), 2).alias("overall"), F.round(100 * F.avg(F.col("is_correct").cast("double")), 2).alias("correctness"))
    return out


def graded_retrieval(spark, d):
    docs = _t(spark, d, "documents")
    ranks = lexical.ranked(_bm25(spark, d), 100).select("query_id", "doc_id", "rank")
    b = _t(spark, d, "benchmark")
    grades = lexical.containing(docs, b.select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))).select("query_id", "doc_id", F.lit(1.0).alias("grade"))
    return _round(evaluation.graded_retrieval(ranks, grades), "ndcg_at_10", "recall_at_10", "recall_at_100")


def running_cost(spark, d):
    out = evaluation.running_cost(_t(spark, d, "events"), "user_id", ["ts", "event_id"], "value")
    return _round(out.select("event_id", "user_id", "turn", "running"), "running")


def budget_trigger(spark, d):
    turns = evaluation.running_cost(_t(spark, d, "events"), "user_id", ["ts", "event_id"], "value")
    return evaluation.budget_trigger(turns, "user_id", 2000.0, 60)


def _sightings(spark, d):
    e = _t(spark, d, "events")
    return e.select(F.col("user_id").alias("query_id"), F.concat(F.lit("D"), F.col("event_id") % 17).alias("handle"), F.col("event_id").alias("sequence"), (F.col("event_id") % 50).alias("rank"), F.col("event_type").alias("source"),
                    F.when(F.col("event_id") % 11 == 0, "opened").when(F.col("event_id") % 7 == 0, "dismissed").otherwise("seen").alias("action"))


def lead_ledger(spark, d):
    return evaluation.lead_ledger(_sightings(spark, d)).withColumn("sources", F.array_join("sources", ","))


def lead_page(spark, d):
    leads = evaluation.lead_ledger(_sightings(spark, d)).drop("sources")
    order = [(F.col("status") != "unresolved"), F.col("best_rank"), F.col("last_sequence").desc(), F.col("handle"), F.col("query_id")]
    return sampling.page(leads, order, 10, 20)


def evidence_funnel(spark, d):
    docs = _t(spark, d, "documents")
    rows = docs.select(F.col("doc_id").alias("query_id"), F.col("lang").alias("stage"), (1 + F.col("doc_id") % 4).alias("n_slots"), F.least(F.col("n_chars") % 5, 1 + F.col("doc_id") % 4).alias("n_seen"))
    return _round(evaluation.evidence_funnel(rows), "any_blind", "mean_blind", "all_blind", "micro_recall")


def json_props(spark, d):
    e = _t(spark, d, "events")
    k = F.coalesce(F.get_json_object("props", "$.k"), F.get_json_object("props", "$.key"), F.lit("0")).cast("long")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"))


def usage_costs(spark, d):
    e = _t(spark, d, "events")
    cost = M.usage_cost(F.col("event_id") % 1000, F.col("event_id") % 77, F.col("user_id"), (1.0, 0.2, 3.2))
    return e.select("event_id", F.round(cost, 9).alias("cost"))


def conversation_turns(spark, d):
    c = _t(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    return c.select("conv_id", "turn", F.lag("role").over(w).alias("before"), F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("chars"))


def last_user_turn(spark, d):
    c = _t(spark, d, "conversations").where("role = 'user'")
    return c.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("text"))


def hash_split(spark, d):
    return sampling.hash_split(_t(spark, d, "customer").select("c_custkey"), "c_custkey", "seed")


def stratified_sample(spark, d):
    return sampling.stratified(_t(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 20, "s")


def prefix_sample(spark, d):
    return sampling.prefix_sample(_t(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 0.05, "p")


def quota_fill(spark, d):
    q = spark.createDataFrame([("BUILDING", 5), ("MACHINERY", 9)], "c_mktsegment string, quota long")
    return sampling.quota_fill(_t(spark, d, "customer").select("c_custkey", "c_mktsegment"), q, ["c_mktsegment"], "c_custkey", "q")


def rank_aligned_join(spark, d):
    li = _t(spark, d, "lineitem")
    a = sampling.occurrence(li.where("l_quantity > 25").select("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o")), "l_partkey", "o").select("l_partkey", "occurrence", F.col("o").alias("big"))
    b = sampling.occurrence(li.where("l_quantity <= 25").select("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o")), "l_partkey", "o").select("l_partkey", "occurrence", F.col("o").alias("small"))
    return a.join(b, ["l_partkey", "occurrence"])


def exact_knn(spark, d):
    return _round(vectors.nearest(_t(spark, d, "embeddings"), 5).withColumnRenamed("rank", "rank_"), "sim").select("src", "dst", "rank_", "sim")


def _layer(spark, d, k=8):
    return vectors.layer(vectors.nearest(_t(spark, d, "embeddings"), k), k)


def graph_layer(spark, d):
    return _round(_layer(spark, d), "weight")


def edge_jaccard(spark, d):
    n = vectors.nearest(_t(spark, d, "embeddings"), 8)
    return _round(vectors.edge_jaccard(vectors.layer(n, 8), vectors.layer(n.where(F.col("rank") <= 4), 4)), "jaccard")


def partition_agreement(spark, d):
    e = _t(spark, d, "embeddings").select("label", (F.col("vec_id") % 5 + F.col("label") % 3 * 5).alias("other"))
    return _round(vectors.partition_agreement(e, "label", "other"), "ari")


def centroid_norms(spark, d):
    c = vectors.centroids(_t(spark, d, "embeddings"), "label")
    return c.select("label", F.round(F.get("centroid", F.lit(0)), 6).alias("x0"), F.round(M.dot(F.col("centroid"), F.col("centroid")), 6).alias("norm"))


def bridges(spark, d):
    m = _t(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("label").alias("leaf"))
    return _round(vectors.bridges(_layer(spark, d), m).withColumnRenamed("rank", "rank_"), "weight")


def region_sizes(spark, d):
    s = _t(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))
    s = s.withColumn("p", p).withColumn("leaves", M.leaf_target(F.col("n")))
    return s.agg(F.max("n").alias("largest"), F.round(-F.sum(F.col("p") * F.log("p")) / F.log(F.count("*").cast("double")), 6).alias("entropy"), F.sum("leaves").cast("long").alias("leaves"), F.avg((F.col("n") == 1).cast("double")).alias("singletons"))


def triple_chains(spark, d):
    return chains.chains(_layer(spark, d), 12).groupBy("middle").agg(F.count("*").alias("n"), F.sum("first").alias("first"), F.sum("second").alias("second"))


def induced_subgraph(spark, d):
    m = _t(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("label").alias("group"))
    return chains.induced(_layer(spark, d), m).groupBy("group").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight"))


def coherence(spark, d):
    n = vectors.nearest(_t(spark, d, "embeddings"), 8)
    hits = n.select(F.col("src").alias("query_id"), F.col("dst").alias("doc_id"), "rank")
    return _round(chains.coherence(hits, vectors.layer(n, 8)), "coherence")


def rank_overlap(spark, d):
    n = vectors.nearest(_t(spark, d, "embeddings"), 16).select(F.col("src").alias("query_id"), F.col("dst").alias("doc_id"), "rank")
    order = Window.partitionBy("query_id").orderBy("doc_id")
    return _round(chains.rank_biased_overlap(n, n.withColumn("rank", F.row_number().over(order)), 16), "rbo")


def query_similarity(spark, d):
    e = _t(spark, d, "embeddings")
    s = vectors.similarities(e, e.where("vec_id < 20").select(F.col("vec_id").alias("query_id"), "embedding"))
    out = lexical.ranked(s, 10, score="sim", key="vec_id")
    return out.select("query_id", "vec_id", F.col("rank").alias("rank_"), F.round("sim", 6).alias("sim"))


def query_similarity_whole(spark, d):
    """The ten nearest others of every hundredth vector, held in blocks against all vectors."""
    e = _t(spark, d, "embeddings")
    out = vectors.nearest(e, 10, queries=e.where("vec_id % 100 = 0"))
    return out.select(F.col("src").alias("query_id"), F.col("dst").alias("vec_id"), F.col("rank").alias("rank_"), F.round("sim", 6).alias("sim"))


def rrf_fusion(spark, d):
    lex = lexical.ranked(_bm25(spark, d), 50).select("query_id", "doc_id", F.lit("lexical").alias("channel"), "rank")
    docs = _t(spark, d, "documents").select("doc_id", F.size(tokens(F.col("text"))).cast("double").alias("score"))
    wide = lexical.ranked(docs.withColumn("query_id", F.lit(0)), 50).select("doc_id", "rank")
    size = F.broadcast(_t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))).join(wide).select("query_id", "doc_id", F.lit("size").alias("channel"), "rank")
    best = lexical.ranked(vectors.fused(lex.unionByName(size), {"lexical": 1.0, "size": 0.25}), 10)
    return best.select("query_id", "doc_id", F.col("rank").alias("rank_"), F.round("score", 6).alias("score"))


def whole_fusion(spark, d):
    """rrf_fusion over the ranks of all lexical matches and of all documents by size.

    A document without a match can only be among the ten best if its size is, so others of them
    needn't be paired with the queries.
    """
    lex = lexical.ranked(_bm25(spark, d)).select("query_id", "doc_id", F.lit("lexical").alias("channel"), "rank")
    docs = _t(spark, d, "documents").select("doc_id", F.coalesce(F.size(tokens(F.coalesce("text", F.lit("")))), F.lit(0)).alias("size"))
    larger = Window.orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)  # over sizes, which are few
    counts = docs.groupBy("size").agg(F.count("*").alias("n")).select("size", F.coalesce(F.sum("n").over(larger), F.lit(0)).alias("before"))
    sizes = docs.join(F.broadcast(counts), "size").select("doc_id", (F.col("before") + F.row_number().over(Window.partitionBy("size").orderBy("doc_id"))).alias("rank"))
    queries = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    first = F.broadcast(queries).crossJoin(F.broadcast(sizes.where("rank <= 10"))).select("query_id", "doc_id", "rank")
    size = lex.select("query_id", "doc_id").join(sizes, "doc_id").select("query_id", "doc_id", "rank").union(first).distinct()
    size = size.select("query_id", "doc_id", F.lit("size").alias("channel"), "rank")
    best = lexical.ranked(vectors.fused(lex.unionByName(size), {"lexical": 1.0, "size": 0.25}), 10)
    return best.select("query_id", "doc_id", F.col("rank").alias("rank_"), F.round("score", 6).alias("score"))


def region_route(spark, d):
    """Hits of each query by region: how many, and the best one."""
    hits = lexical.ranked(_bm25(spark, d), 100).join(_t(spark, d, "documents").select("doc_id", F.col("source").alias("region")), "doc_id")
    return hits.groupBy("query_id", "region").agg(F.count("*").alias("hits"), F.min_by("doc_id", "rank").alias("best"))


def region_route_whole(spark, d):
    """All matches of each query by region: how many, and the best one."""
    hits = lexical.ranked(_bm25(spark, d)).join(_t(spark, d, "documents").select("doc_id", F.col("source").alias("region")), "doc_id")
    return hits.groupBy("query_id", "region").agg(F.count("*").alias("hits"), F.min_by("doc_id", "rank").alias("best"))


def set_operations_whole(spark, d):
    """Customers without orders, and all that have some."""
    c, o = _t(spark, d, "customer").select(F.col("c_custkey").alias("k")), _t(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return c.exceptAll(o.distinct()).select("k", F.lit("no_orders").alias("kind")).unionByName(c.intersect(o).select("k", F.lit("orders").alias("kind")))


def set_operations(spark, d):
    c, o = _t(spark, d, "customer").select(F.col("c_custkey").alias("k")), _t(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return c.exceptAll(o.distinct()).select("k", F.lit("no_orders").alias("kind")).unionByName(c.intersect(o).where("k % 100 = 0").select("k", F.lit("hundredth").alias("kind")))


def invalid_extra(spark, d):
    """Selected less expected less valid ids, for each order."""
    o = _t(spark, d, "orders")
    sel, exp, val = (F.array(*(F.col(c) % m for m in ms)) for c, ms in (("o_orderkey", (7, 11, 13)), ("o_custkey", (5, 11)), ("o_orderkey", (3,))))
    return o.select("o_orderkey", F.size(F.array_except(F.array_except(sel, exp), val)).alias("extra"), F.size(F.array_distinct(F.concat(sel, exp))).alias("union_"))


def pagination(spark, d):
    return sampling.page(_t(spark, d, "customer").select("c_custkey", "c_acctbal"), [F.col("c_acctbal").desc(), F.col("c_custkey")], 20, 30)


def duplicate_excess(spark, d):
    n = _t(spark, d, "documents").groupBy("text").agg(F.count("*").alias("n"))
    return n.agg(F.sum(F.greatest(F.col("n") - 1, F.lit(0))).alias("excess"))


def anti_resume(spark, d):
    return _t(spark, d, "documents").select("doc_id").join(_t(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


def event_windows(spark, d):
    out = ledger.windowed(_t(spark, d, "events"), "1 day")
    return out.select(F.col("start").cast("string").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def event_ledger(spark, d):
    out = ledger.ledger(_t(spark, d, "events"))
    return out.select("user_id", "sightings", F.round("total", 4).alias("total"))


def revenue_rollup(spark, d):
    li = _t(spark, d, "lineitem")
    return li.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def score_statistics(spark, d):
    """Spread of each query's lexical scores: deviation, exact quantiles, mean of the best eight."""
    s = lexical.ranked(_bm25(spark, d), 64)
    return s.groupBy("query_id").agg(F.round(F.stddev_pop("score"), 6).alias("deviation"), F.round(F.percentile("score", F.lit(0.95)), 6).alias("q95"), F.round(F.avg(F.when(F.col("rank") <= 8, F.col("score"))), 6).alias("top8"))


_u = "(SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings)"
_nn = f"e AS MATERIALIZED {_u}, p AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_inner_product(a.v, b.v), 9) AS sim FROM e a JOIN e b ON a.vec_id <> b.vec_id), nn AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rank FROM p)"
_lay = lambda k, name: f"{name}s AS (SELECT src AS id, greatest(1e-4, 1 - sim) AS scale FROM nn WHERE rank = {k}), {name} AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, CASE WHEN count(*) = 1 THEN avg(w) * 0.5 ELSE avg(w) END AS weight FROM (SELECT src, dst, exp(-greatest(0, 1 - sim) / sqrt(s.scale * t.scale)) / log2(rank + 1) AS w FROM nn JOIN {name}s s ON s.id = src JOIN {name}s t ON t.id = dst WHERE rank <= {k}) GROUP BY 1, 2)"
_G = f"WITH {_nn}, {_lay(8, 'g')}"
_both = "(SELECT src AS node, dst AS neighbour, weight FROM g UNION ALL SELECT dst, src, weight FROM g)"
_sight = "s AS (SELECT user_id AS query_id, 'D' || event_id % 17 AS handle, event_id AS sequence, event_id % 50 AS rank, event_type AS source, CASE WHEN event_id % 11 = 0 THEN 'opened' WHEN event_id % 7 = 0 THEN 'dismissed' ELSE 'seen' END AS action FROM events)"
_led = "l AS (SELECT query_id, handle, min(rank) AS best_rank, min(sequence) AS first_sequence, max(sequence) AS last_sequence, count(*) AS sightings, CASE WHEN bool_or(action = 'opened') THEN 'opened' WHEN bool_or(action = 'dismissed') THEN 'dismissed' ELSE 'unresolved' END AS status FROM s GROUP BY ALL)"
_turns = "t AS (SELECT event_id, user_id, row_number() OVER w AS turn, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS running FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"
_ck = lambda bs, m: "WITH " + _R + " " + " UNION ALL ".join(f"SELECT {b}::DOUBLE AS boundary, count(*) FILTER ({m} <= {b}) AS completed, count(*) FILTER ({m} <= {b} AND is_correct) AS correct, count(*) AS total, round(count(*) FILTER ({m} <= {b} AND is_correct) / count(*), 6) AS accuracy FROM r" for b in bs)
_dig = "sha256('{}:' || {})"

QUERIES = {
    "endpoint_summary": (endpoint_summary, f"WITH {_R}, s AS (SELECT {_SUM} FROM r) SELECT total, correct, round(agent_cost, 6) AS agent_cost, round(judge_cost, 6) AS judge_cost, turns, terminal_invalid, round(correct / total, 6) AS accuracy, round({_W.format('-')}, 6) AS lower, round({_W.format('+')}, 6) AS upper FROM s"),
    "wilson_by_source": (wilson_by_source, f"WITH {_R}, s AS (SELECT source, count(*) AS total, count(*) FILTER (is_correct) AS correct FROM r GROUP BY source) SELECT source, total, correct, round({_W.format('-')}, 6) AS lower, round({_W.format('+')}, 6) AS upper FROM s"),
    "passive_checkpoints": (passive_checkpoints, _ck([5, 15, 30], "turn_count")),
    "cost_checkpoints": (cost_checkpoints, _ck([0.5, 1.5, 4.0], "agent_cost")),
    "paired_outcomes": (paired_outcomes, f"WITH {_R}, p AS (SELECT a.is_correct AS a, b.terminal_valid AS b FROM r a LEFT JOIN r b ON a.query_id = b.query_id AND b.query_id % 7 <> 0) SELECT count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS left_only, count(*) FILTER (NOT a AND b) AS right_only, count(*) FILTER (NOT a AND NOT b) AS neither, count(*) FILTER (a IS NULL OR b IS NULL) AS unpaired FROM p"),
    "paired_outcomes_whole": (paired_outcomes_whole, "WITH o AS (SELECT o_custkey AS k, bool_or(o_orderstatus = 'O') AS b FROM orders GROUP BY 1), p AS (SELECT c_acctbal > 0 AS a, b FROM customer FULL JOIN o ON c_custkey = k) SELECT count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS left_only, count(*) FILTER (NOT a AND b) AS right_only, count(*) FILTER (NOT a AND NOT b) AS neither, count(*) FILTER (a IS NULL OR b IS NULL) AS unpaired FROM p"),
    "breakdown": (breakdown, f"WITH {_R} SELECT lang, source, count(*) AS n, round(avg(CASE WHEN is_correct THEN turn_count * 2.5 ELSE 0 END), 2) AS overall, round(100 * avg(is_correct::INT), 2) AS correctness FROM r GROUP BY GROUPING SETS ((lang), (source), ())"),
    "graded_retrieval": (graded_retrieval, f"WITH {_index}, o AS ({_ordered}), g AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), h AS (SELECT g.*, CASE WHEN o.rank <= 100 THEN o.rank END AS rank, row_number() OVER (PARTITION BY g.query_id ORDER BY g.doc_id) AS best FROM g LEFT JOIN o ON o.query_id = g.query_id AND o.doc_id = g.doc_id) SELECT query_id, round(sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) / sum(CASE WHEN best <= 10 THEN 1 / log2(best + 1) ELSE 0 END), 6) AS ndcg_at_10, round(count(*) FILTER (rank <= 10) / count(*), 6) AS recall_at_10, round(count(*) FILTER (rank <= 100) / count(*), 6) AS recall_at_100 FROM h GROUP BY query_id"),
    "running_cost": (running_cost, f"WITH {_turns} SELECT event_id, user_id, turn::INT AS turn, round(running, 6) AS running FROM t"),
    "budget_trigger": (budget_trigger, f"WITH {_turns} SELECT user_id, min(turn)::INT AS turn FROM t WHERE running >= 2000 OR turn >= 60 GROUP BY user_id"),
    "lead_ledger": (lead_ledger, f"WITH {_sight}, {_led}, o AS (SELECT query_id, handle, source, max(sequence) AS seq FROM s GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY query_id, handle ORDER BY seq DESC) AS n FROM o), j AS (SELECT query_id, handle, string_agg(source, ',' ORDER BY seq DESC) AS sources FROM k WHERE n <= 6 GROUP BY ALL) SELECT l.*, j.sources FROM l JOIN j USING (query_id, handle)"),
    "lead_page": (lead_page, f"WITH {_sight}, {_led} SELECT *, greatest(0, (SELECT count(*) FROM l) - 30)::BIGINT AS remaining FROM l ORDER BY status <> 'unresolved', best_rank, last_sequence DESC, handle, query_id LIMIT 20 OFFSET 10"),
    "evidence_funnel": (evidence_funnel, "WITH r AS (SELECT lang AS stage, 1 + doc_id % 4 AS n, least(n_chars % 5, 1 + doc_id % 4) AS s FROM documents) SELECT stage, round(100 * avg((s = 0)::INT), 6) AS any_blind, round(100 * avg(1 - s / n), 6) AS mean_blind, round(100 * avg((s < n)::INT), 6) AS all_blind, round(sum(s) / sum(n), 6) AS micro_recall FROM r GROUP BY stage"),
    "json_props": (json_props, "SELECT event_type, count(*) AS n, sum(coalesce(json_extract_string(props, '$.k'), json_extract_string(props, '$.key'), '0')::BIGINT)::BIGINT AS total FROM events GROUP BY event_type"),
    "usage_costs": (usage_costs, "SELECT event_id, round((event_id % 1000 * 1.0::DOUBLE + event_id % 77 * 0.2::DOUBLE + user_id * 3.2::DOUBLE) / 1e6, 9) AS cost FROM events"),
    "conversation_turns": (conversation_turns, "SELECT conv_id, turn, lag(role) OVER w AS before, (sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))::BIGINT AS chars FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"),
    "last_user_turn": (last_user_turn, "SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id"),
    "hash_split": (hash_split, f"WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY {_dig.format('seed', 'c_custkey')}) AS n, count(*) OVER () AS t FROM customer) SELECT c_custkey, CASE WHEN n <= round(t * 0.7) THEN 'train' WHEN n <= round(t * 0.85) THEN 'validation' ELSE 'test' END AS split FROM r"),
    "stratified_sample": (stratified_sample, f"SELECT c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_dig.format('s', 'c_custkey')}) AS n FROM customer) WHERE n <= 20"),
    "prefix_sample": (prefix_sample, f"SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_dig.format('p', 'o_orderkey')}) AS n, count(*) OVER (PARTITION BY o_orderpriority) AS t FROM orders) WHERE n <= greatest(1, round_even(t * 0.05, 0))"),
    "quota_fill": (quota_fill, f"SELECT c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_dig.format('q', 'c_custkey')}) AS n FROM customer) WHERE n <= CASE c_mktsegment WHEN 'BUILDING' THEN 5 WHEN 'MACHINERY' THEN 9 ELSE 0 END"),
    "rank_aligned_join": (rank_aligned_join, "WITH o AS (SELECT l_partkey, l_quantity > 25 AS b, l_orderkey * 10 + l_linenumber AS o, row_number() OVER (PARTITION BY l_partkey, l_quantity > 25 ORDER BY l_orderkey * 10 + l_linenumber) AS n FROM lineitem) SELECT x.l_partkey, x.n::INT AS occurrence, x.o AS big, y.o AS small FROM o x JOIN o y ON x.l_partkey = y.l_partkey AND x.n = y.n AND x.b AND NOT y.b"),
    "exact_knn": (exact_knn, f"WITH {_nn} SELECT src, dst, rank::INT AS rank_, round(sim, 6) AS sim FROM nn WHERE rank <= 5"),
    "graph_layer": (graph_layer, f"{_G} SELECT src, dst, round(weight, 6) AS weight FROM g"),
    "edge_jaccard": (edge_jaccard, f"{_G}, {_lay(4, 'h')} SELECT round(count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) / count(*), 6) AS jaccard FROM (SELECT g.src AS a, h.src AS b FROM g FULL JOIN h ON g.src = h.src AND g.dst = h.dst)"),
    "partition_agreement": (partition_agreement, "WITH c AS (SELECT label AS a, vec_id % 5 + label % 3 * 5 AS b, count(*) AS n FROM embeddings GROUP BY 1, 2), i AS (SELECT sum(n * (n - 1) / 2) AS i, sum(n) AS n FROM c), x AS (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT sum(n) AS n FROM c GROUP BY a)), y AS (SELECT sum(n * (n - 1) / 2) AS y FROM (SELECT sum(n) AS n FROM c GROUP BY b)) SELECT round((i - x * y / (n * (n - 1) / 2)) / ((x + y) / 2 - x * y / (n * (n - 1) / 2)), 6) AS ari FROM i, x, y"),
    "centroid_norms": (centroid_norms, "WITH p AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM p GROUP BY ALL), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY label) SELECT label, round(x / n, 6) AS x0, 1.0::DOUBLE AS norm FROM m JOIN n USING (label) WHERE i = 1"),
    "bridges": (bridges, f"{_G}, c AS (SELECT least(a.label, b.label) AS a, greatest(a.label, b.label) AS b, sum(weight) AS w FROM g JOIN embeddings a ON a.vec_id = src JOIN embeddings b ON b.vec_id = dst WHERE a.label <> b.label GROUP BY 1, 2), z AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), t AS (SELECT a, b, w / sqrt(x.n * y.n) AS weight FROM c JOIN z x ON x.label = a JOIN z y ON y.label = b), u AS (SELECT a AS leaf, b AS other, weight FROM t UNION ALL SELECT b, a, weight FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY round(weight, 9) DESC, other) AS rank_ FROM u) SELECT leaf, other, round(weight, 6) AS weight, rank_::INT AS rank_ FROM r WHERE rank_ <= 3"),
    "region_sizes": (region_sizes, "WITH s AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), p AS (SELECT n, n / sum(n) OVER () AS p FROM s) SELECT max(n) AS largest, round(-sum(p * ln(p)) / ln(count(*)), 6) AS entropy, sum(CASE WHEN n < 24 THEN 1 ELSE greatest(2, least(24, round_even(sqrt(n / 10), 0))) END)::BIGINT AS leaves, avg((n = 1)::INT)::DOUBLE AS singletons FROM p"),
    "triple_chains": (triple_chains, f"{_G}, b AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(weight, 9) DESC, neighbour) AS n FROM {_both}), k AS (SELECT * FROM b WHERE n <= 12) SELECT x.node AS middle, count(*) AS n, sum(x.neighbour)::BIGINT AS first, sum(y.neighbour)::BIGINT AS second FROM k x JOIN k y ON x.node = y.node AND x.n < y.n GROUP BY x.node"),
    "induced_subgraph": (induced_subgraph, f"{_G} SELECT a.label AS \"group\", count(*) AS n, round(sum(weight), 6) AS weight FROM g JOIN embeddings a ON a.vec_id = src JOIN embeddings b ON b.vec_id = dst WHERE a.label = b.label GROUP BY 1"),
    "coherence": (coherence, f"{_G}, h AS (SELECT src AS q, dst AS d FROM nn WHERE rank <= 8) SELECT x.q AS query_id, round(avg((g.src IS NOT NULL)::INT), 6) AS coherence FROM h x JOIN h y ON x.q = y.q AND x.d < y.d LEFT JOIN g ON g.src = x.d AND g.dst = y.d GROUP BY 1"),
    "rank_overlap": (rank_overlap, f"WITH {_nn}, k AS (SELECT src, dst, rank AS a, row_number() OVER (PARTITION BY src ORDER BY dst) AS b FROM nn WHERE rank <= 16) SELECT src AS query_id, round(sum(list_sum(list_transform(range(greatest(a, b), 17), lambda d: 0.1 * pow(0.9, d - 1) / d))), 6) AS rbo FROM k GROUP BY src"),
    "query_similarity": (query_similarity, f"WITH e AS {_u}, p AS (SELECT q.vec_id AS query_id, e.vec_id, list_inner_product(q.v, e.v) AS sim FROM e q JOIN e ON q.vec_id < 20), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, vec_id) AS rank_ FROM p) SELECT query_id, vec_id, rank_::INT AS rank_, round(sim, 6) AS sim FROM r WHERE rank_ <= 10"),
    "query_similarity_whole": (query_similarity_whole, f"WITH {_nn} SELECT src AS query_id, dst AS vec_id, rank::INT AS rank_, round(sim, 6) AS sim FROM nn WHERE src % 100 = 0 AND rank <= 10"),
    "rrf_fusion": (rrf_fusion, f"WITH {_index}, o AS ({_ordered}), w AS (SELECT doc_id, row_number() OVER (ORDER BY n DESC, doc_id) AS rank FROM (SELECT doc_id, count(DISTINCT term) AS n FROM tok GROUP BY doc_id UNION ALL SELECT doc_id, 0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM tok))), c AS (SELECT query_id, doc_id, 1.0 / (60 + rank) AS s FROM o WHERE rank <= 50 UNION ALL SELECT item_id, doc_id, 0.25 / (60 + rank) FROM benchmark, w WHERE rank <= 50), f AS (SELECT query_id, doc_id, sum(s)::DOUBLE AS score FROM c GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank_ FROM f) SELECT query_id, doc_id, rank_::INT AS rank_, round(score, 6) AS score FROM r WHERE rank_ <= 10"),
    "rrf_fusion_whole": (whole_fusion, f"WITH {_index}, o AS ({_ordered}), w AS (SELECT doc_id, row_number() OVER (ORDER BY n DESC, doc_id) AS rank FROM (SELECT doc_id, count(DISTINCT term) AS n FROM tok GROUP BY doc_id UNION ALL SELECT doc_id, 0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM tok))), c AS (SELECT query_id, doc_id, 1.0 / (60 + rank) AS s FROM o UNION ALL SELECT item_id, doc_id, 0.25 / (60 + rank) FROM benchmark, w), f AS (SELECT query_id, doc_id, sum(s)::DOUBLE AS score FROM c GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank_ FROM f) SELECT query_id, doc_id, rank_::INT AS rank_, round(score, 6) AS score FROM r WHERE rank_ <= 10"),
    "region_route": (region_route, f"WITH {_index}, o AS ({_ordered}) SELECT query_id, source AS region, count(*) AS hits, arg_min(doc_id, rank) AS best FROM o JOIN documents USING (doc_id) WHERE rank <= 100 GROUP BY ALL"),
    "region_route_whole": (region_route_whole, f"WITH {_index}, o AS ({_ordered}) SELECT query_id, source AS region, count(*) AS hits, arg_min(doc_id, rank) AS best FROM o JOIN documents USING (doc_id) GROUP BY ALL"),
    "set_operations_whole": (set_operations_whole, "SELECT c_custkey AS k, 'no_orders' AS kind FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT c_custkey, 'orders' FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)"),
    "set_operations": (set_operations, "SELECT c_custkey AS k, 'no_orders' AS kind FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT c_custkey, 'hundredth' FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) AND c_custkey % 100 = 0"),
    "invalid_extra": (invalid_extra, "SELECT o_orderkey, len(list_filter(list_distinct([o_orderkey % 7, o_orderkey % 11, o_orderkey % 13]), lambda x: x <> o_custkey % 5 AND x <> o_custkey % 11 AND x <> o_orderkey % 3))::INT AS extra, len(list_distinct([o_orderkey % 7, o_orderkey % 11, o_orderkey % 13, o_custkey % 5, o_custkey % 11]))::INT AS union_ FROM orders"),
    "pagination": (pagination, "SELECT c_custkey, c_acctbal, greatest(0, (SELECT count(*) FROM customer) - 50)::BIGINT AS remaining FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 30 OFFSET 20"),
    "duplicate_excess": (duplicate_excess, "SELECT (count(*) - count(DISTINCT text))::BIGINT AS excess FROM documents"),
    "anti_resume": (anti_resume, "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "event_windows": (event_windows, "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"),
    "event_ledger": (event_ledger, "SELECT user_id, count(*) AS sightings, round(sum(value), 4) AS total FROM events GROUP BY user_id"),
    "revenue_rollup": (revenue_rollup, "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"),
    "score_statistics": (score_statistics, f"WITH {_index}, o AS ({_ordered}) SELECT query_id, round(stddev_pop(score), 6) AS deviation, round(quantile_cont(score, 0.95), 6) AS q95, round(avg(score) FILTER (rank <= 8), 6) AS top8 FROM o WHERE rank <= 64 GROUP BY query_id"),
}
