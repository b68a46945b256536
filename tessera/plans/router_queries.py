"""Queries over the router's training data, signatures and atlas checks, with their oracles.

Vectors stand in for documents, their labels for parents, and label and number modulo 4 for leaves.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from tessera.operators import atlas_checks, lexical, router_data, sampling, signatures
from tessera.plans.text_queries import QUERIES as TEXT
from tessera.plans.text_queries import _t

_PLACES = "p AS (SELECT vec_id AS doc_id, label AS parent, label * 4 + vec_id % 4 AS leaf, CASE WHEN label % 5 < 3 THEN 'train' WHEN label % 5 = 3 THEN 'validation' ELSE 'test' END AS split FROM embeddings)"
_EDGES = "e AS (SELECT l_orderkey % 300 AS src, l_partkey % 300 AS dst, max(l_extendedprice) AS weight FROM lineitem WHERE l_orderkey % 300 < l_partkey % 300 GROUP BY 1, 2)"


def _places(spark, d):
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("parent"), F.expr("label * 4 + vec_id % 4").alias("leaf"),
                                            F.expr("case when label % 5 < 3 then 'train' when label % 5 = 3 then 'validation' else 'test' end").alias("split"))


def _edges(spark, d):
    rows = _t(spark, d, "lineitem").select(F.expr("l_orderkey % 300").alias("src"), F.expr("l_partkey % 300").alias("dst"), F.col("l_extendedprice").alias("weight"))
    return rows.where("src < dst").groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def _positives(spark, d):
    return _t(spark, d, "lineitem").select(F.expr("l_suppkey").alias("query_id"), F.expr("l_partkey % 500").alias("doc_id")).distinct()


_POS = "q AS (SELECT DISTINCT l_suppkey AS query_id, l_partkey % 500 AS doc_id FROM lineitem)"


def usable_excerpts(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("sentence"))
    return router_data.usable_excerpts(rows)


def programmatic_questions(spark, d):
    rows = _t(spark, d, "benchmark").select("item_id", F.concat("text", F.when(F.col("item_id") % 2 == 0, "?").otherwise("")).alias("question"))
    return rows.select("item_id", router_data.programmatic(F.col("question"), ["the", "file"]).alias("ok"))


def accepted_tasks(spark, d):
    rows = _t(spark, d, "orders").select("o_orderkey", F.expr("if(o_orderkey % 5 = 0, null, o_orderkey % 3 <> 0)").alias("a"), F.expr("o_custkey % 2 = 0").alias("b"), F.expr("if(o_orderkey % 4 = 0, null, o_orderkey % 4 = 1)").alias("decoy"),
                                         F.concat(F.lit("Which order of this customer has the highest priority of "), "o_orderpriority", F.lit("?")).alias("q"))
    return rows.select("o_orderkey", router_data.accepted(["a", "b"], "decoy", F.col("q"), ["urgent"]).alias("ok"))


def task_edges(spark, d):
    return router_data.task_edges(_edges(spark, d), _places(spark, d))


def support_tasks(spark, d):
    places, edges = _places(spark, d), _edges(spark, d)
    inside = router_data.task_edges(edges, places)
    chains = inside.where("src % 10 = 0").select(F.col("src").alias("left"), F.col("dst").alias("middle"), (F.col("dst") + 1).alias("right"), "split")
    return router_data.support_tasks(places, inside, chains).groupBy("kind", "split").agg(F.count("*").alias("n"), F.min("task_id").alias("first_id"))


def split_leaks(spark, d):
    rows = sampling.hash_split(_t(spark, d, "customer"), "c_custkey", "leak").select(F.col("c_nationkey").alias("parent"), "split")
    return router_data.split_leaks(rows)


def decoys(spark, d):
    rows = _t(spark, d, "part").select(F.col("p_partkey").alias("task_id"), F.col("p_brand").alias("split"), F.expr("array(p_size, p_partkey % 5)").alias("support"))
    return router_data.decoys(rows)


def calibrated_ranks(spark, d):
    rows = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("query_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("doc_id"), F.col("l_quantity").alias("sim"))
    sample = _t(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_suppkey").alias("query_id"), F.col("l_orderkey").alias("doc_id"), (F.col("l_quantity") + F.when(F.col("l_orderkey") % 2 == 0, 0.5).otherwise(0.0)).alias("sim"))
    out = router_data.calibrated_ranks(rows, sample, 1000)
    return out.groupBy("query_id", "doc_id", "rank").agg(F.count("*").alias("n"))


def lexical_channel(spark, d):
    ranks = _t(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"), F.expr("1 + o_orderkey % 50").alias("rank"))
    return router_data.lexical_channel(_t(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id")), ranks, 5000).withColumn("lexical_rrf", F.round("lexical_rrf", 9))


def region_negatives(spark, d):
    queries = _positives(spark, d).where("doc_id % 50 = 7")
    return router_data.region_negatives(queries, _places(spark, d), 4).groupBy("query_id", "pool").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def sample_weights(spark, d):
    q = _positives(spark, d)
    return router_data.sample_weights(q, q.where("query_id % 4 <> 3").select("query_id")).withColumn("weight", F.round("weight", 9))


def rare_queries(spark, d):
    return router_data.rare_queries(_positives(spark, d).where("doc_id % 9 = query_id % 9"), _places(spark, d))


def _similar(spark, d):
    rows = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("query_id"), F.expr("l_partkey % 500").alias("doc_id"), F.expr("l_extendedprice / 100000").alias("sim"), F.expr("l_linenumber <= 3").alias("c"))
    pick = lambda c: rows.where(F.col("c") == c).groupBy("query_id", "doc_id").agg(F.max("sim").alias("sim"))
    return pick(True), pick(False).where("query_id % 6 <> 1")


def pool_union(spark, d):
    return router_data.pool_union(*_similar(spark, d)).withColumn("sim", F.round("sim", 9))


def view_statistics(spark, d):
    out = router_data.view_statistics(*_similar(spark, d), _places(spark, d))
    return out.select("query_id", *(F.round(c, 6).alias(c) for c in out.columns if c != "query_id"))


_VIEW = f"""r AS (SELECT l_suppkey AS query_id, l_partkey % 500 AS doc_id, l_extendedprice / 100000 AS sim, l_linenumber <= 3 AS c FROM lineitem),
c AS (SELECT query_id, doc_id, max(sim) AS sim FROM r WHERE c GROUP BY 1, 2), x AS (SELECT query_id, doc_id, max(sim) AS sim FROM r WHERE NOT c AND query_id % 6 <> 1 GROUP BY 1, 2),
u AS (SELECT *, 'calibration' AS origin FROM c UNION ALL SELECT *, 'lexical' FROM x ANTI JOIN c USING (query_id, doc_id))"""


def usage_shares(spark, d):
    rows = _t(spark, d, "events").select("event_id", F.expr("user_id * 7").alias("total"), F.expr("1 + user_id % 6").alias("parts"))
    rows = rows.withColumn("index", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return rows.select("event_id", "index", router_data.share_usage(F.col("total"), F.col("parts"), F.col("index")).alias("share"))


def query_signatures(spark, d):
    s = signatures.query_signatures(F.col("text"))
    return _t(spark, d, "benchmark").select("item_id", *(F.sha2(v.cast("binary"), 256).alias(k) for k, v in s.items()))


def _documents(spark, d):
    return _t(spark, d, "documents").select("doc_id", "text")


def document_signatures(spark, d):
    """Lengths and digests; held against a plain program in the tests."""
    out = signatures.document_signatures(_documents(spark, d))
    return out.select("doc_id", "view", F.length("signature").alias("chars"), F.sha2(F.col("signature").cast("binary"), 256).alias("digest"))


def uniform_sentences(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("s"))
    return rows.select("doc_id", F.array_join(F.transform(signatures.uniform(F.col("s"), 8), lambda x: F.length(x).cast("string")), ",").alias("lengths"))


def viewport(spark, d):
    """Suppliers' sales stand in for scores of documents: nations are parents, suppliers' numbers modulo 9 their leaves."""
    return signatures.viewport(_scores(spark, d), _scored_places(spark, d), parents=4, anchors=3)


def _scored_places(spark, d):
    return _t(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_nationkey").alias("parent"), F.expr("c_nationkey * 9 + c_custkey % 9").alias("leaf"))


def _scores(spark, d):
    rows = _t(spark, d, "orders").select(F.expr("o_orderkey % 12").alias("query_id"), F.col("o_custkey").alias("doc_id"), "o_totalprice")
    return rows.groupBy("query_id", "doc_id").agg(F.max("o_totalprice").alias("score"))


def region_labels(spark, d):
    rows = _t(spark, d, "customer").select(F.col("c_custkey").alias("region"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(" ").alias("given"), F.when(F.col("c_custkey") % 3 == 1, F.col("c_mktsegment")).alias("machine"),
                                           F.when(F.col("c_custkey") % 5 != 2, F.array("c_name", "c_mktsegment", F.lit("x"), F.lit("y"))).alias("titles"))
    return rows.select("region", signatures.label(F.col("given"), F.col("machine"), F.col("titles"), F.lit("Unnamed")).alias("label"))


def isolated_vertices(spark, d):
    return atlas_checks.isolated(_places(spark, d), _edges(spark, d))


def split_leaves(spark, d):
    rows = _t(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("leaf"), F.expr("if(o_custkey % 10 = 0, o_orderkey % 3, 1)").alias("parent"))
    return atlas_checks.split_leaves(rows)


def edge_gain(spark, d):
    layers = _edges(spark, d).withColumn("layer", F.when(F.col("src") % 3 == 0, "topic").otherwise("identity"))
    return atlas_checks.edge_gain(layers, _places(spark, d).select("doc_id", F.col("parent").alias("community")), {"topic": 1.0, "identity": 0.75}).select(F.round("gain", 9).alias("gain"))


def neighbouring_partitions(spark, d):
    rows = _t(spark, d, "embeddings")
    parts = None
    for k, n in enumerate((2, 4, 8)):
        one = rows.select(F.lit(float(n)).alias("resolution"), F.col("vec_id").alias("doc_id"), F.expr(f"(label + vec_id % {n}) % {n + 3}").alias("community"))
        parts = one if parts is None else parts.unionByName(one)
    return atlas_checks.adjacent_agreement(parts).select("resolution", "next_resolution", F.round("ari", 9).alias("ari"))


def collapsed_views(spark, d):
    e = _edges(spark, d)
    layers = {"topic": e, "identity": e.where("(src + dst) % 20 <> 0"), "episode": e.where("src % 2 = 0")}
    out = atlas_checks.view_overlap({k: v.select("src", "dst") for k, v in layers.items()})
    return out.select("left", "right", F.round("jaccard", 9).alias("jaccard"), "collapsed")


def planted_secrets(spark, d):
    """Keys of three kinds are planted in every tenth document; look-alikes that are too short or inside a word aren't hits."""
    from tessera.sources.readers import scan_secrets

    key = F.expr("repeat('a1B2', 10)")
    text = F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit(" sk_"), key, F.lit(" ghp_"), key)).when(F.col("doc_id") % 10 == 1, F.concat("text", F.lit(" sk-"), key, F.lit("\nsk-"), key)).when(F.col("doc_id") % 10 == 2, F.concat("text", F.lit(" sk_short xsk_"), key)).otherwise(F.col("text"))
    return scan_secrets(_documents(spark, d).withColumn("text", text))


def saved_index_top10(spark, d):
    """bm25_top10 from an index that is written to the shared folder and read again."""
    import uuid

    folder = (spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.gettempdir()}/tessera-shared").rstrip("/") + f"/index-{uuid.uuid4().hex}"
    lexical.save_index(lexical.build_index(_t(spark, d, "documents")), folder)
    queries = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), lexical.query_terms(F.col("text")).alias("terms"))
    best = lexical.ranked(lexical.search_index(lexical.load_index(spark, folder), queries), 10)
    return best.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


QUERIES = {
    "saved_index_top10": (saved_index_top10, TEXT["bm25_top10"][1]),
    "usable_excerpts": (usable_excerpts, "WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS sentence FROM documents), l AS (SELECT DISTINCT * FROM s WHERE length(sentence) >= 45), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sha256('excerpt:' || doc_id || ':' || sentence), sentence) AS n FROM l) SELECT doc_id, n::INT AS n, sentence AS excerpt FROM r WHERE n <= 2 AND doc_id IN (SELECT doc_id FROM r WHERE n = 2)"),
    "programmatic_questions": (programmatic_questions, r"WITH t AS (SELECT item_id, trim(regexp_replace(text || CASE WHEN item_id % 2 = 0 THEN '?' ELSE '' END, '\s+', ' ', 'g')) AS q FROM benchmark) SELECT item_id, length(q) BETWEEN 45 AND 900 AND q LIKE '%?' AND NOT regexp_matches(q, '(?i)\b(the|file)\b') AS ok FROM t"),
    "accepted_tasks": (accepted_tasks, "SELECT o_orderkey, coalesce(o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0 AND o_custkey % 2 = 0 AND o_orderkey % 4 <> 1 AND o_orderpriority NOT ILIKE '%urgent%', false) AS ok FROM orders"),
    "task_edges": (task_edges, f"WITH {_PLACES}, {_EDGES} SELECT src, dst, a.split, weight FROM e JOIN p a ON a.doc_id = src JOIN p b ON b.doc_id = dst WHERE a.split = b.split AND a.leaf <> b.leaf"),
    "support_tasks": (support_tasks, f"""WITH {_PLACES}, {_EDGES}, i AS (SELECT src, dst, a.split FROM e JOIN p a ON a.doc_id = src JOIN p b ON b.doc_id = dst WHERE a.split = b.split AND a.leaf <> b.leaf),
t AS (SELECT 'single' AS kind, split, doc_id::VARCHAR AS s FROM p UNION ALL SELECT 'pair', split, src || '-' || dst FROM i UNION ALL SELECT 'triple', split, src || '-' || dst || '-' || (dst + 1) FROM i WHERE src % 10 = 0)
SELECT kind, split, count(*) AS n, min(substr(sha256('task:' || kind || ':' || s), 1, 16)) AS first_id FROM t GROUP BY 1, 2"""),
    "split_leaks": (split_leaks, None),
    "decoys": (decoys, """WITH t AS (SELECT p_partkey AS task_id, p_brand AS split, [p_size, p_partkey % 5] AS support, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS at, count(*) OVER (PARTITION BY p_brand) AS n FROM part),
s AS (SELECT *, ('0x' || substr(sha256('decoy:' || task_id), 1, 12))::BIGINT % n AS start FROM t)
SELECT a.task_id, arg_min(b.task_id, (b.at - a.start + a.n) % a.n) AS decoy_id FROM s a LEFT JOIN s b ON a.split = b.split AND NOT list_has_any(a.support, b.support) GROUP BY 1"""),
    "calibrated_ranks": (calibrated_ranks, """WITH s AS (SELECT l_suppkey AS q, l_quantity + CASE WHEN l_orderkey % 2 = 0 THEN 0.5 ELSE 0 END AS sim FROM lineitem WHERE l_linenumber = 1), k AS (SELECT q, sim, count(*) AS n FROM s GROUP BY 1, 2), z AS (SELECT q, count(*) AS size FROM s GROUP BY 1),
v AS (SELECT DISTINCT l_suppkey AS q, l_quantity AS sim FROM lineitem), t AS (SELECT v.q, v.sim, coalesce(sum(k.n) FILTER (k.sim > v.sim), 0) AS tail FROM v LEFT JOIN k USING (q) GROUP BY 1, 2) 
SELECT l_suppkey AS query_id, l_orderkey * 10 + l_linenumber AS doc_id, least(greatest(1 + round_even(tail * 999 / greatest(coalesce(size, 0), 1), 0), 1), 1000)::BIGINT AS rank, count(*) AS n FROM lineitem JOIN t ON t.q = l_suppkey AND t.sim = l_quantity LEFT JOIN z ON z.q = l_suppkey GROUP BY 1, 2, 3""".replace("LEFT JOIN k USING (q)", "LEFT JOIN k ON k.q = v.q")),
    "lexical_channel": (lexical_channel, "SELECT o_custkey AS query_id, o_orderkey AS doc_id, CASE WHEN o_orderstatus = 'O' THEN 1 + o_orderkey % 50 ELSE 5000 END AS lexical_rank, CASE WHEN o_orderstatus = 'O' THEN round(1 / (61 + o_orderkey % 50), 9) ELSE 0 END AS lexical_rrf FROM orders"),
    "region_negatives": (region_negatives, f"""WITH {_PLACES}, {_POS}, s AS (SELECT q.query_id, p.* FROM q JOIN p USING (doc_id) WHERE doc_id % 50 = 7), 
n AS (SELECT s.query_id, s.doc_id AS source, o.doc_id, 'same_leaf' AS pool FROM s JOIN p o ON o.leaf = s.leaf AND o.doc_id <> s.doc_id UNION ALL SELECT s.query_id, s.doc_id, o.doc_id, 'same_parent_other_leaf' FROM s JOIN p o ON o.parent = s.parent AND o.leaf <> s.leaf),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, source, pool ORDER BY sha256('negative:' || source || ':' || doc_id), doc_id) AS k FROM n), d AS (SELECT DISTINCT query_id, pool, doc_id FROM r WHERE k <= 4) SELECT query_id, pool, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM d GROUP BY 1, 2"""),
    "sample_weights": (sample_weights, f"WITH {_POS}, f AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS f FROM q), r AS (SELECT query_id, avg(1 / sqrt(f)) AS raw FROM f GROUP BY 1) SELECT query_id, round(raw / (SELECT avg(raw) FROM r WHERE query_id % 4 <> 3), 9) AS weight FROM r"),
    "rare_queries": (rare_queries, f"WITH {_PLACES}, {_POS}, s AS (SELECT leaf, count(*) AS size FROM p GROUP BY 1) SELECT query_id, bool_or(size <= (SELECT quantile_cont(size, 0.25) FROM s)) AS rare FROM q JOIN p USING (doc_id) JOIN s USING (leaf) WHERE doc_id % 9 = query_id % 9 GROUP BY 1"),
    "pool_union": (pool_union, f"WITH {_VIEW} SELECT query_id, doc_id, round(sim, 9) AS sim, origin FROM u"),
    "view_statistics": (view_statistics, f"""WITH {_PLACES}, {_VIEW}, b AS (SELECT query_id, stddev_pop(sim) AS std, quantile_cont(sim, 0.5) AS q50, quantile_cont(sim, 0.95) AS q95, quantile_cont(sim, 0.99) AS q99 FROM c GROUP BY 1),
k AS (SELECT u.*, p.leaf, p.parent, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, doc_id) AS rank FROM u JOIN p USING (doc_id)), t AS (SELECT query_id, avg(sim) AS top8 FROM k WHERE rank <= 8 GROUP BY 1),
h AS (SELECT query_id, max(n) / sum(n) AS share FROM (SELECT query_id, parent, count(*) AS n FROM k WHERE rank <= 32 GROUP BY 1, 2) GROUP BY 1), l AS (SELECT query_id, max(n) / sum(n) AS share FROM (SELECT query_id, leaf, count(*) AS n FROM k WHERE rank <= 32 GROUP BY 1, 2) GROUP BY 1), m AS (SELECT query_id, avg(sim) AS mean FROM x GROUP BY 1)
SELECT query_id, round(std, 6) AS std, round(q95, 6) AS q95, round(q99, 6) AS q99, round(top8, 6) AS top8, round(least(greatest((top8 - q95) / greatest(q95 - q50, 1e-5), 0), 20), 6) AS sharpness, round(h.share, 6) AS parent_share, round(l.share, 6) AS leaf_share, round(coalesce(mean, q50), 6) AS lexical_mean
FROM b JOIN t USING (query_id) JOIN h USING (query_id) JOIN l USING (query_id) LEFT JOIN m USING (query_id)"""),
    "usage_shares": (usage_shares, "WITH t AS (SELECT event_id, user_id * 7 AS total, 1 + user_id % 6 AS parts, unnest(range(1 + user_id % 6)) AS index FROM events) SELECT event_id, index, total // parts + (index < total % parts)::INT AS share FROM t"),
    "query_signatures": (query_signatures, "WITH t AS (SELECT item_id, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 8000) AS q FROM benchmark) SELECT item_id, " + ", ".join(f"sha256('Instruct: {v}' || chr(10) || 'Query: ' || q) AS {k}" for k, v in ((k, v.replace("'", "''")) for k, v in signatures.QUERY_INSTRUCTIONS.items())) + " FROM t"),
    "document_signatures": (document_signatures, None),
    "uniform_sentences": (uniform_sentences, "WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents) SELECT doc_id, array_to_string(CASE WHEN len(s) <= 8 THEN list_transform(s, lambda x: length(x)::VARCHAR) ELSE list_transform(range(8), lambda i: length(s[(i * (len(s) - 1)) // 7 + 1])::VARCHAR) END, ',') AS lengths FROM t"),
    "viewport": (viewport, """WITH p AS (SELECT c_custkey AS doc_id, c_nationkey AS parent, c_nationkey * 9 + c_custkey % 9 AS leaf FROM customer), s AS (SELECT o_orderkey % 12 AS query_id, o_custkey AS doc_id, max(o_totalprice) AS score FROM orders GROUP BY 1, 2),
r AS (SELECT s.*, parent, leaf, row_number() OVER (PARTITION BY query_id, leaf ORDER BY score DESC, doc_id) AS k FROM s JOIN p USING (doc_id)), b AS (SELECT * FROM r WHERE k = 1),
a AS (SELECT *, row_number() OVER (PARTITION BY query_id, parent ORDER BY score DESC, leaf) AS anchor_rank FROM b), o AS (SELECT query_id, parent, row_number() OVER (PARTITION BY query_id ORDER BY max(score) DESC, parent) AS route_rank FROM a GROUP BY 1, 2)
SELECT query_id, parent, leaf, doc_id, score, route_rank::INT AS route_rank, anchor_rank::INT AS anchor_rank, ((route_rank - 1) * 3 + anchor_rank)::INT AS lead_rank FROM a JOIN o USING (query_id, parent) WHERE route_rank <= 4 AND anchor_rank <= 3"""),
    "region_labels": (region_labels, "SELECT c_custkey AS region, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN c_mktsegment WHEN c_custkey % 5 <> 2 THEN c_name || ' | ' || c_mktsegment || ' | x' ELSE 'Unnamed' END AS label FROM customer"),
    "isolated_vertices": (isolated_vertices, f"WITH {_PLACES}, {_EDGES} SELECT doc_id FROM p WHERE doc_id NOT IN (SELECT src FROM e UNION SELECT dst FROM e)"),
    "split_leaves": (split_leaves, "SELECT o_custkey AS leaf, count(DISTINCT o_orderkey % 3) AS parents FROM orders WHERE o_custkey % 10 = 0 GROUP BY 1 HAVING count(DISTINCT o_orderkey % 3) > 1"),
    "edge_gain": (edge_gain, f"""WITH {_PLACES}, {_EDGES}, l AS (SELECT CASE WHEN src % 3 = 0 THEN 'topic' ELSE 'identity' END AS layer, sum(weight) AS total, sum(weight) FILTER (a.parent = b.parent) AS inside FROM e JOIN p a ON a.doc_id = src JOIN p b ON b.doc_id = dst GROUP BY 1),
z AS (SELECT sum(power(n / t, 2)) AS null_ FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS t FROM p GROUP BY parent))
SELECT round(sum(CASE layer WHEN 'topic' THEN 1 ELSE 0.75 END * (inside / total - null_) / (1 - null_)) / 1.75, 9) AS gain FROM l, z"""),
    "neighbouring_partitions": (neighbouring_partitions, "WITH a AS (SELECT vec_id, (label + vec_id % 2) % 5 AS p2, (label + vec_id % 4) % 7 AS p4, (label + vec_id % 8) % 11 AS p8 FROM embeddings), " + ", ".join(
        f"{n} AS (SELECT (SELECT sum(c * (c - 1) / 2) FROM (SELECT count(*) AS c FROM a GROUP BY {x}, {y})) AS s, (SELECT sum(c * (c - 1) / 2) FROM (SELECT count(*) AS c FROM a GROUP BY {x})) AS u, (SELECT sum(c * (c - 1) / 2) FROM (SELECT count(*) AS c FROM a GROUP BY {y})) AS v, (SELECT count(*) * (count(*) - 1) / 2 FROM a) AS t)" for n, x, y in (("m", "p2", "p4"), ("n", "p4", "p8"))) +
        " SELECT 2.0::DOUBLE AS resolution, 4.0::DOUBLE AS next_resolution, round((s - u * v / t) / ((u + v) / 2 - u * v / t), 9) AS ari FROM m UNION ALL SELECT 4.0, 8.0, round((s - u * v / t) / ((u + v) / 2 - u * v / t), 9) FROM n"),
    "collapsed_views": (collapsed_views, f"""WITH {_EDGES}, v AS (SELECT *, true AS topic, (src + dst) % 20 <> 0 AS identity, src % 2 = 0 AS episode FROM e) 
SELECT 'topic' AS left, 'identity' AS right, round(count(*) FILTER (topic AND identity) / count(*) FILTER (topic OR identity), 9) AS jaccard, count(*) FILTER (topic AND identity) / count(*) FILTER (topic OR identity) >= 0.9 AS collapsed FROM v UNION ALL
SELECT 'topic', 'episode', round(count(*) FILTER (topic AND episode) / count(*) FILTER (topic OR episode), 9), count(*) FILTER (topic AND episode) / count(*) FILTER (topic OR episode) >= 0.9 FROM v UNION ALL
SELECT 'identity', 'episode', round(count(*) FILTER (identity AND episode) / count(*) FILTER (identity OR episode), 9), count(*) FILTER (identity AND episode) / count(*) FILTER (identity OR episode) >= 0.9 FROM v"""),
    "planted_secrets": (planted_secrets, "SELECT doc_id, unnest(CASE WHEN doc_id % 10 = 0 THEN ['underscore_api_key', 'github_token'] ELSE ['dash_api_key'] END) AS pattern, CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 2 END AS hits FROM documents WHERE doc_id % 10 IN (0, 1)"),
}
