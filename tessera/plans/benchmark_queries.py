"""Queries over benchmark records, with their oracles; the driver's tables stand in for the published files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import simple_upper
from tessera.operators import benchmarks as B
from tessera.plans.text_queries import _t


def _enterprise(spark, d):
    """Orders stand in for documents, their customers for raw ids."""
    return _t(spark, d, "orders").select(
        F.col("o_orderkey").alias("position"), F.concat(F.lit("doc-"), F.col("o_custkey").cast("string")).alias("doc_id"), F.lower("o_orderstatus").alias("source_type"),
        F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit("Order of "), F.col("o_custkey").cast("string"))).otherwise(" ").alias("title"), F.col("o_orderpriority").alias("content"))


def enterprise_corpus(spark, d):
    return B.enterprise_corpus(_enterprise(spark, d)).select("docid", "raw_id", "text", "source_type")


def expected_documents(spark, d):
    asked = _t(spark, d, "orders").select(F.col("o_orderkey").alias("question_id"), F.expr("transform(array(o_custkey % 40, o_custkey % 30, o_custkey % 40, 9999999), x -> concat('doc-', cast(x as string)))").alias("expected_doc_ids"))
    return B.expected_documents(asked, B.enterprise_corpus(_enterprise(spark, d)))


def _wiki(spark, d):
    """Questions whose context has two titled lists of sentences, as JSON strings."""
    rows = _t(spark, d, "benchmark").withColumn("s", F.expr("filter(split(text, '[.]'), x -> length(trim(x)) > 0)"))
    pair = lambda title, s: F.to_json(F.array(F.concat(F.lit(title), F.col("item_id").cast("string")), F.to_json(s)))
    context = F.concat(F.lit("["), pair("Town ", F.col("s")), F.lit(","), pair("River ", F.reverse("s")), F.lit("]"))
    facts = F.concat(F.lit('[["Town '), F.col("item_id").cast("string"), F.lit('",0],["River '), F.col("item_id").cast("string"), F.lit('",1],["River '), F.col("item_id").cast("string"), F.lit('",99]]'))
    return rows.select(F.col("item_id").alias("_id"), context.alias("context"), facts.alias("supporting_facts"))


_S = "s AS (SELECT item_id, list_filter(string_split(text, '.'), lambda x: length(trim(x)) > 0) AS s FROM benchmark)"


def wiki_passages(spark, d):
    return B.passages_2wiki(_wiki(spark, d))


def wiki_supporting(spark, d):
    return B.supporting_sentences(_wiki(spark, d))


def world_documents(spark, d):
    rows = _t(spark, d, "part").select(F.expr("cast(p_size % 5 as int)").alias("world"), F.col("p_partkey").cast("int").alias("position"), F.col("p_name").alias("title"), F.col("p_type").alias("article"), F.array("p_brand", F.col("p_size").cast("string")).alias("facts"))
    return B.world_documents(rows)


def answerable_questions(spark, d):
    rows = _t(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p"), F.collect_list("o_orderkey").alias("answer"))
    return B.answerable(rows).select("o_custkey", F.size("answer").alias("n_answers"))


def namespaced_text(spark, d):
    rows = _t(spark, d, "part").select("p_partkey", F.concat_ws(" and ", "p_brand", "p_type", "p_brand").alias("text"), F.array("p_brand", "p_type", F.substring("p_brand", 1, 5)).alias("names"))
    return rows.select("p_partkey", B.namespaced(F.col("text"), F.array_distinct("names"), F.lit(3)).alias("text"))


def json_leaves(spark, d):
    rows = _t(spark, d, "events").select("event_id", F.concat(F.lit('{"a":['), F.col("user_id").cast("string"), F.lit(',{"b":"'), F.col("event_type"), F.lit('"}],"p":'), F.col("props"), F.lit("}")).alias("j"))
    return B.leaves(rows, "event_id", "j")


def _frozen(spark, d):
    rows = _t(spark, d, "orders").select(
        F.col("o_orderkey").alias("question_id"), F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderpriority")).alias("question_type"),
        F.expr("filter(array(o_orderstatus, if(o_orderkey % 2 = 0, 'even', null)), x -> x is not null)").alias("source_types"),
        F.expr("if(o_orderkey % 10 = 0, array(), transform(array(o_custkey % 7, o_custkey % 11), x -> concat('D', cast(x as string))))").alias("expected_doc_ids"),
        F.expr("array(concat('d', cast(o_custkey % 5 as string)))").alias("valid_doc_ids"))
    answers = _t(spark, d, "orders").select(F.col("o_orderkey").alias("question_id"), F.expr("transform(array(o_custkey % 7, o_orderkey % 5, o_orderkey % 13), x -> concat('d', cast(x as string)))").alias("document_ids"))
    judged = _t(spark, d, "orders").select(F.col("o_orderkey").alias("question_id"), F.expr("o_orderkey % 3 <> 0").alias("answer_correct"), F.expr("cast(o_orderkey % 101 as double)").alias("completeness_pct"))
    return rows, answers, judged


_FROZEN = """q AS (SELECT o_orderkey AS question_id, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderpriority END AS question_type, list_filter([o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN 'even' END], lambda x: x IS NOT NULL) AS source_types,
  CASE WHEN o_orderkey % 10 = 0 THEN [] ELSE list_distinct([o_custkey % 7, o_custkey % 11]) END AS e, [o_custkey % 5] AS v, list_distinct([o_custkey % 7, o_orderkey % 5, o_orderkey % 13]) AS s, o_orderkey % 3 <> 0 AS answer_correct, (o_orderkey % 101)::DOUBLE AS completeness_pct FROM orders),
f AS (SELECT question_id, question_type, source_types, answer_correct, completeness_pct, CASE WHEN len(e) > 0 THEN round(100 * len(list_intersect(s, e)) / len(e), 2) END AS document_recall_pct,
  CASE WHEN len(e) > 0 THEN len(list_filter(s, lambda x: NOT list_contains(e, x) AND NOT list_contains(v, x)))::DOUBLE END AS invalid_extra_docs FROM q)"""


def frozen_evaluation(spark, d):
    chosen = _t(spark, d, "orders").where("o_orderkey % 17 = 0").select(F.col("o_orderkey").alias("question_id"), F.lit(50.0).alias("document_recall_pct"), F.lit(2).alias("invalid_extra_docs"))
    return B.evaluate_frozen(*_frozen(spark, d), chosen).drop("source_types")


def frozen_breakdowns(spark, d):
    return B.summaries(B.evaluate_frozen(*_frozen(spark, d)))


def unequal_ids(spark, d):
    ids = lambda t, c: _t(spark, d, t).select(F.col(c).cast("long").alias("question_id"))
    return B.same_ids(ids("orders", "o_custkey"), ids("customer", "c_custkey"), ids("supplier", "s_suppkey"))


def selector_candidates(spark, d):
    conv = _t(spark, d, "conversations")
    audit = conv.groupBy(F.col("conv_id").alias("question_id")).agg(F.sort_array(F.collect_set(F.concat(F.lit("D"), (F.col("conv_id") + F.col("turn") * 3).cast("string")))).alias("surface_ids"))
    audit = audit.select("question_id", "surface_ids", F.slice("surface_ids", 1, 1).alias("open_ids"), F.array(F.concat(F.lit("d"), F.col("question_id").cast("string"))).alias("cited_ids"))
    texts = conv.groupBy(F.col("conv_id").alias("question_id")).agg(F.min_by("text", "turn").alias("question"), F.max_by("text", "turn").alias("answer"))
    catalog = _t(spark, d, "documents").select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("docid"), F.array_join(F.slice(F.split("text", r"\s+"), 1, 8), " ").alias("title"))
    return B.selector_candidates(audit, texts, texts, catalog, 4).select("question_id", "rank", "docid", "score")


def selector_prompts(spark, d):
    rows = _t(spark, d, "benchmark")
    items = F.array(F.struct(F.lit("a").alias("docid"), F.lit("T").alias("title")), F.struct(F.lit("b").alias("docid"), F.lit("").alias("title")))
    return rows.select("item_id", F.sha2(B.selector_prompt(F.col("text"), F.lit("yes"), items).cast("binary"), 256).alias("digest"))


def fanout_scores(spark, d):
    """Atoms are words of a passage and one that it lacks; the answer is the passage in capitals, with other punctuation."""
    rows = _t(spark, d, "benchmark").withColumn("w", F.split("text", " "))
    atoms = rows.select(F.col("item_id").alias("question_id"), F.explode(F.array(F.get("w", F.lit(0)), simple_upper(F.get("w", F.lit(3))), F.when(F.col("item_id") % 3 == 0, "1,204 zz").otherwise(F.get("w", F.lit(5))))).alias("value"))
    answers = rows.where("item_id % 8 <> 7").select(F.col("item_id").alias("question_id"), F.concat(simple_upper(F.col("text")), F.when(F.col("item_id") % 6 == 0, " -- 1204 ZZ!").otherwise("")).alias("answer"))
    return B.fanout_scores(atoms, answers)


_LOOSE = r"' ' || trim(regexp_replace(regexp_replace(regexp_replace(lower({}), '(\d),(\d)', '\1\2', 'g'), '[^\pL\pN\s]+', ' ', 'g'), '\s+', ' ', 'g')) || ' '"


def fenced_json(spark, d):
    rows = _t(spark, d, "events").select("event_id", F.when(F.col("event_id") % 10 == 0, "no object").otherwise(F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n``` done"))).alias("text"))
    return rows.select("event_id", B.tolerant_json(F.col("text"), "k long")["k"].alias("k"))


QUERIES = {
    "enterprise_corpus": (enterprise_corpus, """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders)
SELECT 'doc-' || o_custkey || CASE WHEN k > 1 THEN '__dup' || k ELSE '' END AS docid, 'doc-' || o_custkey AS raw_id, CASE WHEN o_orderkey % 4 <> 0 THEN 'Order of ' || o_custkey || chr(10) || chr(10) ELSE '' END || o_orderpriority AS text, lower(o_orderstatus) AS source_type FROM o"""),
    "expected_documents": (expected_documents, """WITH n AS (SELECT o_custkey AS p, count(*) AS n FROM orders GROUP BY 1), a AS (SELECT o_orderkey AS question_id, unnest([o_custkey % 40, o_custkey % 30, o_custkey % 40, 9999999]) AS p, unnest([0, 1, 2, 3]) AS position FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY question_id, p ORDER BY position) AS k FROM a)
SELECT question_id, position, CASE WHEN n >= k THEN 'doc-' || p || CASE WHEN k > 1 THEN '__dup' || k ELSE '' END END AS docid FROM k LEFT JOIN n USING (p)"""),
    "wiki_passages": (wiki_passages, f"WITH {_S}, p AS (SELECT 'Town ' || item_id AS title, array_to_string(s, ' ') AS text FROM s UNION ALL SELECT 'River ' || item_id, array_to_string(list_reverse(s), ' ') FROM s) SELECT DISTINCT 'W2' || substr(sha256(title || chr(0) || text), 1, 24) AS docid, title, text FROM p"),
    "wiki_supporting": (wiki_supporting, f"WITH {_S} SELECT item_id AS question_id, 'Town ' || item_id AS title, 0 AS sentence_id, s[1] AS sentence FROM s UNION ALL SELECT item_id, 'River ' || item_id, 1, list_reverse(s)[2] FROM s UNION ALL SELECT item_id, 'River ' || item_id, 99, NULL FROM s"),
    "world_documents": (world_documents, "WITH t AS (SELECT p_size % 5 AS world, p_partkey, p_name AS title, p_type || chr(10) || p_brand || chr(10) || p_size AS text FROM part) SELECT world::INT AS world, format('PW{:03d}{:05d}', world, p_partkey) || substr(sha256(title || chr(0) || text), 1, 12) AS docid, title, text FROM t"),
    "answerable_questions": (answerable_questions, "SELECT o_custkey, count(*)::INT AS n_answers FROM orders GROUP BY 1 HAVING count(*) BETWEEN 1 AND 10"),
    "namespaced_text": (namespaced_text, "SELECT p_partkey, p_brand || ' (W3) and ' || p_type || ' (W3) and ' || p_brand || ' (W3)' AS text FROM part"),
    "json_leaves": (json_leaves, "SELECT event_id, '$/a/0' AS path, user_id::VARCHAR AS value FROM events UNION ALL SELECT event_id, '$/a/1/b', event_type FROM events UNION ALL SELECT event_id, '$/p/k', props::JSON ->> 'k' FROM events"),
    "frozen_evaluation": (frozen_evaluation, f"WITH {_FROZEN} SELECT question_id, question_type, answer_correct, completeness_pct, CASE WHEN question_id % 17 = 0 THEN 50 ELSE document_recall_pct END AS document_recall_pct, CASE WHEN question_id % 17 = 0 THEN 2 ELSE invalid_extra_docs END AS invalid_extra_docs FROM f"),
    "frozen_breakdowns": (frozen_breakdowns, f"""WITH {_FROZEN}, g AS (SELECT 'all' AS dimension, '' AS name, * FROM f UNION ALL SELECT 'type', coalesce(question_type, 'unknown'), * FROM f UNION ALL SELECT 'source', unnest(source_types), * FROM f)
SELECT dimension, name, count(*) AS count, round(avg(100 * answer_correct::INT), 2) AS correctness, round(avg(completeness_pct), 2) AS completeness, round(avg(CASE WHEN answer_correct THEN completeness_pct ELSE 0 END), 2) AS overall, round(avg(document_recall_pct), 2) AS document_recall, round(avg(invalid_extra_docs), 2) AS invalid_extra FROM g GROUP BY 1, 2"""),
    "unequal_ids": (unequal_ids, "WITH a AS (SELECT DISTINCT o_custkey AS k, 0 AS t FROM orders UNION ALL SELECT DISTINCT c_custkey, 1 FROM customer UNION ALL SELECT DISTINCT s_suppkey, 2 FROM supplier) SELECT k AS question_id, count(*) AS tables FROM a GROUP BY 1 HAVING count(*) < 3"),
    "selector_candidates": (selector_candidates, r"""WITH t AS (SELECT conv_id AS question_id, list_distinct(regexp_extract_all(lower(arg_min(text, turn)), '[a-z0-9]{3,}')) AS q, list_distinct(regexp_extract_all(lower(arg_max(text, turn)), '[a-z0-9]{3,}')) AS a FROM conversations GROUP BY 1),
f AS (SELECT DISTINCT conv_id AS question_id, 'd' || (conv_id + turn * 3) AS docid FROM conversations UNION SELECT DISTINCT conv_id, 'd' || conv_id FROM conversations),
c AS (SELECT 'd' || doc_id AS docid, list_distinct(regexp_extract_all(lower(array_to_string(regexp_split_to_array(text, '\s+')[1:8], ' ')), '[a-z0-9]{3,}')) AS w FROM documents),
s AS (SELECT question_id, docid, round(coalesce(len(list_intersect(w, a)), 0) + 0.4 * coalesce(len(list_intersect(w, q)), 0) + CASE WHEN docid = 'd' || question_id THEN 3 ELSE 0 END, 6) AS score FROM f JOIN t USING (question_id) LEFT JOIN c USING (docid)),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, docid DESC) AS rank FROM s) SELECT question_id, rank::INT AS rank, docid, score::DOUBLE AS score FROM r WHERE rank <= 4"""),
    "selector_prompts": (selector_prompts, "SELECT item_id, sha256('Question:' || chr(10) || text || chr(10) || chr(10) || 'Final answer:' || chr(10) || 'yes' || chr(10) || chr(10) || 'Candidate documents surfaced or opened by the frozen trajectory:' || chr(10) || '- a | T' || chr(10) || '- b | [title unavailable]') AS digest FROM benchmark"),
    "fanout_scores": (fanout_scores, f"""WITH w AS (SELECT item_id, text, string_split(text, ' ') AS w FROM benchmark), a AS (SELECT item_id, unnest([w[1], upper(w[4]), CASE WHEN item_id % 3 = 0 THEN '1,204 zz' ELSE w[6] END]) AS value, CASE WHEN item_id % 8 <> 7 THEN upper(text) || CASE WHEN item_id % 6 = 0 THEN ' -- 1204 ZZ!' ELSE '' END ELSE '' END AS answer FROM w)
SELECT item_id AS question_id, round(avg(contains({_LOOSE.format('answer')}, {_LOOSE.format('value')})::INT), 6) AS loose, bool_and(contains({_LOOSE.format('answer')}, {_LOOSE.format('value')}))::DOUBLE AS strict FROM a GROUP BY 1"""),
    "fenced_json": (fenced_json, "SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN (props::JSON ->> 'k')::BIGINT END AS k FROM events"),
}
