"""Queries over trajectories and frozen benchmark records, with their oracles.

Conversations stand in for trajectories: a user turn is input, another one a tool's output about
one document; spans are taken from the turns, some of them for another document or without a quote.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import trajectories
from tessera.plans.text_queries import _t


def _events(spark, d):
    c = _t(spark, d, "conversations")
    docid = F.expr("cast((conv_id * 31 + turn) % 150 as string)")
    opens = F.expr("turn % 3 <> 0")
    said = F.when(opens, F.concat(F.lit("# D"), docid, F.lit(" opened\n"))).otherwise(F.concat(F.lit("see D"), docid, F.lit(".\n")))
    return c.select(
        F.col("conv_id").alias("query_id"), F.col("turn").alias("seq"), F.when(F.col("role") == "user", "input").otherwise("tool").alias("type"), "role",
        F.when(opens, "open").otherwise("search").alias("name"), F.concat(said, "text").alias("content"),
        F.when(opens, F.concat(F.lit("D"), docid)).otherwise("").alias("handle"), F.expr("turn % 7 = 5").alias("is_error"),
    )


def _slots(spark, d):
    ids = _t(spark, d, "conversations").select(F.col("conv_id").alias("query_id")).distinct()
    return ids.select("query_id", F.explode(F.array(*map(F.lit, ("s0", "s1", "s2")))).alias("slot_id")).withColumn("required", F.expr("case when slot_id = 's2' and query_id % 3 = 0 then false when slot_id = 's1' then true end"))


def _spans(spark, d):
    return _t(spark, d, "conversations").select(
        F.col("conv_id").alias("query_id"), F.concat(F.lit("p"), F.col("turn").cast("string")).alias("span_id"),
        F.expr("cast((conv_id * 31 + turn + if(turn % 4 = 3, 1, 0)) % 150 as string)").alias("docid"),
        F.expr("array(concat('s', cast(turn % 3 as string)), concat('s', cast(turn % 2 as string)))").alias("slot_ids"),
        F.expr("if(turn % 5 = 4, ' ', substring(text, 11, 30))").alias("quote"))


def _corpus(spark, d):
    return _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("docid"))


def _evaluated(spark, d):
    return trajectories.evaluate_trajectories(_events(spark, d), _slots(spark, d), _spans(spark, d), _corpus(spark, d))


_EVENTS = r"""c AS (SELECT conv_id AS query_id, turn AS seq, role, text, ((conv_id * 31 + turn) % 150)::VARCHAR AS doc, turn % 3 <> 0 AS opens, turn % 7 = 5 AS failed FROM conversations),
ev AS (SELECT query_id, seq, CASE WHEN role = 'user' THEN 'input' ELSE 'tool' END AS type, role, opens, CASE WHEN opens THEN '# D' || doc || ' opened' || chr(10) ELSE 'see D' || doc || '.' || chr(10) END || text AS content, doc, failed FROM c),
named AS (SELECT *, list_distinct(list_transform(regexp_extract_all(content, '(^|[^\pL\pN_])D([^\s\t|:;,\]\[()]+)', 2), lambda x: regexp_replace(x, '\.+$', ''))) AS found FROM ev),
shown AS (SELECT query_id, seq, content, unnest(list_distinct(list_concat(found, [doc]))) AS docid FROM named WHERE type = 'tool' AND opens AND NOT failed),
surf AS (SELECT DISTINCT query_id, unnest(found) AS docid FROM named WHERE (type = 'input' AND role = 'user') OR (type = 'tool' AND NOT failed)),
sl AS (SELECT DISTINCT conv_id AS query_id, unnest(['s0', 's1', 's2']) AS slot_id FROM conversations),
req AS (SELECT * FROM sl WHERE NOT (slot_id = 's2' AND query_id % 3 = 0)),
sp AS (SELECT conv_id AS query_id, 'p' || turn AS span_id, ((conv_id * 31 + turn + CASE WHEN turn % 4 = 3 THEN 1 ELSE 0 END) % 150)::VARCHAR AS docid, unnest(list_distinct(['s' || (turn % 3), 's' || (turn % 2)])) AS slot_id, substr(text, 11, 30) AS quote FROM conversations WHERE turn % 5 <> 4 AND trim(substr(text, 11, 30)) <> ''),
model AS (SELECT req.query_id, req.slot_id, sp.docid, sp.span_id, sp.quote FROM req LEFT JOIN sp USING (query_id, slot_id))"""
_SEE = r"""trim(regexp_replace(translate(lower(regexp_replace(regexp_replace({}, '(?m)^[ \t]*\d{{1,8}}[ \t]*[\t|:][ \t]*', '', 'g'), '(?m)^[ \t]*=+[ \t]*D[^:\n]+:[ \t]*', '', 'g')), '“”‘’–—', '""''''--'), '\s+', ' ', 'g'))"""
_JUDGED = f"""{_EVENTS},
loc AS (SELECT DISTINCT s.query_id, m.slot_id, s.seq, s.docid FROM shown s JOIN model m ON s.query_id = m.query_id AND s.docid = m.docid WHERE contains({_SEE.format('s.content')}, {_SEE.format('m.quote')})),
sup AS (SELECT DISTINCT query_id, slot_id, docid FROM model),
reach AS (SELECT p.query_id, p.slot_id, count(p.docid) > 0 AS supported, coalesce(bool_or(p.docid IN (SELECT doc_id::VARCHAR FROM documents)), false) AS corpus,
  coalesce(bool_or(s.docid IS NOT NULL), false) AS surface, coalesce(bool_or(o.docid IS NOT NULL), false) AS open
  FROM sup p LEFT JOIN surf s ON s.query_id = p.query_id AND s.docid = p.docid LEFT JOIN (SELECT DISTINCT query_id, docid FROM shown) o ON o.query_id = p.query_id AND o.docid = p.docid GROUP BY 1, 2),
bear AS (SELECT s.query_id, count(*) AS n FROM (SELECT DISTINCT query_id, seq, docid FROM shown) s JOIN (SELECT DISTINCT query_id, docid FROM sup) p USING (query_id, docid) GROUP BY 1),
rel AS (SELECT query_id, count(*) AS n FROM (SELECT DISTINCT query_id, seq, docid FROM loc) GROUP BY 1),
e AS (SELECT r.query_id, count(*) AS n_slots, count(*) FILTER (corpus) AS constructed, count(*) FILTER (surface) AS surfaced, count(*) FILTER (open) AS opened,
  count(*) FILTER ((r.query_id, r.slot_id) IN (SELECT query_id, slot_id FROM loc)) AS located, bool_and(supported) AS reference_complete FROM reach r GROUP BY 1),
j AS (SELECT e.*, coalesce(b.n, 0)::BIGINT AS support_fragments, coalesce(r.n, 0)::BIGINT AS relevant_fragments FROM e LEFT JOIN bear b USING (query_id) LEFT JOIN rel r USING (query_id))"""


def trajectory_slots(spark, d):
    return trajectories.slot_model(_slots(spark, d), _spans(spark, d)).select("query_id", "slot_id", "docid", "span_id")


def trajectory_evaluation(spark, d):
    return _evaluated(spark, d).withColumn("fragment_precision", F.round("fragment_precision", 6))


def trajectory_funnel(spark, d):
    out = trajectories.funnel(_evaluated(spark, d))
    return out.withColumns({c: F.round(c, 6) for c in ("any_share", "mean_share", "all_share", "micro_recall", "conversion")})


def _stage(s, before, k):
    return f"""SELECT {k} AS position, '{s}' AS stage, round(100 * avg(({s} > 0)::INT), 6) AS any_share, round(100 * avg({s} / n_slots), 6) AS mean_share, round(100 * avg(({s} >= n_slots)::INT), 6) AS all_share,
round(sum({s}) / sum(n_slots), 6) AS micro_recall, round(sum({s}) / nullif(sum({before}), 0), 6) AS conversion FROM j"""


def evaluated_suite(spark, d):
    """Queries with relevance, a run and a judgment, summarised by whether evidence was located."""
    runs = _t(spark, d, "conversations").groupBy(F.col("conv_id").alias("query_id")).agg(F.max("turn").alias("turns"))
    judged = _t(spark, d, "labels").select(F.col("doc_id").alias("query_id"), (F.col("quality") == 1).alias("is_correct"), (F.col("doc_id") / 1000.0).alias("cost"))
    rows = trajectories.joined_evaluation(_slots(spark, d), runs, judged).join(_evaluated(spark, d).select("query_id", (F.col("located") > 0).alias("found")), "query_id")
    return trajectories.auxiliary_summary(rows, ["found"])


def surfaced_documents(spark, d):
    return trajectories.surfaced(_events(spark, d))


def run_predictions(spark, d):
    answers = _t(spark, d, "conversations").where("role = 'user'").groupBy(F.col("conv_id").alias("query_id")).agg(F.max_by("text", "turn").alias("answer"))
    out = trajectories.predictions(answers, _events(spark, d).withColumn("handle", F.when(F.expr("seq % 4 = 1"), F.concat("handle", F.lit("__dup2"))).otherwise(F.col("handle")))
                                   .withColumn("content", F.when(F.expr("seq % 4 = 1"), F.regexp_replace("content", " opened", "__dup2 opened")).otherwise(F.col("content"))))
    return out.select("query_id", F.length("answer").alias("n_answer"), F.array_join("document_ids", ",").alias("document_ids"), F.array_join("opened_ids", ",").alias("opened_ids"))


def retrieved_documents(spark, d):
    """Lists as answers write them: numbered, bulleted, quoted, with folders and repeats."""
    rows = _t(spark, d, "benchmark")
    text = F.concat(F.col("text"), F.lit("\n\nRelevant Documents:\n1. docs/D"), F.col("item_id").cast("string"), F.lit(".txt\n- `D"), (F.col("item_id") + 1).cast("string"), F.lit(".txt`\n* 'note-"), (F.col("item_id") % 3).cast("string"), F.lit("'\n2. docs/D"), F.col("item_id").cast("string"), F.lit(".txt\n"))
    text = F.when(F.col("item_id") % 5 == 0, F.col("text")).otherwise(text)
    return rows.select("item_id", F.array_join(trajectories.retrieved_list(text), "|").alias("retrieved"))


def _manifest(spark, d):
    docs = _t(spark, d, "labels").select(F.col("doc_id").alias("query_id"), "quality", "toxic")
    rows = docs.crossJoin(F.broadcast(spark.createDataFrame([("turn", 15.0), ("turn", 60.0), ("cost", 2.75)], "kind string, value double")))  # three boundaries
    rows = rows.where("not (kind = 'cost' and toxic = 1)")
    return rows.select("query_id", "kind", "value", F.expr("case when quality = 1 then 'terminated' when toxic = 1 then 'branched' end").alias("disposition"), F.expr("kind = 'turn' and value = 60 and quality = 0 and toxic = 1").alias("reads_gold"))


def checkpoint_manifest(spark, d):
    endpoint = _t(spark, d, "labels").select(F.col("doc_id").alias("query_id"))
    return trajectories.checkpoint_manifest(_manifest(spark, d), endpoint)


def suite_manifest(spark, d):
    runs = _t(spark, d, "labels").select(F.col("doc_id").alias("query_id"), F.expr("case when toxic = 0 then true when quality = 1 then false end").alias("terminal_valid"), (F.col("doc_id") / 100.0).alias("cost"))
    return trajectories.suite_manifest(runs)


def expected_cells(spark, d):
    """Regional account balances stand in for cells; expected ones are rounded, shifted or missing."""
    seen = _t(spark, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.avg("c_acctbal").alias("accuracy"), F.count("*").cast("double").alias("cost"))
    expected = seen.select("c_mktsegment", (F.col("c_nationkey") + F.when(F.col("c_nationkey") % 6 == 5, 100).otherwise(0)).alias("c_nationkey"),
                           F.round(F.col("accuracy"), 2).alias("accuracy"), F.when(F.col("c_nationkey") % 4 != 0, F.col("cost") + F.when(F.col("c_nationkey") % 4 == 1, 0.01).otherwise(0.0)).alias("cost"))
    return trajectories.expected_cells(expected, seen, ["c_mktsegment", "c_nationkey"], {"accuracy": 2, "cost": 3})


def package_differences(spark, d):
    orders, customers = _t(spark, d, "orders"), _t(spark, d, "customer")
    return trajectories.set_differences(orders.select(F.col("o_orderkey").alias("k")), customers.select((F.col("c_custkey") * 30).alias("k")), "k").groupBy("side").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


def auxiliary_summary(spark, d):
    rows = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id").select("lang", "source", (F.col("quality") == 1).alias("is_correct"), (F.col("n_chars") / 1000.0).alias("cost"), (F.col("n_chars") % 40).alias("turns"))
    return trajectories.auxiliary_summary(rows, ["lang", "source"])


QUERIES = {
    "trajectory_slots": (trajectory_slots, f"WITH {_EVENTS} SELECT query_id, slot_id, docid, span_id FROM model"),
    "trajectory_evaluation": (trajectory_evaluation, f"WITH {_JUDGED} SELECT *, round(relevant_fragments / nullif(support_fragments, 0), 6) AS fragment_precision FROM j"),
    "trajectory_funnel": (trajectory_funnel, f"WITH {_JUDGED} " + " UNION ALL ".join(_stage(s, b, k) for k, (s, b) in enumerate(zip(("constructed", "surfaced", "opened", "located"), ("n_slots", "constructed", "surfaced", "opened"))))),
    "evaluated_suite": (evaluated_suite, f"""WITH {_JUDGED} SELECT located > 0 AS found, count(*) AS questions, count(*) FILTER (l.quality = 1) AS correct, round(100 * avg((l.quality = 1)::INT), 2) AS accuracy,
round(sum(l.doc_id / 1000.0::DOUBLE), 6) AS cost, sum(t.turns)::BIGINT AS turns FROM j JOIN labels l ON l.doc_id = j.query_id JOIN (SELECT conv_id, max(turn) AS turns FROM conversations GROUP BY 1) t ON t.conv_id = j.query_id GROUP BY 1"""),
    "surfaced_documents": (surfaced_documents, f"WITH {_EVENTS} SELECT query_id, docid FROM surf"),
    "run_predictions": (run_predictions, f"""WITH {_EVENTS}, a AS (SELECT conv_id AS query_id, arg_max(text, turn) AS answer FROM conversations WHERE role = 'user' GROUP BY 1),
o AS (SELECT query_id, docid, min(seq) AS seq FROM (SELECT query_id, seq, doc || CASE WHEN seq % 4 = 1 THEN '__dup2' ELSE '' END AS docid FROM named WHERE type = 'tool' AND opens AND NOT failed) GROUP BY 1, 2),
p AS (SELECT query_id, split_part(docid, '__dup', 1) AS docid, min(seq) AS seq FROM o GROUP BY 1, 2)
SELECT a.query_id, length(trim(answer)) AS n_answer, coalesce((SELECT string_agg(docid, ',' ORDER BY seq) FROM p WHERE p.query_id = a.query_id), '') AS document_ids, coalesce((SELECT string_agg(docid, ',' ORDER BY seq) FROM o WHERE o.query_id = a.query_id), '') AS opened_ids FROM a"""),
    "retrieved_documents": (retrieved_documents, "SELECT item_id, CASE WHEN item_id % 5 = 0 THEN '' ELSE item_id || '|' || (item_id + 1) || '|note-' || (item_id % 3) END AS retrieved FROM benchmark"),
    "checkpoint_manifest": (checkpoint_manifest, """WITH b AS (SELECT * FROM (VALUES ('turn', 15.0::DOUBLE), ('turn', 60.0::DOUBLE), ('cost', 2.75::DOUBLE)) t(kind, value)),
m AS (SELECT doc_id AS query_id, kind, value, CASE WHEN quality = 1 THEN 'terminated' WHEN toxic = 1 THEN 'branched' ELSE 'unknown' END AS disposition, kind = 'turn' AND value = 60 AND quality = 0 AND toxic = 1 AS gold FROM labels, b WHERE NOT (kind = 'cost' AND toxic = 1)),
g AS (SELECT kind, value, string_agg(disposition || '=' || n, ',' ORDER BY disposition || '=' || n) AS dispositions FROM (SELECT kind, value, disposition, count(*) AS n FROM m GROUP BY ALL) GROUP BY 1, 2)
SELECT kind, value, count(*) AS n_rows, count(DISTINCT query_id) AS n_queries, NOT bool_or(gold) AS blind, any_value(dispositions) AS dispositions, (SELECT count(DISTINCT doc_id) FROM labels) - count(DISTINCT query_id) AS n_missing, 0::BIGINT AS n_foreign,
count(*) = (SELECT count(DISTINCT doc_id) FROM labels) AND count(*) = count(DISTINCT query_id) AND NOT bool_or(gold) AS valid FROM m JOIN g USING (kind, value) GROUP BY 1, 2"""),
    "suite_manifest": (suite_manifest, "SELECT count(*) AS queries, count(*) FILTER (toxic = 0) AS completed, count(*) FILTER (toxic IS DISTINCT FROM 0) AS invalid, round(sum(doc_id / 100.0::DOUBLE), 6) AS cost FROM labels"),
    "expected_cells": (expected_cells, "SELECT c_mktsegment, (c_nationkey + CASE WHEN c_nationkey % 6 = 5 THEN 100 ELSE 0 END)::INT AS c_nationkey, c_nationkey % 6 <> 5 AS accuracy_match, c_nationkey % 4 = 0 OR (c_nationkey % 4 <> 1 AND c_nationkey % 6 <> 5) AS cost_match FROM (SELECT DISTINCT c_mktsegment, c_nationkey FROM customer)"),
    "package_differences": (package_differences, "WITH a AS (SELECT DISTINCT o_orderkey AS k FROM orders), b AS (SELECT DISTINCT c_custkey * 30 AS k FROM customer) SELECT 'missing' AS side, count(*) AS n, sum(k)::BIGINT AS total FROM a ANTI JOIN b USING (k) UNION ALL SELECT 'unexpected', count(*), sum(k)::BIGINT FROM b ANTI JOIN a USING (k)"),
    "auxiliary_summary": (auxiliary_summary, "SELECT lang, source, count(*) AS questions, count(*) FILTER (quality = 1) AS correct, round(100 * avg((quality = 1)::INT), 2) AS accuracy, round(sum(n_chars / 1000.0::DOUBLE), 6) AS cost, sum(n_chars % 40)::BIGINT AS turns FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2"),
}
