"""Search trajectories against evidence: what was constructed, surfaced, opened and located, and what a run opened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import handles, visible


def slot_model(slots: DataFrame, spans: DataFrame) -> DataFrame:
    """(query_id, slot_id, docid, span_id, quote): the valid spans of required slots.

    slots (query_id, slot_id, required; null counts as required), spans (query_id, span_id, docid,
    slot_ids array, quote). A required slot without a valid span has one row with null docid.
    """
    required = slots.where(F.coalesce("required", F.lit(True))).select("query_id", "slot_id").distinct()
    valid = spans.where("docid <> '' and trim(quote) <> ''").select("query_id", "span_id", "docid", "quote", F.explode(F.array_distinct("slot_ids")).alias("slot_id"))
    return required.join(valid, ["query_id", "slot_id"], "left")


def fragments(events: DataFrame) -> DataFrame:
    """(query_id, seq, docid, output): what each successful open showed, for each document that it names.

    events: query_id, seq, type, role, name, content, handle, is_error. A document is named by a
    handle in the output or by the call's own handle.
    """
    opened = events.where("type = 'tool' and name = 'open' and not coalesce(is_error, false)")
    own = F.when(F.col("handle").startswith("D"), F.array(F.expr("substring(handle, 2)"))).otherwise(F.array().cast("array<string>"))
    named = F.array_distinct(F.concat(handles(F.col("content")), own))
    return opened.select("query_id", "seq", F.explode(named).alias("docid"), F.col("content").alias("output"))


def surfaced(events: DataFrame) -> DataFrame:
    """(query_id, docid): documents whose handles stand in user input or in the output of a tool that didn't fail."""
    shown = events.where("(type = 'input' and role = 'user') or (type = 'tool' and not coalesce(is_error, false))")
    return shown.select("query_id", F.explode(handles(F.col("content"))).alias("docid")).distinct()


def evaluate_trajectories(events: DataFrame, slots: DataFrame, spans: DataFrame, corpus: DataFrame) -> DataFrame:
    """One row per query of slots: how many required slots each stage reaches, and how many opened fragments bear evidence.

    Columns: n_slots, constructed, surfaced, opened, located, reference_complete, support_fragments,
    relevant_fragments, fragment_precision (null without support fragments). A stage reaches a slot
    through any document of its valid spans; a slot is located if a span's quote is visible in an
    opened fragment of its document. Queries without events have zeros.
    """
    model = slot_model(slots, spans)
    shown = fragments(events)
    support = model.select("query_id", "slot_id", "docid").distinct()
    mark = lambda seen, name: seen.select(*[c for c in ("query_id", "docid") if c in seen.columns]).distinct().withColumn(name, F.lit(True))
    reached = (
        support.join(mark(corpus, "in_corpus"), "docid", "left").join(mark(surfaced(events), "in_surface"), ["query_id", "docid"], "left")
        .join(mark(shown, "in_open"), ["query_id", "docid"], "left")
    )
    located = shown.join(model.where("docid is not null"), ["query_id", "docid"]).where(F.contains(visible(F.col("output")), visible(F.col("quote"))))
    located = located.select("query_id", "slot_id", "seq", "docid").distinct()
    found = located.select("query_id", "slot_id").distinct().withColumn("is_located", F.lit(True))
    slot = reached.groupBy("query_id", "slot_id").agg(
        *(F.coalesce(F.bool_or(f"in_{x}"), F.lit(False)).alias(x) for x in ("corpus", "surface", "open")), (F.count("docid") > 0).alias("supported"))
    slot = slot.join(found, ["query_id", "slot_id"], "left")
    out = slot.groupBy("query_id").agg(
        F.count("*").alias("n_slots"), F.count_if("corpus").alias("constructed"), F.count_if("surface").alias("surfaced"), F.count_if("open").alias("opened"),
        F.count("is_located").alias("located"), F.bool_and("supported").alias("reference_complete"),
    )
    bearing = shown.select("query_id", "seq", "docid").join(support.select("query_id", "docid").distinct(), ["query_id", "docid"])
    bearing = bearing.groupBy("query_id").agg(F.count("*").alias("support_fragments"))
    relevant = located.select("query_id", "seq", "docid").distinct().groupBy("query_id").agg(F.count("*").alias("relevant_fragments"))
    out = out.join(bearing, "query_id", "left").join(relevant, "query_id", "left").na.fill(0, ["support_fragments", "relevant_fragments"])
    return out.withColumn("fragment_precision", F.col("relevant_fragments") / F.nullif(F.col("support_fragments"), F.lit(0)))


def funnel(rows: DataFrame) -> DataFrame:
    """(stage, any_share, mean_share, all_share, micro_recall, conversion) of evaluate_trajectories' rows.

    Shares are in percent of all queries; conversion is the stage's slots over the stage's before.
    """
    stages = ("constructed", "surfaced", "opened", "located")
    sums = rows.agg(
        F.count("*").alias("n"), F.sum("n_slots").alias("slots"), *(F.sum(s).alias(f"sum_{s}") for s in stages),
        *(F.avg((F.col(s) > 0).cast("double")).alias(f"any_{s}") for s in stages),
        *(F.avg(F.coalesce(F.col(s) / F.nullif(F.col("n_slots"), F.lit(0)), F.lit(0.0))).alias(f"mean_{s}") for s in stages),
        *(F.avg(((F.col(s) >= F.col("n_slots")) & (F.col("n_slots") > 0)).cast("double")).alias(f"all_{s}") for s in stages),
    )
    before = ("slots", *(f"sum_{s}" for s in stages))
    rows = F.array(*(F.struct(
        F.lit(k).alias("position"), F.lit(s).alias("stage"), (100 * F.col(f"any_{s}")).alias("any_share"), (100 * F.col(f"mean_{s}")).alias("mean_share"),
        (100 * F.col(f"all_{s}")).alias("all_share"), (F.col(f"sum_{s}") / F.nullif(F.col("slots"), F.lit(0))).alias("micro_recall"),
        (F.col(f"sum_{s}") / F.nullif(F.col(before[k]), F.lit(0))).alias("conversion"),
    ) for k, s in enumerate(stages)))
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def joined_evaluation(qrels: DataFrame, runs: DataFrame, judged: DataFrame) -> DataFrame:
    """Queries that have relevance, a run and a judgment, with all their columns; a missing one leaves the query out."""
    return qrels.select("query_id").distinct().join(runs, "query_id").join(judged, "query_id")


def checkpoint_manifest(manifest: DataFrame, endpoint: DataFrame) -> DataFrame:
    """(kind, value, n_rows, n_queries, dispositions, n_missing, n_foreign, blind, valid) of manifest rows.

    manifest: query_id, kind, value, disposition, reads_gold. Every query of endpoint must occur
    exactly once at each boundary, and no selection may have read outcomes.
    """
    known = endpoint.select("query_id").distinct().withColumn("known", F.lit(True))
    total = known.agg(F.count("*").alias("total"))
    rows = manifest.join(known, "query_id", "left")
    counts = rows.groupBy("kind", "value", F.coalesce("disposition", F.lit("unknown")).alias("disposition")).agg(F.count("*").alias("n"))
    shares = counts.groupBy("kind", "value").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "disposition", F.col("n").cast("string")))), ",").alias("dispositions"))
    out = rows.groupBy("kind", "value").agg(
        F.count("*").alias("n_rows"), F.count_distinct("query_id").alias("n_queries"), F.count_distinct(F.when(F.col("known"), F.col("query_id"))).alias("n_known"),
        (~F.coalesce(F.bool_or(F.col("reads_gold")), F.lit(False))).alias("blind"),
    )
    out = out.join(shares, ["kind", "value"]).crossJoin(F.broadcast(total))  # one row
    out = out.withColumn("n_missing", F.col("total") - F.col("n_known")).withColumn("n_foreign", F.col("n_queries") - F.col("n_known"))
    valid = (F.col("n_rows") == F.col("total")) & (F.col("n_queries") == F.col("n_rows")) & (F.col("n_missing") == 0) & (F.col("n_foreign") == 0) & F.col("blind")
    return out.withColumn("valid", valid).drop("n_known", "total")


def opened_documents(events: DataFrame) -> DataFrame:
    """(query_id, docid, seq): documents truly opened, at their first opening: a successful open whose output says so."""
    tool = events.where("type = 'tool' and name = 'open' and not coalesce(is_error, false)")
    said = F.regexp_extract(F.col("content"), r"(?i)#\s+(\S+)\s+opened\b", 1)
    tool = tool.where((F.col("handle") != "") & (F.lower(said) == F.lower("handle")))
    docid = F.when(F.col("handle").startswith("D"), F.expr("substring(handle, 2)")).otherwise(F.col("handle"))
    return tool.select("query_id", docid.alias("docid"), "seq").where("docid <> ''").groupBy("query_id", "docid").agg(F.min("seq").alias("seq"))


def predictions(answers: DataFrame, events: DataFrame) -> DataFrame:
    """(query_id, answer, document_ids, opened_ids): trimmed answers and ids in the order of opening; __dup marks are cut off."""
    opened = opened_documents(events).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "docid"))), lambda x: x["docid"]).alias("opened_ids"))
    out = answers.join(opened, "query_id", "left").withColumn("opened_ids", F.coalesce("opened_ids", F.array().cast("array<string>")))
    plain = F.array_distinct(F.transform("opened_ids", lambda x: F.substring_index(x, "__dup", 1)))
    return out.select("query_id", F.trim(F.coalesce("answer", F.lit(""))).alias("answer"), plain.alias("document_ids"), "opened_ids")


def retrieved_list(text: Column) -> Column:
    """Document ids of a text's "Relevant Documents" section: its lines without numbers, bullets, quotes, docs/ and D....txt."""
    body = F.regexp_extract(F.replace(text, F.lit("\\n"), F.lit("\n")), r"(?is)relevant documents:?\s*\n(.*)\z", 1)
    strip = lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"^\s*(?:\d+\.|[-*])\s*", "")), "^[`'\"]+|[`'\"]+$", "")
    bare = lambda x: F.regexp_replace(F.regexp_replace(strip(x), r"^docs/", ""), r"^D(.*)\.txt$", "$1")
    return F.array_distinct(F.filter(F.transform(F.split(body, "\n"), bare), lambda x: x != ""))


def suite_manifest(runs: DataFrame) -> DataFrame:
    """One row: completed and invalid runs and their cost; runs (query_id, terminal_valid, cost)."""
    return runs.agg(
        F.count("*").alias("queries"), F.count_if(F.coalesce("terminal_valid", F.lit(False))).alias("completed"),
        F.count_if(~F.coalesce("terminal_valid", F.lit(False))).alias("invalid"), F.round(F.sum(F.coalesce("cost", F.lit(0.0))), 6).alias("cost"),
    )


def expected_cells(expected: DataFrame, observed: DataFrame, keys: list[str], places: dict[str, int]) -> DataFrame:
    """expected's keys, with <measure>_match for each measure: equal after rounding; a missing expected value matches, a missing observed one doesn't."""
    seen = observed.select(*keys, *(F.col(m).alias(f"_{m}") for m in places))
    same = [F.coalesce(F.col(m).isNull() | (F.round(f"_{m}", n) == F.round(m, n)), F.lit(False)).alias(f"{m}_match") for m, n in places.items()]
    return expected.join(seen, keys, "left").select(*keys, *same)


def set_differences(declared: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that are only declared or only actual; empty if the sets are equal."""
    only = lambda a, b, side: a.select(key).distinct().join(b.select(key), key, "left_anti").withColumn("side", F.lit(side))
    return only(declared, actual, "missing").unionByName(only(actual, declared, "unexpected"))


def auxiliary_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts, correct ones, accuracy, cost and turns by columns, of rows (is_correct, cost, turns)."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("questions"), F.count_if("is_correct").alias("correct"), F.round(100 * F.avg(F.col("is_correct").cast("double")), 2).alias("accuracy"),
        F.round(F.sum("cost"), 6).alias("cost"), F.sum("turns").alias("turns"),
    )

