"""Evaluation of search runs: endpoints, intervals, checkpoints, paired outcomes, graded retrieval, ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numbers import wilson


def endpoint_summary(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Quality and recorded cost of rows (query_id, is_correct, terminal_valid, turn_count, agent_cost, judge_cost), in total or by columns."""
    out = rows.groupBy(*(by or [])).agg(
        F.count("*").alias("total"),
        F.count_if(F.coalesce("is_correct", F.lit(False))).alias("correct"),
        F.sum(F.coalesce("agent_cost", F.lit(0.0))).alias("agent_cost"),
        F.sum(F.coalesce("judge_cost", F.lit(0.0))).alias("judge_cost"),
        F.sum(F.coalesce("turn_count", F.lit(0))).alias("turns"),
        F.count_if(~F.coalesce("terminal_valid", F.lit(True))).alias("terminal_invalid"),
    )
    low, high = wilson(F.col("correct"), F.col("total"))
    return out.withColumn("accuracy", F.col("correct") / F.nullif(F.col("total"), F.lit(0))).withColumn("lower", low).withColumn("upper", high)


def comparable_cost(summary: DataFrame, agent_currency: str | None, judge_currency: str | None, components: tuple[str, ...] = ("agent", "judge")) -> DataFrame:
    """summary with the cost of the components, which must have one currency."""
    currencies = {"agent": agent_currency, "judge": judge_currency}
    unknown = sorted(set(components) - set(currencies))
    if unknown:
        raise ValueError(f"unknown cost components: {unknown}")
    if len({currencies[c] for c in components if currencies[c]}) > 1:
        raise ValueError("the components have different currencies")
    total = F.lit(0.0)
    for c in components:
        total = total + F.col(f"{c}_cost")
    return summary.withColumn("comparable_cost", total)


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once or are empty: a table that must be empty."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(key).isNull() | (F.col(key).cast("string") == ""))


def checkpoints(rows: DataFrame, boundaries: list[float], measure: str) -> DataFrame:
    """For each boundary: rows completed up to it, correct ones among them, and their share of all rows; unfinished rows are wrong.

    The boundaries are a short list, so each row is counted for all of them in one pass.
    """
    counted = rows.agg(
        F.count("*").alias("total"),
        *(F.count_if(F.col(measure) <= b).alias(f"done{k}") for k, b in enumerate(boundaries)),
        *(F.count_if((F.col(measure) <= b) & F.coalesce("is_correct", F.lit(False))).alias(f"right{k}") for k, b in enumerate(boundaries)),
    )
    each = F.array(*(F.struct(F.lit(float(b)).alias("boundary"), F.col(f"done{k}").alias("completed"), F.col(f"right{k}").alias("correct")) for k, b in enumerate(boundaries)))
    out = counted.select("total", F.explode(each).alias("b")).select("b.*", "total")
    return out.withColumn("accuracy", F.col("correct") / F.nullif(F.col("total"), F.lit(0)))


def paired_outcomes(left: DataFrame, right: DataFrame, key: str = "query_id") -> DataFrame:
    """The 2 x 2 table of two runs' outcomes, and how many keys only one of them has."""
    both = left.select(key, F.col("is_correct").alias("a")).join(right.select(key, F.col("is_correct").alias("b")), key, "full_outer")
    return both.agg(
        F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(F.col("a") & ~F.col("b")).alias("left_only"),
        F.count_if(~F.col("a") & F.col("b")).alias("right_only"), F.count_if(~F.col("a") & ~F.col("b")).alias("neither"),
        F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("unpaired"),
    )


def graded_retrieval(ranks: DataFrame, grades: DataFrame) -> DataFrame:
    """(query_id, ndcg_at_10, recall_at_10, recall_at_100) of ranks (query_id, doc_id, rank from 1) and grades (query_id, doc_id, grade > 0).

    Linear gain over log2(rank + 1); queries of grades without ranks have 0.
    """
    grades = grades.where("grade > 0")
    hit = grades.join(ranks, ["query_id", "doc_id"], "left")
    order = Window.partitionBy("query_id").orderBy(F.col("grade").desc(), "doc_id")
    hit = hit.withColumn("best", F.row_number().over(order))
    gain = lambda rank: F.sum(F.when(F.col(rank) <= 10, F.col("grade") / F.log2(F.col(rank) + 1.0)).otherwise(0.0))
    out = hit.groupBy("query_id").agg(
        gain("rank").alias("dcg"), gain("best").alias("ideal"), F.count("*").alias("n"),
        F.count_if(F.col("rank") <= 10).alias("n10"), F.count_if(F.col("rank") <= 100).alias("n100"),
    )
    return out.select("query_id", (F.col("dcg") / F.col("ideal")).alias("ndcg_at_10"), (F.col("n10") / F.col("n")).alias("recall_at_10"), (F.col("n100") / F.col("n")).alias("recall_at_100"))


def running_cost(events: DataFrame, key: str, order: list[str], cost: str) -> DataFrame:
    """events with turn, their number from 1, and running, the cost up to and with them; nulls in order come last.

    Costs that are doubles with at most twelve decimal places are added up exactly, so a sum that comes to a budget reaches
    it. From the first other one on (NaN, infinite, very large, more places) a key's doubles are added up as they are.
    """
    w = Window.partitionBy(key).orderBy(*(F.col(c).asc_nulls_last() for c in order))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    running = F.sum(cost).over(upto)
    if events.schema[cost].dataType.simpleString() == "double":
        exact = F.col(cost).try_cast("decimal(28,12)")
        other = F.bool_or(~exact.cast("double").eqNullSafe(F.col(cost))).over(upto)
        running = F.when(other, running).otherwise(F.sum(exact).over(upto).cast("double"))
    return events.withColumn("turn", F.row_number().over(w)).withColumn("running", running)


def budget_trigger(turns: DataFrame, key: str, threshold: float, fallback_turn: int) -> DataFrame:
    """(key, turn): the first turn whose running cost reaches the threshold or that is the fallback turn or later."""
    return turns.where((F.col("running") >= threshold) | (F.col("turn") >= fallback_turn)).groupBy(key).agg(F.min("turn").alias("turn"))


def lead_ledger(sightings: DataFrame) -> DataFrame:
    """The state of each lead (query_id, handle) from sightings (query_id, handle, sequence, rank, source, action).

    action is seen, opened or dismissed; opened absorbs all others. sources are the last six
    distinct ones in the order of their last sightings.
    """
    last = sightings.groupBy("query_id", "handle", "source").agg(F.max("sequence").alias("at"))
    sources = last.groupBy("query_id", "handle").agg(F.sort_array(F.collect_list(F.struct("at", "source"))).alias("s"))
    sources = sources.select("query_id", "handle", F.transform(F.slice(F.reverse("s"), 1, 6), lambda x: x["source"]).alias("sources"))
    state = sightings.groupBy("query_id", "handle").agg(
        F.min("rank").alias("best_rank"), F.min("sequence").alias("first_sequence"), F.max("sequence").alias("last_sequence"), F.count("*").alias("sightings"),
        F.when(F.bool_or(F.col("action") == "opened"), "opened").when(F.bool_or(F.col("action") == "dismissed"), "dismissed").otherwise("unresolved").alias("status"),
    )
    return state.join(sources, ["query_id", "handle"])


def evidence_funnel(rows: DataFrame) -> DataFrame:
    """(stage, any_blind, mean_blind, all_blind, micro_recall) of rows (query_id, stage, n_slots, n_seen); shares of queries in percent.

    any_blind: no slot seen; all_blind: not every slot; mean_blind: the mean share of slots not seen.
    """
    rows = rows.where("n_slots > 0")
    return rows.groupBy("stage").agg(
        (100 * F.avg((F.col("n_seen") == 0).cast("double"))).alias("any_blind"),
        (100 * F.avg(1 - F.col("n_seen") / F.col("n_slots"))).alias("mean_blind"),
        (100 * F.avg((F.col("n_seen") < F.col("n_slots")).cast("double"))).alias("all_blind"),
        (F.sum("n_seen") / F.sum("n_slots")).alias("micro_recall"),
    )
