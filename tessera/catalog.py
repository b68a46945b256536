"""All queries of the engine outside the training-data subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import benchmark_queries, router_queries, table_queries, text_queries, trajectory_queries

_ALL = text_queries.QUERIES | table_queries.QUERIES | trajectory_queries.QUERIES | benchmark_queries.QUERIES | router_queries.QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused rankings of every benchmark passage over the whole corpus."""
    return table_queries.whole_fusion(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracles() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
