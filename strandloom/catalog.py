"""All registered queries of the genomics operators with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandloom.plans import dataset_queries, graph_queries, pileup_queries, variant_queries
from strandloom.plans.fixtures import Tables

MODULES = (pileup_queries, graph_queries, variant_queries, dataset_queries)


def _on_tables(query: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(Tables(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _on_tables(query) for module in MODULES for name, (query, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: oracle for module in MODULES for name, (_, oracle) in module.QUERIES.items() if oracle}
