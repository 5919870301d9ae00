"""Registry of the queries that demonstrate each operator, with their DuckDB oracles."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codestrata.session import scratch as scratch  # noqa: PLC0414  (queries take it from here)

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name."""

    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _oracles[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _load() -> None:
    for m in ("assembly_queries", "source_queries", "vector_queries", "text_queries", "structure_queries", "graph_queries", "review_queries", "declaration_queries", "storage_queries", "helper_queries", "enrichment_queries"):
        importlib.import_module(f"codestrata.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracles)
