"""Registered queries over the shared tables and their SQL counterparts."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the DuckDB SQL that has the same rows."""

    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def _load() -> None:
    """Import the modules whose functions register themselves."""
    for name in ("search_queries", "catalog_queries", "store_queries", "text_queries"):
        importlib.import_module(f"{__package__}.{name}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 top documents of the benchmark passages."""
    _load()
    return _QUERIES["bm25_topk"](spark, sf_dir)


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
