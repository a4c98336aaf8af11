"""Every registered query of the engine, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from thermoline.plans import model_queries, region_queries, series_queries, suite_queries, vision_queries

_TABLES = (series_queries.TABLE, suite_queries.TABLE, vision_queries.TABLE, model_queries.TABLE, region_queries.TABLE)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for t in _TABLES for name, (f, _) in t.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for t in _TABLES for name, (_, sql) in t.items() if sql}
