"""All registered queries and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("rank_queries", "group_queries", "inference_queries", "label_queries", "change_queries", "model_queries", "stream_queries", "reader_queries", "report_queries", "cache_queries")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in import_module(f"hornbeam.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(f"hornbeam.plans.{m}").SQL.items()}
