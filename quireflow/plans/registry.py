"""Registered queries of the library and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("overlap_queries", "style_queries", "history_queries", "web_queries", "scoring_queries", "reference_queries", "ailang_queries", "marker_queries", "report_queries", "file_queries")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in import_module(f"{__package__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(f"{__package__}.{m}").ORACLE_SQL.items()}
