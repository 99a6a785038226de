"""All queries of the catalogue with the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

PARTS = ("pipe_queries", "operator_queries", "parser_queries", "flow_queries")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict = {}
    for part in PARTS:
        out |= import_module(f"logweave.catalog.{part}").queries()
    return out


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for part in PARTS:
        out |= import_module(f"logweave.catalog.{part}").oracle_sql()
    return out
