"""Named queries of the engine and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
#: Modules with QUERIES: name to (query, SQL or None).
GROUPS = ("retrieval", "graphs", "documents", "streams", "answers", "rooms")


def _all() -> dict[str, tuple[Query, str | None]]:
    found: dict = {}
    for group in GROUPS:
        found |= import_module(f"docquarry.plans.{group}").QUERIES
    return found


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
