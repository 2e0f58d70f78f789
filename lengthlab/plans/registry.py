"""Collects the registered queries of every module: name -> (Spark query, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES: tuple[str, ...] = ("statistics", "preprocessing", "planning", "reading", "catalog", "streams")

Query = Callable[[SparkSession, str], DataFrame]


def _entries() -> dict[str, tuple[Query, str | None]]:
    found: dict[str, tuple[Query, str | None]] = {}
    for module in MODULES:
        entries = import_module(f"lengthlab.plans.{module}").ENTRIES
        clash = found.keys() & entries.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        found |= entries
    return found


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _entries().items()}


def oracles() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _entries().items() if sql}
