"""Registered queries of the array engine: name -> (DataFrame query, SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query function under ``name``, with its SQL if there is one."""

    def add(fn):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return add


def _load() -> None:
    """Import the modules that register queries."""
    import importlib
    import pkgutil

    import framelake.plans as plans

    for found in pkgutil.iter_modules(plans.__path__):
        if found.name.startswith("q_"):
            importlib.import_module(f"framelake.plans.{found.name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
