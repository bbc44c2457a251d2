"""Queries by name, each with its SQL twin where SQL can express it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES = ("q_events", "q_calendars", "q_presence", "q_models", "q_population", "q_reports", "q_learning", "q_tables", "q_search", "q_evaluation")

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function of (spark, sf_dir), with the SQL that gives the same rows."""

    def put(function: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = function
        if sql is not None:
            _ORACLES[name] = sql
        return function

    return put


def oracle_of(name: str) -> str:
    """The SQL of a query that is registered already, for queries built on it."""
    return _ORACLES[name]


def _load() -> None:
    """Import the query modules; each registers its queries once."""
    for name in MODULES:
        importlib.import_module(f"ebbtide.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
