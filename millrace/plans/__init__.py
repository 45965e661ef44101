"""Registered queries and their SQL, by module: items, decisions, texts, batches, statistics, flows, rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | Callable[[], str] | None = None):
    """Register a query under its function's name, with the SQL of the same result (or a function that gives it)."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    """Rounded to six places, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def _load() -> None:
    from . import batches, decisions, flows, items, rules, stats, texts  # noqa: F401


def queries() -> dict[str, Callable]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: v if isinstance(v, str) else v() for k, v in SQL.items()}
