"""Queries over the driver's tables, and the SQL that their results are held against.

A query is registered under the survey's row of its operator (``j2_``, ``a23_``, ...). Each reads
the given tables through ``adapters``, which maps them to traces by the same expressions in
Spark and in SQL. Queries whose operator SQL cannot express have no SQL; tests cover them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, and its SQL if there is any."""

    def keep(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return keep


def sql_of(name: str) -> str:
    """The SQL of a query that is registered already."""
    return _SQL[name]


def queries() -> dict[str, Query]:
    from . import catalog, catalog_sources  # noqa: F401  they register on import

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import catalog, catalog_sources  # noqa: F401

    return dict(_SQL)
