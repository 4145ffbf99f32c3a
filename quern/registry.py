"""Named queries of the engine and, for each, the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "quarterly_program_summary"

_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Adds a query under a name, with its SQL where SQL can say it."""

    def add(query: Query) -> Query:
        if name in _queries:
            raise ValueError(f"{name} is registered twice")
        _queries[name] = query
        if sql:
            _oracles[name] = sql
        return query

    return add


def queries() -> dict[str, Query]:
    import quern.plans  # noqa: F401  registers them

    return _queries


def oracles() -> dict[str, str]:
    queries()
    return _oracles
