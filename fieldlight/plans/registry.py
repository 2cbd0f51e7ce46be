"""All registered queries of the library itself, with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None = None) -> None:
    if name in _QUERIES:
        raise ValueError(f"{name} is registered twice")
    _QUERIES[name] = query
    if sql is not None:
        _SQL[name] = sql


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers the decorated function under a name."""

    def add(f: Query) -> Query:
        register(name, f, sql)
        return f

    return add


def _load() -> None:
    from . import q_contracts, q_evaluation, q_geometry, q_joins, q_relations, q_scalars, q_sources, q_streams, q_vectors  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
