"""Registry of the engine's named queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Decorator: file a query under ``name``, with its DuckDB oracle if there is one."""

    def add(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = oracle
        return fn

    return add


def _load() -> None:
    from . import pool_queries, set_queries, text_queries, verdict_queries  # noqa: F401


def queries() -> dict[str, Query]:
    """All registered queries."""
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """All registered oracles."""
    _load()
    return dict(_ORACLES)
