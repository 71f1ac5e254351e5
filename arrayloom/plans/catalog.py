"""The query catalogue: name -> (query, oracle SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    """Register a query under its function's name."""

    def register(f: Query) -> Query:
        key = name or f.__name__
        if key in _QUERIES:
            raise ValueError(f"query {key} is registered twice")
        _QUERIES[key] = f
        if oracle is not None:
            _ORACLES[key] = oracle
        return f

    return register


def _load() -> None:
    from arrayloom.plans import (  # noqa: F401
        q_elementwise,
        q_functions,
        q_linalg,
        q_reduce,
        q_transforms,
        q_views,
    )


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _ORACLES
