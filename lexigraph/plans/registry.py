"""Registry of the engine's own queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Decorator that files a query, with its SQL where there is one."""

    def file(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = oracle
        return fn

    return file


def _filled() -> None:
    from lexigraph.plans import library  # noqa: F401  (files its queries as it is imported)


def queries() -> dict[str, Query]:
    _filled()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _filled()
    return dict(_ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    _filled()
    return _QUERIES["analyze_documents"](spark, sf_dir)
