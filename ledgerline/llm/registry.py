"""Queries of the training-data operators and, where SQL can say them, their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        if key in _QUERIES:
            raise KeyError(f"duplicate query key {key}")
        _QUERIES[key] = fn
        if sql is not None:
            _ORACLES[key] = sql
        return fn
    return deco


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from ledgerline.llm import queries as _q  # noqa: F401  fills the registry

    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    queries()
    return dict(_ORACLES)
