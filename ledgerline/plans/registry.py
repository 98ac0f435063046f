"""Registry of named queries: a Spark builder and, when SQL can say it, a DuckDB oracle.

Builders take ``(spark, sf_dir)`` and return a DataFrame computed from the test
tables (through the ledger mapping) -- their work grows with the tables. Oracle
texts are prefixed with the same mapping as SQL CTEs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerline.plans.oracle_views import with_ledger

Builder = Callable[[SparkSession, str], DataFrame]

_BUILDERS: dict[str, Builder] = {}
_ORACLES: dict[str, str] = {}


def register(key: str, sql: str | None = None, extra_ctes: dict[str, str] | None = None):
    """Decorator: register ``fn(spark, sf_dir)`` under ``key`` with its oracle SQL."""

    def deco(fn: Builder) -> Builder:
        if key in _BUILDERS:
            raise KeyError(f"duplicate query key {key}")
        _BUILDERS[key] = fn
        if sql is not None:
            _ORACLES[key] = with_ledger(sql, extra_ctes)
        return fn

    return deco


def builders() -> dict[str, Builder]:
    _load()
    return dict(_BUILDERS)


def oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


def _load() -> None:
    # importing the catalogue modules fills the registry
    from ledgerline.plans import catalog, catalog_changes, catalog_loads  # noqa: F401
