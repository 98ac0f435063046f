"""Reading physical plans: what a query will shuffle, broadcast and push into its scans.

These read ``DataFrame.explain`` output only (no Spark internals) and are what
the plan checks of the test suite assert on.
"""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.sql import DataFrame

# operators a ledger query must not contain: pair-emitting joins and per-row Python
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "MapInPandas")


def explain_text(df: DataFrame, mode: str = "formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode=mode)
    return buf.getvalue()


def forbidden_operators(df: DataFrame) -> list[str]:
    plan = explain_text(df)
    return [op for op in FORBIDDEN if op in plan]


def pushed_filters(df: DataFrame) -> list[str]:
    """The ``PushedFilters`` list of every file scan."""
    return [m.group(1) for m in re.finditer(r"^PushedFilters: \[(.*)\]$", explain_text(df), re.M)]


def exchanges(df: DataFrame) -> int:
    """Number of shuffle exchanges in the (initial) physical plan."""
    return len(re.findall(r"\bExchange\b", explain_text(df, "simple")))


def broadcast_joins(df: DataFrame) -> int:
    return len(re.findall(r"\bBroadcastHashJoin\b", explain_text(df, "simple")))
