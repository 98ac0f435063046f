"""Expense filters (P2-P11) as Column predicates over the joined expense rows.

A filter set is a dict ``{key: value}`` with keys ``category``, ``payment_method``,
``min_amount``, ``max_amount``, ``amount`` (``"lo-hi"``), ``date`` and ``tag``;
``-`` in keys is read as ``_``. Unknown keys raise (the reference silently
ignores them). Every predicate is a plain Column, so Catalyst pushes the amount
and date parts into the parquet scan.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.schema import MONTH

PERSONAL_KEYS = ("category", "payment_method", "min_amount", "max_amount", "amount", "date", "tag")
GROUP_KEYS = ("category", "min_amount", "max_amount", "amount", "date", "tag")


def normalise(filters: dict | None, allowed=PERSONAL_KEYS) -> dict:
    """Key normalisation and the ``amount=lo-hi`` split."""
    out: dict = {}
    for key, value in (filters or {}).items():
        key = key.replace("-", "_")
        if key not in allowed:
            raise ValueError(f"unknown filter {key!r}; allowed: {', '.join(allowed)}")
        if key == "amount":
            text = str(value)
            if "-" not in text:
                raise ValueError("amount range must be 'min-max'")
            lo, hi = text.split("-", 1)
            out["min_amount"], out["max_amount"] = float(lo), float(hi)
        elif key in ("min_amount", "max_amount"):
            out[key] = float(value)
        elif key == "date":
            out[key] = value if isinstance(value, _dt.date) else _dt.date.fromisoformat(str(value))
        else:
            out[key] = str(value)
    return out


def user_scope(uid: int | None) -> Column:
    """One user, or everybody when ``uid`` is None."""
    return F.lit(True) if uid is None else (F.col("uid") == F.lit(uid))


def fact_predicate(f: dict) -> Column:
    """Predicates on the fact row itself (amount, date): pushed into the scan."""
    cond = F.lit(True)
    if "min_amount" in f:
        cond = cond & (F.col("amount") >= F.lit(f["min_amount"]))
    if "max_amount" in f:
        cond = cond & (F.col("amount") <= F.lit(f["max_amount"]))
    if "date" in f:
        cond = cond & (F.col("date") == F.lit(f["date"]))
    return cond


def in_months(facts: DataFrame, start: _dt.date | None, end: _dt.date | None = None) -> DataFrame:
    """Stored facts restricted to the month folders from ``start`` to ``end``; other frames as they are."""
    if start is None or MONTH not in facts.columns:
        return facts
    facts = facts.filter(F.col(MONTH) >= F.lit(start.replace(day=1)))
    return facts if end is None else facts.filter(F.col(MONTH) <= F.lit(end.replace(day=1)))


def filtered_facts(facts: DataFrame, f: dict) -> DataFrame:
    """Rows that meet the amount and date parts, read from the date's month only."""
    return in_months(facts, f.get("date"), f.get("date")).filter(fact_predicate(f))


def category_predicate(f: dict) -> Column:
    """Category name equals the lower-cased value (the group form lower-cases both)."""
    if "category" not in f:
        return F.lit(True)
    return F.lower(F.col("category_name")) == F.lit(f["category"].lower())


def method_predicate(f: dict) -> Column:
    """Stored method equals the lower-cased value exactly."""
    if "payment_method" not in f:
        return F.lit(True)
    return F.col("method") == F.lit(f["payment_method"].lower())


def _date(d) -> _dt.date:
    return d if isinstance(d, _dt.date) else _dt.date.fromisoformat(str(d))


def date_range(facts: DataFrame, start, end) -> DataFrame:
    """Rows in an inclusive date range; start after end is an error."""
    start, end = _date(start), _date(end)
    if start > end:
        raise ValueError("start date must not be after end date")
    return in_months(facts, start, end).filter(F.col("date").between(F.lit(start), F.lit(end)))
