"""Dashboard metrics D1-D9, computed from the tables (per user, or all users at once).

``as_of`` replaces "today" so results are reproducible. Per-user "top" picks
run a row_number over the *aggregated* rows (at most one row per category or
method of a user), never over raw expenses.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.money import exact_sum
from ledgerline.functions.text import month
from ledgerline.operators import filters as P
from ledgerline.operators.joins import with_dims
from ledgerline.schema import Ledger


def _as_date(d) -> _dt.date:
    return d if isinstance(d, _dt.date) else _dt.date.fromisoformat(str(d))


def _month_bounds(as_of) -> tuple[_dt.date, _dt.date]:
    d = _as_date(as_of)
    this_start = d.replace(day=1)
    last_start = (this_start - _dt.timedelta(days=1)).replace(day=1)
    return this_start, last_start


def _top_by_count(ledger: Ledger, uid: int | None, dim_col: str) -> DataFrame:
    """Most used value of ``dim_col`` per user; ties: latest use, then name."""
    rows = with_dims(ledger.expenses.filter(P.user_scope(uid)), ledger)
    counts = rows.groupBy("uid", dim_col).agg(F.count(F.lit(1)).alias("count"),
                                              F.max("date").alias("last_used"))
    w = Window.partitionBy("uid").orderBy(F.desc("count"), F.desc("last_used"), F.asc(dim_col))
    out = counts.withColumn("rn", F.row_number().over(w)).filter("rn = 1")
    cols = [dim_col, "count"] if uid is not None else ["uid", dim_col, "count"]
    return out.select(*cols)


def top_category(ledger: Ledger, uid: int | None = None) -> DataFrame:
    """D1."""
    return _top_by_count(ledger, uid, "category_name")


def top_method(ledger: Ledger, uid: int | None = None) -> DataFrame:
    """D5."""
    return _top_by_count(ledger, uid, "method")


def month_totals(ledger: Ledger, as_of, uid: int | None = None) -> DataFrame:
    """This month's total (no upper bound), last month's, and the percent change."""
    this_start, last_start = _month_bounds(as_of)
    e = ledger.expenses.filter(P.user_scope(uid))
    if uid is not None:  # for all users, those without recent expenses are reported too
        e = P.in_months(e, last_start)
    amt = F.col("amount")
    this_m = F.when(F.col("date") >= F.lit(this_start), amt)
    last_m = F.when((F.col("date") >= F.lit(last_start)) & (F.col("date") < F.lit(this_start)), amt)
    keys = [] if uid is not None else ["uid"]
    out = e.groupBy(*keys).agg(
        F.coalesce(exact_sum(this_m), F.lit(0.0)).alias("this_month"),
        F.coalesce(exact_sum(last_m), F.lit(0.0)).alias("last_month"))
    pct = F.when(F.col("last_month") > 0,
                 (F.col("this_month") - F.col("last_month")) / F.col("last_month") * 100)
    return out.withColumn("pct_change", pct)


def category_totals(ledger: Ledger, uid: int | None = None) -> DataFrame:
    """Spending per category, largest first."""
    keys = ["category_name"] if uid is not None else ["uid", "category_name"]
    return (ledger.expenses.filter(P.user_scope(uid)).join(ledger.categories, "cid")
            .groupBy(*keys).agg(exact_sum("amount").alias("total"))
            .orderBy(*keys[:-1], F.desc("total"), "category_name"))


def monthly_totals(ledger: Ledger, uid: int | None = None) -> DataFrame:
    """Spending per month."""
    keys = ["month"] if uid is not None else ["uid", "month"]
    return (ledger.expenses.filter(P.user_scope(uid)).withColumn("month", month("date"))
            .groupBy(*keys).agg(exact_sum("amount").alias("total")).orderBy(*keys))


def recent(ledger: Ledger, uid: int | None = None, k: int = 5) -> DataFrame:
    """The k most recent expenses (per user), newest first."""
    rows = with_dims(ledger.expenses.filter(P.user_scope(uid)), ledger)
    cols = ["eid", "amount", "category_name", "method", "date", "description"]
    if uid is not None:
        return rows.select(*cols).orderBy(F.desc("date"), F.desc("eid")).limit(k)
    w = Window.partitionBy("uid").orderBy(F.desc("date"), F.desc("eid"))
    return (rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)
            .select("uid", *cols))


def monthly_category_pivot(ledger: Ledger, categories: list[str], uid: int | None = None) -> DataFrame:
    """Month x category totals; one column per given category name."""
    keys = ["month"] if uid is not None else ["uid", "month"]
    amt = F.col("amount")
    return (ledger.expenses.filter(P.user_scope(uid)).join(ledger.categories, "cid")
            .withColumn("month", month("date"))
            .groupBy(*keys).pivot("category_name", categories)
            .agg(exact_sum(amt)))
