"""Join building blocks shared by the reports.

Dimension joins are plain equi-joins: the planner broadcasts a dimension when
its measured size (file statistics, or AQE's runtime statistics) is under the
broadcast threshold and falls back to a sort-merge join when it is not. No
dimension is force-broadcast, so nothing whose size grows with the data is
shipped to every executor unchecked.

Tag lists are aggregated per expense *before* they meet the expenses, so the
fact never fans out to one row per tag.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.schema import Ledger


def with_dims(facts: DataFrame, ledger: Ledger) -> DataFrame:
    """Add category_name and method (inner joins, as the reference)."""
    return (facts.join(ledger.categories, "cid")
            .join(ledger.payment_methods, "pid"))


def tag_rows(ledger: Ledger, group: bool = False) -> DataFrame:
    """(eid|geid, tag_name) pairs: the bridge joined to tag names."""
    bridge = ledger.group_expense_tags if group else ledger.expenses_tags
    return bridge.join(ledger.tags, "tid")


def tag_lists(ledger: Ledger, sep: str = ", ", group: bool = False,
              distinct: bool = False, tag: str | None = None) -> DataFrame:
    """One row per expense with its tag names joined in name order.

    ``tag`` keeps only that tag (the personal tag filter narrows the list).
    """
    key = "geid" if group else "eid"
    rows = tag_rows(ledger, group)
    if tag is not None:
        rows = rows.filter(F.col("tag_name") == F.lit(tag.lower()))
    return rows.groupBy(key).agg(ordered_listagg("tag_name", sep, distinct).alias("tags"))


def ordered_listagg(col: str, sep: str, distinct: bool):
    """listagg(col, sep) WITHIN GROUP (ORDER BY col) as an expression."""
    d = "DISTINCT " if distinct else ""
    return F.expr(f"listagg({d}{col}, '{sep}') WITHIN GROUP (ORDER BY {col})")


def with_tags(facts: DataFrame, ledger: Ledger, sep: str = ", ", group: bool = False,
              distinct: bool = False, tag: str | None = None) -> DataFrame:
    """Left join of the per-expense tag list; untagged expenses get NULL.

    With ``tag`` the join is inner (the filter on the joined tag row drops
    expenses without that tag) and the list holds only that tag.
    """
    key = "geid" if group else "eid"
    lists = tag_lists(ledger, sep, group, distinct, tag)
    return facts.join(lists, key, "inner" if tag is not None else "left")


def group_id_of(ledger: Ledger, group_name: str | None) -> DataFrame | None:
    """gid(s) of a group name (None = no restriction)."""
    if group_name is None:
        return None
    return ledger.groups.filter(F.col("group_name") == F.lit(group_name)).select("gid")


def in_group(facts: DataFrame, ledger: Ledger, group_name: str | None) -> DataFrame:
    gids = group_id_of(ledger, group_name)
    return facts if gids is None else facts.join(gids, "gid", "left_semi")
