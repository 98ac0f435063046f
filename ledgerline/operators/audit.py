"""Constraint audit C1-C5: what the ledger's declared constraints would reject.

Spark enforces no NOT NULL / UNIQUE / CHECK / FOREIGN KEY constraint on parquet
tables, so the audit reports them as data: one row per
(table_name, constraint_name, violations). Every check is a filter, a grouped
count (partial aggregation, so a hot key costs nothing extra) or an anti join;
results of all tables are unioned into one small frame.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.money import exact_sum
from ledgerline.schema import (FOREIGN_KEYS, PRIMARY_KEYS, SCHEMAS, UNIQUE_KEYS, Ledger,
                               check_constraints)

SPLIT_TOLERANCE = 0.01


def _row(table: str, name: str, df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit(table).alias("table_name"), F.lit(name).alias("constraint_name"), "violations")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _null_rules(table: str) -> list[tuple[str, Column]]:
    return [(f"not_null:{f.name}", F.col(f.name).isNull()) for f in SCHEMAS[table] if not f.nullable]


def _check_rules(table: str) -> list[tuple[str, Column]]:
    return [(f"check:{name}", ~cond) for name, cond in check_constraints().get(table, [])]


def _broken(ledger: Ledger, *families) -> DataFrame:
    """Rows that break a rule of a row, per rule: all rules of a table are counted in one pass over it."""
    out = []
    for table in SCHEMAS:
        rules = [r for family in families for r in family(table)]
        if rules:
            counts = ledger.table(table).agg(*[F.count(F.when(bad, 1)).alias(name) for name, bad in rules])
            out.append(counts.select(F.inline(F.array(*[
                F.struct(F.lit(table).alias("table_name"), F.lit(name).alias("constraint_name"),
                         F.col(f"`{name}`").alias("violations")) for name, _ in rules]))))
    return _union(out)


def not_null(ledger: Ledger) -> DataFrame:
    """Rows with NULL in a NOT NULL column, per column."""
    return _broken(ledger, _null_rules)


def unique(ledger: Ledger) -> DataFrame:
    """Rows sharing a primary-key or unique value with another row."""
    out = []
    keys = [(t, k, "pk") for t, k in PRIMARY_KEYS.items()] + [(t, k, "unique") for t, k in UNIQUE_KEYS.items()]
    for table, key, kind in keys:
        dup = (ledger.table(table).groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
               .filter("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations")))
        out.append(dup.select(F.lit(table).alias("table_name"),
                              F.lit(f"{kind}:{','.join(key)}").alias("constraint_name"),
                              F.col("violations").cast("long").alias("violations")))
    return _union(out)


def check(ledger: Ledger) -> DataFrame:
    """Rows breaking a CHECK (role set, lower-case names, non-negative amounts)."""
    return _broken(ledger, _check_rules)


def foreign_keys(ledger: Ledger) -> DataFrame:
    """C4: rows whose reference finds no parent row (orphans), per reference.

    Child keys are counted per key first (map-side partial aggregation), so a key
    held by a third of the rows is one row before it meets the parent keys.
    """
    out = []
    for table, col, parent, pcol in FOREIGN_KEYS:
        child = (ledger.table(table).filter(F.col(col).isNotNull())
                 .groupBy(F.col(col).alias("k")).agg(F.count(F.lit(1)).alias("n")))
        keys = ledger.table(parent).select(F.col(pcol).alias("k"))
        orphans = child.join(keys, "k", "left_anti")
        out.append(orphans.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("violations")).select(
            F.lit(table).alias("table_name"), F.lit(f"fk:{col}->{parent}.{pcol}").alias("constraint_name"),
            "violations"))
    return _union(out)


def split_balance(ledger: Ledger) -> DataFrame:
    """Group expenses whose shares do not add up to the amount (within 0.01).

    Expenses without any share count as unbalanced (their share sum is 0).
    """
    sums = (ledger.split_users.groupBy("geid")
            .agg(exact_sum("split_amount").alias("shares")))
    bad = (ledger.group_expenses.select("geid", "amount").join(sums, "geid", "left")
           .filter(F.abs(F.coalesce("shares", F.lit(0.0)) - F.col("amount")) > SPLIT_TOLERANCE))
    return _row("split_users", "balance:sum(split_amount)=amount", bad)


def audit(ledger: Ledger) -> DataFrame:
    """All checks in one frame; C1 and C3 share one pass over each table."""
    return _union([_broken(ledger, _null_rules, _check_rules), unique(ledger), foreign_keys(ledger),
                   split_balance(ledger)])
