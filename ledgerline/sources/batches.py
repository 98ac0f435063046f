"""Import batches derived from the test tables (FIXTURES.md section 3).

The test data has no CSV files, so the import operators are exercised on text
batches that Spark derives from the orders: every order with an odd key becomes
one text row of an import (with planted defects at fixed key residues), and
the ledger it is imported into holds the orders with even keys. All orders are
used -- the parity splits the table into "existing" and "incoming", it does not
sample it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.schema import Ledger
from ledgerline.sources.testdata import ADMIN_UID, ledger_from_testdata, read_table

IMPORTER_UID = ADMIN_UID


def base_ledger(spark: SparkSession, sf_dir: str, full: Ledger | None = None) -> Ledger:
    """The mapped ledger restricted to even expense / group-expense keys."""
    full = full or ledger_from_testdata(spark, sf_dir)
    even = lambda c: (F.col(c) % 2) == 0
    return full.with_tables(
        expenses=full.expenses.filter(even("eid")),
        expenses_tags=full.expenses_tags.filter(even("eid")),
        group_expenses=full.group_expenses.filter(even("geid")),
        split_users=full.split_users.filter(even("geid")),
        group_expense_tags=full.group_expense_tags.filter(even("geid")))


def _k(m: int):
    return (F.col("k") % m) == 0


def _amount_text():
    return (F.when(_k(17), "abc").when(_k(19), "-5").when(_k(23), "")
            .otherwise(F.col("o_totalprice").cast("string")))


def _date_text():
    d = F.to_date("o_orderdate")
    unpadded = F.concat_ws("-", F.year(d).cast("string"), F.month(d).cast("string"),
                           F.dayofmonth(d).cast("string"))
    return (F.when(_k(29), "2024-02-30").when(_k(31), unpadded)
            .otherwise(F.date_format(d, "yyyy-MM-dd")))


def _order_tags(spark: SparkSession, sf_dir: str, sep: str, full: Ledger | None = None) -> DataFrame:
    full = full or ledger_from_testdata(spark, sf_dir)
    return (full.expenses_tags.join(full.tags, "tid").groupBy("eid")
            .agg(F.expr(f"listagg(tag_name, '{sep}') WITHIN GROUP (ORDER BY tag_name)").alias("tag_text"))
            .withColumnRenamed("eid", "k"))


def personal_batch(spark: SparkSession, sf_dir: str, full: Ledger | None = None) -> DataFrame:
    """Text rows of a personal import: seq, uid (actor) and the six CSV columns."""
    orders = read_table(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey").cast("long"))
    odd = orders.filter((F.col("k") % 2) == 1).join(_order_tags(spark, sf_dir, ",", full), "k", "left")
    return odd.select(
        F.col("k").alias("seq"),
        F.col("o_custkey").cast("long").alias("uid"),
        _amount_text().alias("amount"),
        F.when(_k(37), "unknown")
         .when(_k(3), F.concat(F.lit("  "), F.upper("o_orderpriority"), F.lit(" ")))
         .otherwise(F.col("o_orderpriority")).alias("category"),
        F.when(_k(41), "cheque").otherwise(F.col("o_orderstatus")).alias("payment_method"),
        _date_text().alias("date"),
        F.concat(F.lit("order "), F.col("k").cast("string")).alias("description"),
        F.when(_k(43), "Brand#1").when(_k(47), "brand#1,brand#1")
         .otherwise(F.coalesce("tag_text", F.lit(""))).alias("tag"))


def group_batch(spark: SparkSession, sf_dir: str, full: Ledger | None = None) -> DataFrame:
    """Text rows of group imports (one per odd group expense), importer = uid 0 (Admin)."""
    full = full or ledger_from_testdata(spark, sf_dir)
    orders = read_table(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey").cast("long"))
    ge = full.group_expenses.filter((F.col("geid") % 2) == 1).select(F.col("geid").alias("k"), "gid", "uid")
    # the importer's name: a scalar subquery over its primary-key row
    importer = full.users.filter(F.col("uid") == IMPORTER_UID).agg(F.max("username")).scalar()
    names = (full.split_users.filter((F.col("geid") % 2) == 1)
             .join(full.users.select("uid", "username"), "uid")
             .groupBy(F.col("geid").alias("k"))
             .agg(F.sort_array(F.collect_list("username")).alias("names")))
    rows = (orders.join(ge, "k")
            .join(full.groups.select("gid", "group_name"), "gid")
            .join(full.users.select(F.col("uid"), F.col("username").alias("creator")), "uid")
            .join(names, "k")
            .withColumn("importer", importer)
            .join(_order_tags(spark, sf_dir, ", ", full), "k", "left"))
    base = F.filter("names", lambda n: n != F.col("importer"))
    with_importer = F.array_sort(F.array_union(base, F.array(F.col("importer"))))
    names_col = (F.when(_k(53), F.array().cast("array<string>"))
                 .when(_k(47), F.concat(F.col("names"), F.slice("names", 1, 1)))
                 .when(_k(43), F.array_sort(F.concat(F.col("names"), F.array(F.lit("nobody")))))
                 .when(_k(5), base)
                 .otherwise(with_importer))
    rows = rows.withColumn("nl", names_col)
    share = (F.col("o_totalprice") / F.greatest(F.size("nl"), F.lit(1))).cast("string")
    shares = F.transform("nl", lambda n: share)
    amounts = (F.when(_k(11), F.slice(shares, 2, F.size(shares)))
               .when(_k(13), F.transform(shares, lambda x, i: F.when(i == 0, F.lit("x")).otherwise(x)))
               .when(_k(7), F.transform(shares, lambda x, i: F.when(
                   i == 0, (x.cast("double") - 5).cast("string")).otherwise(x)))
               .otherwise(shares))
    return rows.select(
        F.col("k").alias("seq"),
        F.col("group_name"),
        F.lit("1995-01-01").alias("date_created"),
        F.lit("").alias("description"),
        F.col("k").cast("string").alias("expense_id"),
        F.when(_k(31), "nobody").otherwise(F.col("creator")).alias("creator_username"),
        _amount_text().alias("amount"),
        F.when(_k(37), "new category").otherwise(F.col("o_orderpriority")).alias("category_name"),
        F.when(_k(41), "cheque").otherwise(F.col("o_orderstatus")).alias("payment_method"),
        _date_text().alias("expense_date"),
        F.concat(F.lit("order "), F.col("k").cast("string")).alias("expense_description"),
        F.coalesce("tag_text", F.lit("")).alias("tags"),
        F.array_join("nl", ", ").alias("split_usernames"),
        F.array_join(amounts, ", ").alias("split_amounts"))
