"""Map the driver's TPC-H-like test tables onto a ledger (FIXTURES.md section 2).

customer -> users, orders -> expenses (category from the priority, payment method
from the status), part brands -> tags, lineitem -> expense tags, nation -> groups,
and orders with two or more participants (line suppliers + the customer) ->
group expenses split evenly among them.

Everything is lazy DataFrame code: joins and distincts shuffle on their keys and
nothing is collected. Dimensions come out of a ``distinct`` (partial aggregation
map-side, so skewed values cost nothing extra).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.schema import Ledger, conform
from ledgerline.session import staged

# Fixed values of the mapping.
STATUS_TO_PID = {"F": 1, "O": 2, "P": 3}
GROUP_CREATED = _dt.date(1995, 1, 1)
ADMIN_UID = 0
AS_OF = _dt.date(2001, 7, 15)  # dashboard reference date for this data
#: Lines per task of the keyed stages. Key columns shrink to a few bytes a row in a shuffle, so partitions
#: merged by size would hold millions of rows, several times that size in the tasks' sorts and hash tables.
ROWS_PER_TASK = 250_000
MAX_TASKS = 20_000  # beyond that (5 billion lines) tasks take more rows each


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key_partitions(lineitem: DataFrame) -> int:
    """Partitions of the stages that are dealt by order: they grow with the lines (a count of the file footers)."""
    wanted = -(-lineitem.count() // ROWS_PER_TASK)
    return min(max(wanted, lineitem.sparkSession.sparkContext.defaultParallelism), MAX_TASKS)


def _cid(priority):
    return F.substring(priority, 1, 1).cast("long")


def _pid(status):
    expr = None
    for k, v in STATUS_TO_PID.items():
        expr = (F.when(status == k, F.lit(v)) if expr is None else expr.when(status == k, F.lit(v)))
    return expr.cast("long")


def _tid(brand):
    return F.regexp_replace(brand, "^Brand#", "").cast("long")


def _staged(df: DataFrame, name: str) -> DataFrame:
    return staged(df, f"mapped-{name}")


def ledger_from_testdata(spark: SparkSession, sf_dir: str, stage: tuple[str, ...] = ()) -> Ledger:
    """The mapped ledger; it is lazy, so each table is computed again wherever it is read.

    ``stage`` names derived tables that are computed at once and read back, each
    together with what it shares with the others: for callers that read them often.
    """
    def once(df: DataFrame, name: str) -> DataFrame:
        return _staged(df, name) if name in stage else df

    customer = read_table(spark, sf_dir, "customer")
    orders = read_table(spark, sf_dir, "orders")
    part = read_table(spark, sf_dir, "part")
    lineitem = read_table(spark, sf_dir, "lineitem")
    nation = read_table(spark, sf_dir, "nation")

    users = customer.select(
        F.col("c_custkey").cast("long").alias("uid"),
        F.col("c_name").alias("username"),
        F.when(F.col("c_custkey") == ADMIN_UID, "Admin").otherwise("User").alias("role"))

    categories = (orders.select("o_orderpriority").distinct()
                  .select(_cid(F.col("o_orderpriority")).alias("cid"),
                          F.lower("o_orderpriority").alias("category_name")))
    payment_methods = (orders.select("o_orderstatus").distinct()
                       .select(_pid(F.col("o_orderstatus")).alias("pid"),
                               F.lower("o_orderstatus").alias("method")))

    expenses = orders.select(
        F.col("o_orderkey").cast("long").alias("eid"),
        F.col("o_custkey").cast("long").alias("uid"),
        F.col("o_totalprice").cast("double").alias("amount"),
        _cid(F.col("o_orderpriority")).alias("cid"),
        _pid(F.col("o_orderstatus")).alias("pid"),
        F.to_date("o_orderdate").alias("date"),
        F.lit(None).cast("string").alias("description"))

    tags = (part.select("p_brand").distinct()
            .select(_tid(F.col("p_brand")).alias("tid"), F.lower("p_brand").alias("tag_name")))

    n = key_partitions(lineitem)
    order_keys = orders.select(F.col("o_orderkey").alias("l_orderkey"))
    # tag ids are cut once per part; the lines meet the orders last and follow their partitions, which the
    # distinct and whatever joins the links by expense keep (an inner join on distinct keys: a semi join is
    # pushed below the join with the parts)
    tagged = lineitem.select("l_orderkey", "l_partkey").join(
        part.select(F.col("p_partkey").alias("l_partkey"), _tid(F.col("p_brand")).alias("tid")), "l_partkey")
    expenses_tags = once(tagged.join(order_keys.repartition(n, "l_orderkey").distinct(), "l_orderkey")
                         .select(F.col("l_orderkey").cast("long").alias("eid"), "tid")
                         .distinct(), "expenses_tags")

    groups = nation.select(
        F.col("n_nationkey").cast("long").alias("gid"),
        F.lit(GROUP_CREATED).alias("date_created"),
        F.col("n_name").alias("group_name"),
        F.lit(None).cast("string").alias("description"))

    # hash-partitioned by geid once: the distinct, the per-expense count and the joins on geid
    # below all reuse that partitioning instead of shuffling again. Lines without an order are in there:
    # all that is made of them meets the orders on geid below
    participants = (lineitem.filter(F.col("l_orderkey").isNotNull())
                    .select(F.col("l_orderkey").cast("long").alias("geid"),
                            F.col("l_suppkey").cast("long").alias("uid"))
                    .unionByName(orders.select(F.col("o_orderkey").cast("long").alias("geid"),
                                               F.col("o_custkey").cast("long").alias("uid")))
                    .repartition(n, "geid")
                    .distinct())
    counts = participants.groupBy("geid").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    if stage:
        counts = _staged(counts, "counts")
    nations = customer.select(F.col("c_custkey").cast("long").alias("uid"),
                              F.col("c_nationkey").cast("long").alias("gid"))
    group_expenses = once(expenses.withColumnRenamed("eid", "geid")
                          .join(counts, "geid").join(nations, "uid"), "group_expenses")
    split_users = once(participants
                       .join(group_expenses.select("geid", "amount", "n"), "geid")
                       .select("geid", "uid", (F.col("amount") / F.col("n")).alias("split_amount")), "split_users")
    user_group = once(split_users.select("geid", "uid")
                      .join(group_expenses.select("geid", "gid"), "geid")
                      .select("uid", "gid").distinct(), "user_group")
    group_expense_tags = once(expenses_tags.withColumnRenamed("eid", "geid")
                              .join(counts.select("geid"), "geid", "left_semi"), "group_expense_tags")

    tables = dict(users=users, categories=categories, payment_methods=payment_methods,
                  expenses=expenses, tags=tags, expenses_tags=expenses_tags, groups=groups,
                  user_group=user_group, group_expenses=group_expenses,
                  split_users=split_users, group_expense_tags=group_expense_tags)
    return Ledger(**{k: conform(v, k) for k, v in tables.items()}, key_parts=n)
