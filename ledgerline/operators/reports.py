"""Personal reports R0-R9.

Every report takes ``uid``: an int gives that user's report (the reference's
result); ``None`` gives all users' reports in one pass with ``uid`` as leading
key. Sorting follows the reference and always ends on a unique id, so results
are deterministic; in the all-users form the sort is per user.

Scale notes: "rank = 1" and "count = max count" are computed as an aggregate of
the aggregate joined back (no window over a month or user partition that can
hold a third of the data), and per-user top-N uses a row_number filter that
Spark turns into a map-side per-partition limit before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.money import exact_avg, exact_sum
from ledgerline.functions.text import month
from ledgerline.operators import filters as P
from ledgerline.operators.joins import with_dims, with_tags
from ledgerline.schema import Ledger

EXPENSE_COLUMNS = ["eid", "amount", "category_name", "method", "date", "description", "tags"]
#: A frame of one row per category is broadcast when a count shows at most this many (some 50 bytes each).
BROADCAST_ROWS = 100_000


def _scoped(ledger: Ledger, uid: int | None) -> DataFrame:
    return ledger.expenses.filter(P.user_scope(uid))


def _lead(uid: int | None, cols: list[str]) -> list[str]:
    return cols if uid is not None else ["uid"] + cols


def list_expenses(ledger: Ledger, filters: dict | None = None, uid: int | None = None) -> DataFrame:
    """R0 with filters P3-P11; newest first."""
    f = P.normalise(filters)
    facts = P.filtered_facts(_scoped(ledger, uid), f)
    rows = (with_dims(facts, ledger)
            .filter(P.category_predicate(f) & P.method_predicate(f)))
    rows = with_tags(rows, ledger, tag=f.get("tag"))
    return (rows.select(*_lead(uid, EXPENSE_COLUMNS))
            .orderBy(F.desc("date"), F.desc("eid")))


def top_expenses(ledger: Ledger, n: int, start, end, uid: int | None = None) -> DataFrame:
    """The n largest expenses in an inclusive date range (per user when uid is None).

    The top-n is taken on expenses with their dimensions first; only the kept
    rows meet the tag lists.
    """
    facts = with_dims(P.date_range(_scoped(ledger, uid), start, end), ledger)
    if uid is not None:
        top = facts.orderBy(F.desc("amount"), F.asc("eid")).limit(n)
    else:
        w = Window.partitionBy("uid").orderBy(F.desc("amount"), F.asc("eid"))
        top = facts.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).drop("rn")
    rows = with_tags(top, ledger)
    return rows.select(*_lead(uid, EXPENSE_COLUMNS)).orderBy(
        *([] if uid is not None else ["uid"]), F.desc("amount"), F.asc("eid"))


def category_spending(ledger: Ledger, category: str, uid: int | None = None) -> DataFrame:
    """R2: total of one category (name matched case-insensitively); no row when 0 or none."""
    facts = _scoped(ledger, uid).join(
        ledger.categories.filter(F.lower("category_name") == F.lit(category.lower())), "cid")
    keys = ["category_name"] if uid is not None else ["uid", "category_name"]
    out = facts.groupBy(*keys).agg(exact_sum("amount").alias("total"))
    return out.filter(F.col("total").isNotNull() & (F.col("total") != 0)).select(
        *_lead(uid, ["total", "category_name"]))


def category_averages(ledger: Ledger) -> DataFrame:
    """Average amount per category over all users (the reference's subquery has no uid)."""
    return ledger.expenses.groupBy("cid").agg(exact_avg("amount").alias("category_avg"))


def above_average_expenses(ledger: Ledger, uid: int | None = None) -> DataFrame:
    """Expenses strictly above their category's all-user average.

    The averages hold one row per category: they are put on the categories
    first, and a count of that table decides whether the facts meet it by
    broadcast (no shuffle of the expenses on a handful of hot keys). Beyond
    ``BROADCAST_ROWS`` categories Spark plans the join.
    """
    usual = ledger.categories.join(category_averages(ledger), "cid")
    if ledger.categories.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        usual = F.broadcast(usual)
    facts = (_scoped(ledger, uid).join(usual, "cid").filter(F.col("amount") > F.col("category_avg"))
             .join(ledger.payment_methods, "pid"))
    cols = ["eid", "uid", "amount", "cid", "pid", "date", "description", "category_name",
            "method", "category_avg"]
    return facts.select(*cols).orderBy(
        *([] if uid is not None else ["uid"]), "category_name", F.desc("amount"), "eid")


def monthly_category_spending(ledger: Ledger, uid: int | None = None) -> DataFrame:
    """Total and count per month and category; month desc, total desc."""
    facts = _scoped(ledger, uid).join(ledger.categories, "cid")
    keys = _lead(uid, ["month", "category_name"])
    out = (facts.withColumn("month", month("date"))
           .groupBy(*keys)
           .agg(exact_sum("amount").alias("total"), F.count("eid").alias("count")))
    return out.orderBy(*([] if uid is not None else ["uid"]),
                       F.desc("month"), F.desc("total"), "category_name")


def highest_spender_per_month(ledger: Ledger) -> DataFrame:
    """Per month the user(s) with the largest total; ties all kept (RANK() = 1).

    Totals are aggregated by (month, uid) first; those (far fewer) rows are
    restricted to existing users (expenses of deleted users do not compete, as
    with the reference's inner join), and only the winners -- a few rows per
    month -- meet the users table for their names.
    """
    per_user = (ledger.expenses.withColumn("month", month("date"))
                .groupBy("month", "uid").agg(exact_sum("amount").alias("total"))
                .join(ledger.users.select("uid"), "uid", "left_semi"))
    best = per_user.groupBy("month").agg(F.max("total").alias("total"))
    return (per_user.join(best, ["month", "total"], "left_semi")
            .join(ledger.users.select("uid", "username"), "uid")
            .select("month", "username", "total")
            .orderBy(F.desc("month"), "username"))


def frequent_category(ledger: Ledger, uid: int | None = None) -> DataFrame:
    """The most frequent category (all tied ones) per user."""
    facts = _scoped(ledger, uid).join(ledger.categories, "cid")
    keys = _lead(uid, ["category_name"])
    counts = facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    if uid is not None:
        best = counts.agg(F.max("count").alias("count"))
        return counts.join(best, "count", "left_semi").select("category_name", "count")
    best = counts.groupBy("uid").agg(F.max("count").alias("count"))
    return (counts.join(best, ["uid", "count"], "left_semi")
            .select("uid", "category_name", "count").orderBy("uid", "category_name"))


def payment_method_usage(ledger: Ledger, uid: int | None = None) -> DataFrame:
    """Total and count per payment method; methods never used are absent."""
    facts = _scoped(ledger, uid).join(ledger.payment_methods, "pid")
    keys = _lead(uid, ["method"])
    return (facts.groupBy(*keys)
            .agg(exact_sum("amount").alias("total_spent"), F.count("eid").alias("expense_count"))
            .orderBy(*([] if uid is not None else ["uid"]), F.desc("total_spent"), "method"))


def tag_expenses(ledger: Ledger, uid: int | None = None) -> DataFrame:
    """Number of the user's expenses per tag; unused tags are absent."""
    links = ledger.expenses_tags
    if uid is None:
        links = links.join(ledger.expenses.select("eid", "uid"), "eid")
    else:
        links = links.join(_scoped(ledger, uid).select("eid"), "eid", "left_semi")
    keys = _lead(uid, ["tag_name"])
    return (links.join(ledger.tags, "tid").groupBy(*keys)
            .agg(F.count("eid").alias("expense_count"))
            .orderBy(*([] if uid is not None else ["uid"]), F.desc("expense_count"), "tag_name"))


def list_users(ledger: Ledger) -> DataFrame:
    return ledger.users.select("uid", "username", "role").orderBy("uid")


def list_categories(ledger: Ledger) -> DataFrame:
    return ledger.categories.select("cid", "category_name").orderBy("cid")


def list_payment_methods(ledger: Ledger) -> DataFrame:
    return ledger.payment_methods.select("pid", "method").orderBy("pid")


def list_tags(ledger: Ledger) -> DataFrame:
    return ledger.tags.select("tid", "tag_name").orderBy("tid")
