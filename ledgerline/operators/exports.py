"""Export layouts S4 (personal CSV) and S5 (group CSV) as DataFrames of CSV text.

The frames hold exactly the text the files get (amounts printed as Python
prints floats, missing values as empty fields), sorted as the file is. Writing
is :func:`ledgerline.sources.csv_io.write_csv`. Tag and participant lists are
aggregated per expense first and joined once -- no per-expense queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import float_text
from ledgerline.operators import filters as P
from ledgerline.operators.joins import in_group, tag_lists, with_dims
from ledgerline.schema import Ledger

# Headers of the two personal layouts and the group layout.
PERSONAL_HEADER = ["ID", "Amount", "Category", "Payment Method", "Date", "Description", "Tags"]
ALL_USERS_HEADER = ["ID", "User", "Amount", "Category", "Payment Method", "Date", "Description", "Tags"]
GROUP_HEADER = ["group_name", "date_created", "description", "expense_id", "creator_username", "amount",
                "category_name", "payment_method", "expense_date", "expense_description", "tags",
                "split_usernames", "split_amounts"]

GROUP_ROW = ["group_name", "date_created", "group_description", "geid", "username", "amount", "category_name",
             "method", "date", "description", "tags", "split_usernames", "split_amounts"]

PERSONAL_SORT = {"date": "date", "amount": "amount", "category": "category_name",
                 "payment_method": "method", "tags": "tags", "user": "username"}
GROUP_SORT = {"date": "date", "amount": "amount", "category": "category_name",
              "payment_method": "method", "tags": "tags"}


def _text(c) -> F.Column:
    return F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit(""))


def expense_export(ledger: Ledger, sort_field: str = "date", uid: int | None = None) -> DataFrame:
    """Uid None = the all-users layout (with User), else that user's layout."""
    field = sort_field.lower()
    if field not in PERSONAL_SORT:
        raise ValueError(f"sort field must be one of {', '.join(PERSONAL_SORT)}")
    rows = with_dims(ledger.expenses.filter(P.user_scope(uid)), ledger)
    if uid is None or field == "user":
        rows = rows.join(ledger.users.select("uid", "username"), "uid")
    rows = rows.join(tag_lists(ledger), "eid", "left")
    key = PERSONAL_SORT[field]
    ordered = rows.orderBy(F.asc_nulls_first(key), "eid")
    cols = [F.col("eid").cast("string").alias("ID")]
    if uid is None:
        cols.append(_text("username").alias("User"))
    cols += [float_text("amount").alias("Amount"), _text("category_name").alias("Category"),
             _text("method").alias("Payment Method"), _text("date").alias("Date"),
             _text("description").alias("Description"), _text("tags").alias("Tags")]
    return ordered.select(*cols)


def split_lists(ledger: Ledger) -> DataFrame:
    """Per group expense, participant names and their shares as two aligned lists."""
    pairs = (ledger.split_users.join(ledger.users.select("uid", "username"), "uid")
             .groupBy("geid")
             .agg(F.sort_array(F.collect_list(F.struct("username", "split_amount"))).alias("s")))
    return pairs.select(
        "geid",
        F.array_join(F.transform("s", lambda x: x["username"]), ", ").alias("split_usernames"),
        F.array_join(F.transform("s", lambda x: float_text(x["split_amount"])), ", ").alias("split_amounts"))


def group_export_rows(ledger: Ledger, group_name: str | None = None) -> DataFrame:
    """The joined rows of S5 in no order: what every sort of the same groups has in common."""
    facts = in_group(ledger.group_expenses, ledger, group_name)
    return (with_dims(facts, ledger)
            .join(ledger.groups.withColumnRenamed("description", "group_description"), "gid")
            .join(ledger.users.select("uid", "username"), "uid")
            .join(tag_lists(ledger, group=True), "geid", "left")
            .join(split_lists(ledger), "geid", "left")
            .select(*GROUP_ROW))


def group_export(ledger: Ledger, group_name: str | None = None,
                 sort_field: str | None = None, rows: DataFrame | None = None) -> DataFrame:
    """One row per group expense with group, tags and aligned split lists.

    ``rows`` are the stored :func:`group_export_rows` of the same ledger and groups: a caller
    that writes several sorts then joins and aggregates once, and only sorts each time.
    """
    if sort_field is not None and sort_field.lower() not in GROUP_SORT:
        raise ValueError(f"sort field must be one of {', '.join(GROUP_SORT)}")
    if rows is None:
        rows = group_export_rows(ledger, group_name)
    if sort_field is not None:
        rows = rows.orderBy(F.asc_nulls_first(GROUP_SORT[sort_field.lower()]), "geid")
    else:
        rows = rows.orderBy("group_name", "geid")
    return rows.select(
        _text("group_name").alias("group_name"), _text("date_created").alias("date_created"),
        _text("group_description").alias("description"), F.col("geid").cast("string").alias("expense_id"),
        _text("username").alias("creator_username"), float_text("amount").alias("amount"),
        _text("category_name").alias("category_name"), _text("method").alias("payment_method"),
        _text("date").alias("expense_date"), _text("description").alias("expense_description"),
        _text("tags").alias("tags"), _text("split_usernames").alias("split_usernames"),
        _text("split_amounts").alias("split_amounts"))
