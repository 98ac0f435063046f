"""Group reports R10-R15 and the visibility scope.

``group_name=None`` runs a report for every group at once with ``group_name``
as the leading key; a name restricts it to that group (a semi join on the gid
of that name). Group membership and the Admin role are data, looked up with
joins -- nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.money import exact_sum
from ledgerline.operators import filters as P
from ledgerline.operators.joins import in_group, ordered_listagg, with_dims, with_tags
from ledgerline.schema import Ledger

GROUP_COLUMNS = ["geid", "amount", "category_name", "method", "date", "description", "tags",
                 "usernames"]


def _lead(group_name: str | None, cols: list[str]) -> list[str]:
    return cols if group_name is not None else ["group_name"] + cols


def _named(df: DataFrame, ledger: Ledger, group_name: str | None) -> DataFrame:
    """Restrict to one group, or attach group_name for the all-groups form."""
    if group_name is not None:
        return in_group(df, ledger, group_name)
    return df.join(ledger.groups.select("gid", "group_name"), "gid")


def group_scope(ledger: Ledger, uid: int) -> DataFrame:
    """Gids the user may see -- all groups for an Admin, else the member groups.

    The Admin test is a scalar subquery over the user's own row (a primary-key
    lookup), applied as a filter on the groups: no join with a constant key.
    """
    member = ledger.user_group.filter(F.col("uid") == F.lit(uid)).select("gid")
    is_admin = (ledger.users.filter((F.col("uid") == F.lit(uid)) & (F.col("role") == "Admin"))
                .agg((F.count(F.lit(1)) > 0).alias("a")).scalar())
    admin = ledger.groups.filter(is_admin).select("gid")
    return member.unionByName(admin).distinct()


def _visible(df: DataFrame, ledger: Ledger, uid: int | None) -> DataFrame:
    """Rows of the groups that the calling user may see (all rows without a caller)."""
    return df if uid is None else df.join(group_scope(ledger, uid), "gid", "left_semi")


def list_groups(ledger: Ledger, uid: int | None = None) -> DataFrame:
    """All groups (uid None), else the groups visible to that user."""
    groups = ledger.groups
    if uid is not None:
        groups = groups.join(group_scope(ledger, uid), "gid", "left_semi")
    return groups.select("group_name", "date_created", "description").orderBy("group_name")


def group_member_count(ledger: Ledger, group_name: str | None = None) -> DataFrame:
    """A5: members per group (COUNT(*) over user_group)."""
    counts = ledger.user_group.groupBy("gid").agg(F.count(F.lit(1)).alias("member_count"))
    return _named(counts, ledger, group_name).select(*_lead(group_name, ["member_count"]))


def username_lists(ledger: Ledger) -> DataFrame:
    """Distinct participant names per group expense, ',' joined in name order."""
    return (ledger.split_users.select("geid", "uid")
            .join(ledger.users.select("uid", "username"), "uid")
            .groupBy("geid").agg(ordered_listagg("username", ",", True).alias("usernames")))


def group_expenses(ledger: Ledger, group_name: str | None = None,
                   filters: dict | None = None, uid: int | None = None) -> DataFrame:
    """Group expenses with distinct tags and participant names; amount desc.
    ``uid`` (here and in R13-R15) is the caller: only that user's groups are reported."""
    f = P.normalise(filters, P.GROUP_KEYS)
    facts = _named(_visible(P.filtered_facts(ledger.group_expenses, f), ledger, uid), ledger, group_name)
    if "tag" in f:  # P10: EXISTS -- keeps all tags of a matching expense
        hit = (ledger.group_expense_tags
               .join(ledger.tags.filter(F.col("tag_name") == F.lit(f["tag"].lower())), "tid")
               .select("geid"))
        facts = facts.join(hit, "geid", "left_semi")
    rows = with_dims(facts, ledger).filter(P.category_predicate(f))
    rows = with_tags(rows, ledger, sep=",", group=True, distinct=True)
    rows = rows.join(username_lists(ledger), "geid", "left")
    return rows.select(*_lead(group_name, GROUP_COLUMNS)).orderBy(
        *([] if group_name is not None else ["group_name"]), F.desc("amount"), "geid")


def group_category_spending(ledger: Ledger, category: str,
                            group_name: str | None = None, uid: int | None = None) -> DataFrame:
    """One category's total in a group; no row when 0 or none."""
    facts = _named(_visible(ledger.group_expenses, ledger, uid), ledger, group_name).join(
        ledger.categories.filter(F.lower("category_name") == F.lit(category.lower())), "cid")
    keys = _lead(group_name, ["category_name"])
    out = facts.groupBy(*keys).agg(exact_sum("amount").alias("total"))
    return out.filter(F.col("total").isNotNull() & (F.col("total") != 0)).select(
        *_lead(group_name, ["total", "category_name"]))


def group_tag_usage(ledger: Ledger, group_name: str | None = None, uid: int | None = None) -> DataFrame:
    """Tagged expenses per tag in a group; tags with no such expense are absent."""
    facts = _named(_visible(ledger.group_expenses.select("geid", "gid"), ledger, uid), ledger, group_name)
    keys = _lead(group_name, ["tag_name"])
    return (ledger.group_expense_tags.join(facts, "geid").join(ledger.tags, "tid")
            .groupBy(*keys).agg(F.count("geid").alias("expense_count"))
            .orderBy(*([] if group_name is not None else ["group_name"]),
                     F.desc("expense_count"), "tag_name"))


def group_user_expenses(ledger: Ledger, group_name: str | None = None, uid: int | None = None) -> DataFrame:
    """Sum of each member's split shares in a group, ascending.

    Shares are summed per (group, user) first; names are joined to the sums.
    """
    facts = in_group(_visible(ledger.group_expenses.select("geid", "gid"), ledger, uid), ledger, group_name)
    sums = (ledger.split_users.join(facts, "geid")
            .groupBy("gid", "uid").agg(exact_sum("split_amount").alias("total_spent")))
    out = sums.join(ledger.users.select("uid", "username"), "uid")
    if group_name is None:
        out = out.join(ledger.groups.select("gid", "group_name"), "gid")
    return out.select(*_lead(group_name, ["username", "total_spent"])).orderBy(
        *([] if group_name is not None else ["group_name"]), "total_spent", "username")
