"""Keyed batch changes M1-M6, M8-M12 (set-based forms of the single-row commands).

Each function takes the ledger and a batch with a unique ``seq`` and returns a
:class:`ChangeResult` -- the changed ledger and the rejects ``(seq, reason)``.
Parquet tables have no UPDATE / DELETE, so every change is "old rows without the
touched keys, and the new rows". A result names both per table (``removed``,
``added``), so that :mod:`ledgerline.sources.store` rewrites only the folders
that hold touched keys.

Batch semantics: rules are judged against the snapshot before the batch. Among
rows that insert the same key the lowest ``seq`` wins (a grouped min, so a hot
key is pre-aggregated); among updates of the same field the highest ``seq``
wins. Nothing is collected to the driver.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.money import exact_sum
from ledgerline.functions.parse import parse_amount, parse_date
from ledgerline.functions.text import norm_name, split_list, strip
from ledgerline.operators.ids import allocate_ids, mark_deleted, next_id_base
from ledgerline.operators.loads import _first_failing, _lookup, _materialise, name_lookup
from ledgerline.schema import MONTH, ROLES, Ledger, conform, month_of

# Reject reasons.
R_EXISTS = "already exists"
R_DUPLICATE_IN_BATCH = "duplicate in batch"
R_BAD_ROLE = "invalid role"
R_EMPTY_NAME = "empty name"
R_UNKNOWN_USER = "unknown user"
R_UNKNOWN_GROUP = "unknown group"
R_NOT_MEMBER = "actor not a member"
R_NOT_FOUND = "not found"
R_NOT_OWNER = "not the owner"
R_BAD_FIELD = "invalid field"
R_BAD_VALUE = "invalid value"
R_NO_SCOPE = "no access to group"

EXPENSE_FIELDS = ("amount", "date", "description", "category", "payment_method", "tags")
USER_FIELDS = ("role",)
GROUP_FIELDS = ("group_name", "description")


@dataclass
class ChangeResult:
    ledger: Ledger
    rejects: DataFrame
    #: new rows per table, and keys (some columns of the table) whose stored rows go
    added: dict = field(default_factory=dict)
    removed: dict = field(default_factory=dict)


def _added(ledger: Ledger, rejects: DataFrame, **rows: DataFrame) -> ChangeResult:
    rows = {t: conform(df, t) for t, df in rows.items()}
    return ChangeResult(ledger.with_rows(**rows), rejects, rows)


def _changed(before: Ledger, tables: dict, rejects: DataFrame, removed: dict, added: dict | None = None) -> ChangeResult:
    """A result whose tables are given; no id is given here, so current id marks stay so."""
    out = before.with_tables(**tables, marks_current=before.marks_current)
    return ChangeResult(out, rejects, added or {}, removed)


def _rejects(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("reason").isNotNull()).select("seq", "reason")


def _judge_with_dups(b: DataFrame, rules: list[tuple[Column, str]], key: list[str]) -> DataFrame:
    """Apply ``rules``; among the rows that pass, the lowest seq per key wins and the
    others are batch duplicates (as if the rows were applied one after another)."""
    pre = b.withColumn("reason", _first_failing(*rules))
    passing = pre.filter(F.col("reason").isNull())
    # the batch meets the winners on its unique seq: a key in every row is one row here
    first = passing.groupBy(*key).agg(F.min("seq").alias("seq")).select("seq", F.lit(True).alias("_first"))
    return (pre.join(first, "seq", "left")
            .withColumn("reason", F.when(F.col("reason").isNull() & F.col("_first").isNull(),
                                         F.lit(R_DUPLICATE_IN_BATCH)).otherwise(F.col("reason")))
            .drop("_first"))


def _add_named(ledger: Ledger, table: str, batch: DataFrame, name_col: str, id_col: str,
               extra_rules: list[tuple[Column, str]] = (), ci_exists: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Shared body of M1-M5: validate, keep the first row per name, drop existing, allocate ids."""
    dim = ledger.table(table)
    key = F.lower(F.col(name_col)) if ci_exists else F.col(name_col)
    existing = dim.select(key.alias("_k")).distinct()
    b = batch.withColumn("_k", key).join(existing.withColumn("_exists", F.lit(True)), "_k", "left")
    judged = _judge_with_dups(b, [
        (F.col(name_col).isNull() | (F.col(name_col) == ""), R_EMPTY_NAME),
        *extra_rules,
        (F.col("_exists").isNotNull(), R_EXISTS)], ["_k"])
    ok = judged.filter(F.col("reason").isNull()).drop("reason", "_k", "_exists")
    new = allocate_ids(ok, ["seq"], id_col, next_id_base(ledger, table))
    return new, _rejects(judged), judged


def add_users(ledger: Ledger, batch: DataFrame) -> ChangeResult:
    """M1: batch (seq, username, role). Unique username; role Admin or User."""
    b = batch.select("seq", strip("username").alias("username"), "role")
    new, rej, _ = _add_named(ledger, "users", b, "username", "uid",
                             [(~F.coalesce(F.col("role").isin(*ROLES), F.lit(False)), R_BAD_ROLE)])
    return _added(ledger, rej, users=new)


def add_categories(ledger: Ledger, batch: DataFrame) -> ChangeResult:
    """M2: batch (seq, category_name); names are lower-cased as the callers do."""
    b = batch.select("seq", norm_name("category_name").alias("category_name"))
    new, rej, _ = _add_named(ledger, "categories", b, "category_name", "cid")
    return _added(ledger, rej, categories=new)


def add_payment_methods(ledger: Ledger, batch: DataFrame) -> ChangeResult:
    """M3: batch (seq, method); a method equal to a stored one ignoring case is rejected."""
    b = batch.select("seq", strip("method").alias("method"))
    new, rej, _ = _add_named(ledger, "payment_methods", b, "method", "pid", ci_exists=True)
    return _added(ledger, rej, payment_methods=new)


def add_tags(ledger: Ledger, batch: DataFrame) -> ChangeResult:
    """M4: batch (seq, tag_name); stripped and lower-cased; unique."""
    b = batch.select("seq", norm_name("tag_name").alias("tag_name"))
    new, rej, _ = _add_named(ledger, "tags", b, "tag_name", "tid")
    return _added(ledger, rej, tags=new)


def add_groups(ledger: Ledger, batch: DataFrame, as_of=None) -> ChangeResult:
    """M5: batch (seq, uid creator, group_name, description); the creator becomes a member."""
    as_of = as_of or _dt.date.today()
    b = (batch.select("seq", "uid", strip("group_name").alias("group_name"), "description")
         .join(ledger.users.select("uid", F.lit(True).alias("_known")), "uid", "left"))
    new, rej, _ = _add_named(ledger, "groups", b, "group_name", "gid",
                             [(F.col("_known").isNull(), R_UNKNOWN_USER)])
    groups = new.withColumn("date_created", F.lit(_dt.date.fromisoformat(str(as_of))))
    return _added(ledger, rej, groups=groups, user_group=new)


def add_members(ledger: Ledger, batch: DataFrame) -> ChangeResult:
    """M6: batch (seq, actor_uid, username, group_name).

    User and group must exist; when the group already has members the actor
    must be one of them (judged on the snapshot before the batch); a pair
    already present or repeated in the batch is rejected.
    """
    users = ledger.users.select("uid", "username")
    groups = ledger.groups.select("gid", "group_name")
    members = ledger.user_group
    has_members = members.select("gid").distinct().withColumn("_has", F.lit(True))
    b = (batch.join(users, "username", "left").join(groups, "group_name", "left")
         .join(has_members, "gid", "left")
         .join(members.select(F.col("uid").alias("actor_uid"), "gid", F.lit(True).alias("_actor_in")),
               ["actor_uid", "gid"], "left")
         .join(members.select("uid", "gid", F.lit(True).alias("_pair")), ["uid", "gid"], "left"))
    judged = _judge_with_dups(b, [
        (F.col("uid").isNull(), R_UNKNOWN_USER),
        (F.col("gid").isNull(), R_UNKNOWN_GROUP),
        (F.col("_has").isNotNull() & F.col("_actor_in").isNull(), R_NOT_MEMBER),
        (F.col("_pair").isNotNull(), R_EXISTS)], ["uid", "gid"])
    new = judged.filter(F.col("reason").isNull()).select("uid", "gid")
    return _added(ledger, _rejects(judged), user_group=new)


def _without(ledger: Ledger, removed: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables of ``removed`` without the rows of those keys."""
    return {t: ledger.table(t).join(keys, keys.columns, "left_anti") for t, keys in removed.items()}


# ---------------------------------------------------------------- M8, M9

def _last_per_key(df: DataFrame, key: list[str]) -> DataFrame:
    last = df.groupBy(*key).agg(F.max("seq").alias("seq"))
    return df.join(last.select("seq"), "seq", "left_semi")


def update_expenses(ledger: Ledger, batch: DataFrame, ci_methods: bool = False) -> ChangeResult:
    """M8: batch (seq, actor_uid, eid, field, value) -- fields as EXPENSE_FIELDS.

    Only the owner may change an expense. Category and method are matched
    exactly after lower-casing (``ci_methods`` lower-cases the stored methods
    too); ``tags`` replaces the whole tag set (new tag names are created). The
    last accepted change per (eid, field) wins.
    """
    exp = conform(ledger.expenses, "expenses")
    cats = name_lookup(ledger.categories, "category_name", "cid", False)
    pms = name_lookup(ledger.payment_methods, "method", "pid", ci_methods)
    b = (ledger.keyed(batch, "eid")
         .join(exp.select("eid", F.col("uid").alias("_owner"), F.col("date").alias("_old")), "eid", "left")
         .withColumn("_amount", parse_amount("value"))
         .withColumn("_date", parse_date("value"))
         .withColumn("_lower", F.lower(F.col("value")))
         .withColumn("_tags", F.transform(split_list("value"), F.lower)))
    b = _lookup(b, cats, "_lower", "cid")
    b = b.withColumnRenamed("cid", "_cid")
    b = _lookup(b, pms, "_lower", "pid").withColumnRenamed("pid", "_pid")
    f = F.col("field")
    reason = _first_failing(
        (~F.coalesce(f.isin(*EXPENSE_FIELDS), F.lit(False)), R_BAD_FIELD),
        (F.col("_owner").isNull(), R_NOT_FOUND),
        (F.col("_owner") != F.col("actor_uid"), R_NOT_OWNER),
        ((f == "amount") & (F.col("_amount").isNull() | (F.col("_amount") < 0)), R_BAD_VALUE),
        ((f == "date") & F.col("_date").isNull(), R_BAD_VALUE),
        ((f == "category") & F.col("_cid").isNull(), R_BAD_VALUE),
        ((f == "payment_method") & F.col("_pid").isNull(), R_BAD_VALUE))
    # expenses, links, tags and rejects all read the batch as judged once
    judged = _materialise(b.withColumn("reason", reason))
    ok = judged.filter(F.col("reason").isNull())

    def last(field: str, col: str):
        """Value of the field's last accepted change (highest seq) in the expense's group."""
        return F.max_by(F.col(col), F.when(f == field, F.col("seq")))

    # one aggregation per expense gathers the last change of every field (no join per field)
    changes = ledger.keyed(ok, "eid").groupBy("eid").agg(
        last("amount", "_amount").alias("_new_amount"), last("date", "_date").alias("_new_date"),
        last("description", "value").alias("_new_description"), last("category", "_cid").alias("_new_cid"),
        last("payment_method", "_pid").alias("_new_pid"), last("tags", "_tags").alias("_new_tags"),
        F.max(F.when(f == "description", True)).alias("_set_desc"),
        F.max(F.when(f == "tags", True)).alias("_set_tags"),
        F.max(F.when(f == "tags", F.col("seq"))).alias("_tags_seq"), F.max("_old").alias("_old"))
    new_rows = _updated(exp.join(changes, "eid"))
    # tags: replace the set of every expense with an accepted tags change
    retag = changes.filter(F.col("_set_tags").isNotNull())
    tag_rows = retag.select("eid", F.col("_tags_seq").alias("seq"),
                            F.explode(F.array_distinct("_new_tags")).alias("_name"))
    from ledgerline.operators.loads import _link_tags
    new_tags, bridge = _link_tags(ledger, tag_rows.filter(F.col("_name") != ""), "eid")
    bridge, retag = conform(bridge, "expenses_tags"), retag.select("eid")
    links = ledger.keyed(ledger.expenses_tags.join(retag, "eid", "left_anti").unionByName(bridge), "eid")
    before = ledger.with_rows(tags=new_tags)
    return _changed(before, {"expenses": _updated(exp.join(changes, "eid", "left")), "expenses_tags": links},
                    _rejects(judged),
                    {"expenses": changes.select("eid", month_of(F.col("_old")).alias(MONTH)), "expenses_tags": retag},
                    {"tags": new_tags, "expenses": new_rows, "expenses_tags": bridge})


def _updated(rows: DataFrame) -> DataFrame:
    """Expense rows with their last changes put in."""
    return conform((rows
               .select("eid", "uid",
                       F.coalesce("_new_amount", "amount").alias("amount"),
                       F.coalesce("_new_cid", "cid").alias("cid"),
                       F.coalesce("_new_pid", "pid").alias("pid"),
                       F.coalesce("_new_date", "date").alias("date"),
                       F.when(F.col("_set_desc").isNotNull(), F.col("_new_description"))
                       .otherwise(F.col("description")).alias("description"))), "expenses")


def delete_expenses(ledger: Ledger, batch: DataFrame) -> ChangeResult:
    """M9: batch (seq, actor_uid, eid); only the owner; tag links go too."""
    b = batch.join(ledger.expenses.select("eid", F.col("uid").alias("_owner"), month_of(F.col("date")).alias(MONTH)), "eid", "left")
    reason = _first_failing((F.col("_owner").isNull(), R_NOT_FOUND),
                            (F.col("_owner") != F.col("actor_uid"), R_NOT_OWNER))
    judged = _materialise(b.withColumn("reason", reason))
    dated = judged.filter(F.col("reason").isNull()).select("eid", MONTH).distinct()
    gone = dated.select("eid")
    ledger = mark_deleted(ledger, ["expenses"])
    return _changed(ledger, {"expenses": ledger.expenses.join(gone, "eid", "left_anti"),
                             "expenses_tags": ledger.expenses_tags.join(gone, "eid", "left_anti")},
                    _rejects(judged), {"expenses": dated, "expenses_tags": gone})


# ---------------------------------------------------------------- M10, M11

def update_users(ledger: Ledger, batch: DataFrame) -> ChangeResult:
    """Batch (seq, uid, field, value); the only field is ``role`` (Admin/User)."""
    b = batch.join(ledger.users.select("uid", F.lit(True).alias("_known")), "uid", "left")
    reason = _first_failing(
        (~F.coalesce(F.col("field").isin(*USER_FIELDS), F.lit(False)), R_BAD_FIELD),
        (F.col("_known").isNull(), R_NOT_FOUND),
        (~F.coalesce(F.col("value").isin(*ROLES), F.lit(False)), R_BAD_VALUE))
    judged = _materialise(b.withColumn("reason", reason))
    ok = _last_per_key(judged.filter(F.col("reason").isNull()), ["uid", "field"])
    new = ledger.users.join(ok.select("uid", F.col("value").alias("_role")), "uid", "left").select(
        "uid", "username", F.coalesce("_role", "role").alias("role"))
    touched = ok.select("uid")
    return _changed(ledger, {"users": new}, _rejects(judged), {"users": touched},
                    {"users": new.join(touched, "uid", "left_semi")})


def _scope_ok(ledger: Ledger, b: DataFrame) -> DataFrame:
    """R11 for each batch row: actor is Admin or a member of the row's group."""
    admins = ledger.users.filter(F.col("role") == "Admin").select(F.col("uid").alias("actor_uid"),
                                                                   F.lit(True).alias("_admin"))
    member = ledger.user_group.select(F.col("uid").alias("actor_uid"), "gid", F.lit(True).alias("_member"))
    return (b.join(admins, "actor_uid", "left").join(member, ["actor_uid", "gid"], "left")
            .withColumn("_scope", F.col("_admin").isNotNull() | F.col("_member").isNotNull()))


def update_groups(ledger: Ledger, batch: DataFrame) -> ChangeResult:
    """Batch (seq, actor_uid, group_name, field, value); fields group_name / description.

    A new name must be free (in the snapshot and among the batch's renames).
    """
    b = batch.join(ledger.groups.select("gid", "group_name"), "group_name", "left")
    b = _scope_ok(ledger, b)
    taken = ledger.groups.select(F.col("group_name").alias("value"), F.lit(True).alias("_taken"))
    b = b.join(taken, "value", "left")
    renames = b.filter(F.col("field") == "group_name")
    clash = (renames.groupBy("value").agg(F.countDistinct("gid").alias("_n"))
             .filter("_n > 1").select("value", F.lit(True).alias("_clash")))
    b = b.join(clash, "value", "left")
    is_rename = F.col("field") == "group_name"
    reason = _first_failing(
        (~F.coalesce(F.col("field").isin(*GROUP_FIELDS), F.lit(False)), R_BAD_FIELD),
        (F.col("gid").isNull(), R_UNKNOWN_GROUP),
        (~F.col("_scope"), R_NO_SCOPE),
        (is_rename & (F.col("value").isNull() | (strip("value") == "")), R_BAD_VALUE),
        (is_rename & (F.col("_taken").isNotNull() | F.col("_clash").isNotNull()), R_EXISTS))
    judged = _materialise(b.withColumn("reason", reason))
    ok = _last_per_key(judged.filter(F.col("reason").isNull()), ["gid", "field"])
    names = ok.filter(is_rename).select("gid", F.col("value").alias("_name"))
    descs = ok.filter(F.col("field") == "description").select("gid", F.col("value").alias("_desc"),
                                                             F.lit(True).alias("_set"))
    new = (ledger.groups.join(names, "gid", "left").join(descs, "gid", "left")
           .select("gid", "date_created", F.coalesce("_name", "group_name").alias("group_name"),
                   F.when(F.col("_set").isNotNull(), F.col("_desc")).otherwise(F.col("description"))
                   .alias("description")))
    touched = ok.select("gid").distinct()
    return _changed(ledger, {"groups": new}, _rejects(judged), {"groups": touched},
                    {"groups": new.join(touched, "gid", "left_semi")})


def delete_users(ledger: Ledger, batch: DataFrame, cascade: bool = False) -> ChangeResult:
    """Batch (seq, uid). Without cascade other tables keep their rows (the FK audit lists them).

    With cascade the users' expenses, memberships and the group expenses they created go. In the
    other group expenses their shares pass to the remaining participants in proportion to their own
    shares (evenly if those are 0), so that shares still add up; an expense nobody is left in goes.
    """
    b = batch.join(ledger.users.select("uid", F.lit(True).alias("_known")), "uid", "left")
    judged = _materialise(b.withColumn("reason", F.when(F.col("_known").isNull(), F.lit(R_NOT_FOUND))))
    gone = judged.filter(F.col("reason").isNull()).select("uid").distinct()
    ledger = mark_deleted(ledger, ["users", "expenses", "group_expenses"] if cascade else ["users"])
    removed = {"users": gone}
    if not cascade:
        return _changed(ledger, _without(ledger, removed), _rejects(judged), removed)
    dead = ledger.expenses.join(gone, "uid", "left_semi").select("eid")
    created = ledger.group_expenses.join(gone, "uid", "left_semi").select("geid")
    left = ledger.split_users.join(gone, "uid", "left_semi").select("geid").distinct().join(created, "geid", "left_anti")
    # one row per expense that lost a participant: its amount, and what those who stay hold of it
    stay = ledger.split_users.join(left, "geid", "left_semi").join(gone, "uid", "left_anti")
    held = stay.groupBy("geid").agg(exact_sum("split_amount").alias("_held"), F.count("uid").alias("_n"))
    lost = _materialise(ledger.group_expenses.select("geid", "amount").join(left, "geid", "left_semi").join(held, "geid", "left"))
    shares = conform(stay.join(lost, "geid").withColumn("split_amount", F.when(
        F.col("_held") > 0, F.col("split_amount") * F.col("amount") / F.col("_held")).otherwise(F.col("amount") / F.col("_n"))),
        "split_users")
    empty = created.unionByName(lost.filter(F.col("_n").isNull()).select("geid"))
    removed |= {"expenses": gone, "expenses_tags": dead, "user_group": gone, "group_expense_tags": empty,
                "split_users": created.unionByName(lost.select("geid")), "group_expenses": empty}
    tables = _without(ledger, removed)
    tables["split_users"] = conform(tables["split_users"], "split_users").unionByName(shares)
    return _changed(ledger, tables, _rejects(judged), removed, {"split_users": shares})


def delete_tags(ledger: Ledger, batch: DataFrame, cascade: bool = False) -> ChangeResult:
    """Batch (seq, tag_name), matched after strip + lower."""
    b = batch.withColumn("tag_name", norm_name("tag_name")).join(ledger.tags, "tag_name", "left")
    judged = _materialise(b.withColumn("reason", F.when(F.col("tid").isNull(), F.lit(R_NOT_FOUND))))
    gone = judged.filter(F.col("reason").isNull()).select("tid").distinct()
    ledger = mark_deleted(ledger, ["tags"])
    removed = {"tags": gone}
    if cascade:
        removed |= {"expenses_tags": gone, "group_expense_tags": gone}
    return _changed(ledger, _without(ledger, removed), _rejects(judged), removed)


# ---------------------------------------------------------------- M12

def delete_groups(ledger: Ledger, batch: DataFrame) -> ChangeResult:
    """Batch (seq, actor_uid, group_name); needs R11 scope; cascades to the group's
    splits, expense tags, expenses and memberships."""
    b = _scope_ok(ledger, batch.join(ledger.groups.select("gid", "group_name"), "group_name", "left"))
    reason = _first_failing((F.col("gid").isNull(), R_UNKNOWN_GROUP), (~F.col("_scope"), R_NO_SCOPE))
    judged = _materialise(b.withColumn("reason", reason))
    gids = judged.filter(F.col("reason").isNull()).select("gid").distinct()
    geids = ledger.group_expenses.join(gids, "gid", "left_semi").select("geid")
    ledger = mark_deleted(ledger, ["groups", "group_expenses"])
    removed = {"split_users": geids, "group_expense_tags": geids, "group_expenses": gids, "user_group": gids,
               "groups": gids}
    return _changed(ledger, _without(ledger, removed), _rejects(judged), removed)
