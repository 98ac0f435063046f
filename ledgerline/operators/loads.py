"""Validated bulk loads: personal expenses (M7, M14), group imports (M15), even splits.

A load takes a batch with a unique ``seq`` and returns a :class:`LoadResult`:
the ledger with the accepted rows added, the accepted rows, and the rejects
``(seq, reason)``. Accepted + rejected = input. Rows are atomic: a rejected row
adds nothing (no tag, category or method is created for it). Every rule is a
Column expression or a join against a dimension; ids come from
:func:`ledgerline.operators.ids.allocate_ids`.

Reasons are checked in the reference's order; the first failing rule wins.
Calling a load runs its validation checkpoint and id allocation (eager jobs),
so the ids of a result never change between the actions that consume it.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.parse import parse_amount, parse_amount_list, parse_date
from ledgerline.functions.text import has_duplicates, norm_name, split_list, strip
from ledgerline.operators.ids import allocate_ids, next_id_base
from ledgerline.schema import Ledger, conform
from ledgerline.session import checkpoint_dir, staged

# Reject reasons.
R_INVALID_AMOUNT = "invalid amount"
R_INVALID_DATE = "invalid date"
R_MISSING_NAMES = "missing category or payment method"
R_UNKNOWN_CATEGORY = "unknown category"
R_UNKNOWN_METHOD = "unknown payment method"
R_NOT_POSITIVE = "amount must be positive"
R_TAG_CASE = "tag not lower-case"
R_REPEATED_TAG = "repeated tag"
R_MISSING_FIELD = "missing required field"
R_REPEATED_PARTICIPANT = "repeated participant"
R_NEGATIVE_SHARE = "negative share"
R_ACTOR_NOT_MEMBER = "actor not a member"
R_NON_MEMBER = "participant not a member"
R_TOO_FEW = "fewer than two participants"
R_UNKNOWN_GROUP = "unknown group"
R_NO_ACCESS = "no access to group"
R_UNKNOWN_IMPORTER = "unknown importer"

SPLIT_TOLERANCE = 0.01


@dataclass
class LoadResult:
    ledger: Ledger
    accepted: DataFrame
    rejects: DataFrame
    extra: dict = field(default_factory=dict)
    #: new rows per table: what storing the result appends
    added: dict = field(default_factory=dict)
    removed: dict = field(default_factory=dict)


def _result(ledger: Ledger, added: dict, accepted: DataFrame, rejects: DataFrame | None, extra: dict) -> LoadResult:
    added = {t: conform(df, t) for t, df in added.items()}
    return LoadResult(ledger.with_rows(**added), accepted, rejects, extra, added)


def _materialise(judged: DataFrame) -> DataFrame:
    """Cut the lineage of a judged batch: rejects, accepted rows, new dimension rows and
    ids all read one checkpointed copy (in the shared checkpoint folder) instead of
    re-running parsing and lookups, and a lost executor re-reads it."""
    checkpoint_dir(judged.sparkSession)
    return judged.checkpoint(eager=True)


def _first_failing(*rules: tuple[Column, str]) -> Column:
    expr = None
    for cond, reason in rules:
        expr = F.when(cond, F.lit(reason)) if expr is None else expr.when(cond, F.lit(reason))
    return expr


def name_lookup(dim: DataFrame, name_col: str, id_col: str, lower: bool) -> DataFrame:
    """name -> lowest id (duplicate names in a dimension resolve to the first row)."""
    key = F.lower(name_col) if lower else F.col(name_col)
    return dim.groupBy(key.alias("_name")).agg(F.min(id_col).alias(id_col))


def _lookup(df: DataFrame, dim_lookup: DataFrame, col: str, id_col: str) -> DataFrame:
    return df.join(dim_lookup.withColumnRenamed("_name", col + "_key"),
                   df[col] == F.col(col + "_key"), "left").drop(col + "_key")


def _new_names(ledger: Ledger, names: DataFrame, table: str, name_col: str, id_col: str) -> DataFrame:
    """Names (with their first seq) missing from the dimension -> new dimension rows."""
    dim = ledger.table(table)
    missing = (names.groupBy(F.col("_name").alias(name_col)).agg(F.min("seq").alias("_first"))
               .join(dim.select(name_col), name_col, "left_anti"))
    if missing.isEmpty():  # the usual case: one short job instead of an allocation
        return dim.select(id_col, name_col).filter(F.lit(False))  # known to be empty: joins with it are dropped
    # staged, so the planner knows their size
    return allocate_ids(missing, ["_first", name_col], id_col, next_id_base(ledger, table), stage=True).select(
        id_col, name_col)


def _fill(rows: DataFrame, new: DataFrame, name: str, dim_name: str, id_col: str) -> DataFrame:
    """``rows`` with the id of a newly created dimension row where none was known before."""
    found = new.select(F.col(dim_name).alias("_new_name"), F.col(id_col).alias("_new_id"))
    return (rows.join(found, rows[name] == F.col("_new_name"), "left")
            .withColumn(id_col, F.coalesce(id_col, "_new_id")).drop("_new_name", "_new_id"))


def _link_tags(ledger: Ledger, links: DataFrame, key: str, uses: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(key, seq, _name) tag uses -> (new tags rows, (key, tid) links); ``uses``: the same (seq, _name) without the key."""
    new_tags = _new_names(ledger, (links if uses is None else uses).select("seq", "_name"), "tags", "tag_name", "tid")
    all_tags = ledger.tags.unionByName(new_tags)
    bridge = (links.join(all_tags.withColumnRenamed("tag_name", "_name"), "_name")
              .select(key, "tid"))
    return new_tags, bridge


# ---------------------------------------------------------------- M7 / M14

def prepare_expense_text(batch: DataFrame) -> DataFrame:
    """Parse the text columns of a personal import row."""
    return batch.select(
        "seq", "uid",
        parse_amount("amount").alias("amount_v"),
        parse_date("date").alias("date_v"),
        F.col("category").isNull().alias("_no_cat"),
        F.col("payment_method").isNull().alias("_no_pm"),
        norm_name("category").alias("category"),
        norm_name("payment_method").alias("payment_method"),
        F.col("description"),
        split_list("tag").alias("tags"))


def _tag_rules(tags: Column) -> list[tuple[Column, str]]:
    return [(F.exists(tags, lambda t: t != F.lower(t)), R_TAG_CASE),
            (has_duplicates(tags), R_REPEATED_TAG)]


def _amount_rules(amount: Column) -> list[tuple[Column, str]]:
    return [(amount <= 0, R_NOT_POSITIVE)]


def _accept_expenses(ledger: Ledger, ok: DataFrame) -> LoadResult:
    """Allocate eids for accepted rows (seq order) and add them with their tags."""
    ok = allocate_ids(ok, ["seq"], "eid", next_id_base(ledger, "expenses"))
    new_exp = conform(ok, "expenses")
    links = ok.select("eid", "seq", F.explode("tags").alias("_name"))
    new_tags, bridge = _link_tags(ledger, links, "eid")
    accepted = ok.select(*new_exp.columns, F.array_join(F.array_sort("tags"), ", ").alias("tags"))
    return _result(ledger, {"tags": new_tags, "expenses": new_exp, "expenses_tags": bridge}, accepted, None,
                   {"new_tags": new_tags, "new_links": bridge})


def import_expenses(ledger: Ledger, batch: DataFrame, ci_methods: bool = False) -> LoadResult:
    """Rows of a personal import file (text) for the acting user ``uid`` of each row.

    Category and method must match exactly after strip + lower (so a stored
    ``Online`` is not found; ``ci_methods=True`` compares lower-cased stored
    methods instead); tags keep their case and are then held to the table's
    lower-case rule (M7).
    """
    p = prepare_expense_text(batch)
    p = _lookup(p, name_lookup(ledger.categories, "category_name", "cid", False), "category", "cid")
    p = _lookup(p, name_lookup(ledger.payment_methods, "method", "pid", ci_methods), "payment_method", "pid")
    reason = _first_failing(
        (F.col("amount_v").isNull(), R_INVALID_AMOUNT),
        (F.col("date_v").isNull(), R_INVALID_DATE),
        (F.col("_no_cat") | F.col("_no_pm"), R_MISSING_NAMES),
        (F.col("cid").isNull(), R_UNKNOWN_CATEGORY),
        (F.col("pid").isNull(), R_UNKNOWN_METHOD),
        *_amount_rules(F.col("amount_v")),
        *_tag_rules(F.col("tags")))
    judged = _materialise(p.withColumn("reason", reason))
    rejects = judged.filter(F.col("reason").isNotNull()).select("seq", "reason")
    ok = (judged.filter(F.col("reason").isNull())
          .select("seq", "uid", F.col("amount_v").alias("amount"), "cid", "pid",
                  F.col("date_v").alias("date"), "description", "tags"))
    res = _accept_expenses(ledger, ok)
    res.rejects = rejects
    return res


def add_expenses(ledger: Ledger, batch: DataFrame) -> LoadResult:
    """M7: typed rows (seq, uid, amount, category, payment_method, date, description, tags).

    Category and method are found case-insensitively (first id on duplicates);
    tags are found or created.
    """
    p = batch.select("seq", "uid", "amount", norm_name("category").alias("category"),
                     norm_name("payment_method").alias("payment_method"), "date", "description",
                     F.transform(F.coalesce("tags", F.array().cast("array<string>")), strip).alias("tags"))
    p = _lookup(p, name_lookup(ledger.categories, "category_name", "cid", True), "category", "cid")
    p = _lookup(p, name_lookup(ledger.payment_methods, "method", "pid", True), "payment_method", "pid")
    reason = _first_failing(
        (F.col("amount").isNull() | F.isnan("amount"), R_INVALID_AMOUNT),
        *_amount_rules(F.col("amount")),
        (F.col("cid").isNull(), R_UNKNOWN_CATEGORY),
        (F.col("pid").isNull(), R_UNKNOWN_METHOD),
        (F.col("date").isNull(), R_INVALID_DATE),
        *_tag_rules(F.col("tags")))
    judged = _materialise(p.withColumn("reason", reason))
    rejects = judged.filter(F.col("reason").isNotNull()).select("seq", "reason")
    ok = judged.filter(F.col("reason").isNull()).drop("reason", "category", "payment_method")
    res = _accept_expenses(ledger, ok)
    res.rejects = rejects
    return res


# ---------------------------------------------------------------- M15

def import_group(ledger: Ledger, batch: DataFrame, importer_uid: int, as_of=None,
                 source: str | None = None) -> LoadResult:
    """Rows of group import files; ``group_name`` of each row names its group.

    An existing group takes rows only from its members and Admins; an unknown
    importer has every row rejected.
    Missing groups are created with the importer as member. Categories are
    created when missing; payment methods only when the importer is an Admin.
    Shares: given amounts when they match the names (first one adjusted when off
    by more than 0.01), else an even split over all names, unknown ones included;
    unknown names are dropped with their share. ``as_of`` dates new groups
    (default: today, fixed once on the driver); ``source`` names the file in
    their description. A row without a group name is rejected.
    """
    as_of = as_of or _dt.date.today()
    # the importer's name and role: scalar subqueries over one primary-key row
    me = (ledger.users.filter(F.col("uid") == F.lit(importer_uid))
          .agg(F.struct(F.max("username").alias("n"), F.max(F.col("role") == "Admin").alias("a"))).scalar())
    b = batch.withColumn("_importer", me["n"]).withColumn("_is_admin", me["a"])
    nonempty = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    required = nonempty("amount") & nonempty("category_name") & nonempty("payment_method") & nonempty("expense_date")

    cat_lookup = name_lookup(ledger.categories, "category_name", "cid", True)
    pm_lookup = name_lookup(ledger.payment_methods, "method", "pid", True)
    users = ledger.users.select("uid", "username")
    b = (b.withColumn("cat_name", F.lower("category_name"))
         .withColumn("pm_name", F.lower("payment_method"))
         .withColumn("amount_v", parse_amount("amount"))
         .withColumn("date_v", parse_date("expense_date"))
         .withColumn("tag_list", F.transform(split_list("tags"), F.lower))
         .withColumn("names", split_list("split_usernames"))
         .withColumn("given", F.when(F.size("names") > 0, split_list("split_amounts"))
                     .otherwise(F.array().cast("array<string>")))
         .withColumn("names", F.when(F.array_contains("names", F.col("_importer")), F.col("names"))
                     .otherwise(F.concat("names", F.array("_importer")))))
    b = _lookup(b, cat_lookup, "cat_name", "cid")
    b = _lookup(b, pm_lookup, "pm_name", "pid")
    # the stored group of each row, and whether the importer may write to it
    mine = ledger.user_group.filter(F.col("uid") == F.lit(importer_uid)).select("gid", F.lit(True).alias("_member"))
    known = ledger.groups.select("gid", F.col("group_name").alias("_group")).join(mine, "gid", "left")
    b = b.join(known, F.col("group_name") == F.col("_group"), "left").drop("_group")

    # parsed amounts and their total are columns of their own, so each is computed once per row
    n = F.size("names")
    b = b.withColumn("_given_v", parse_amount_list(F.coalesce("split_amounts", F.lit("")), "given"))
    b = b.withColumn("_total", F.aggregate("_given_v", F.lit(0.0), lambda acc, x: acc + x))
    given_v, total = F.col("_given_v"), F.col("_total")
    use_given = (F.size("given") > 0) & (F.size("given") == n) & given_v.isNotNull()
    adjusted = F.when(F.abs(total - F.col("amount_v")) > SPLIT_TOLERANCE,
                      F.transform(given_v, lambda x, i: F.when(i == 0, x + (F.col("amount_v") - total))
                                  .otherwise(x))).otherwise(given_v)
    even = F.transform("names", lambda _: F.col("amount_v") / n)
    b = b.withColumn("shares", F.when(use_given, adjusted).otherwise(even))

    is_admin = F.coalesce(F.col("_is_admin"), F.lit(False))
    reason = _first_failing(
        (F.col("_importer").isNull(), R_UNKNOWN_IMPORTER),
        (F.col("group_name").isNull() | (strip("group_name") == ""), R_UNKNOWN_GROUP),
        (F.col("gid").isNotNull() & F.col("_member").isNull() & ~is_admin, R_NO_ACCESS),
        (~required, R_MISSING_FIELD),
        (F.col("pid").isNull() & ~is_admin, R_UNKNOWN_METHOD),
        (F.col("amount_v").isNull(), R_INVALID_AMOUNT),
        *_amount_rules(F.col("amount_v")),
        (F.col("date_v").isNull(), R_INVALID_DATE),
        (has_duplicates(F.col("tag_list")), R_REPEATED_TAG),
        (has_duplicates(F.col("names")), R_REPEATED_PARTICIPANT),
        (F.exists("shares", lambda s: s < 0), R_NEGATIVE_SHARE))
    # a number of its own for every row: what is split off below meets its row again by it, whatever seq repeats
    judged = staged(b.select(
        F.monotonically_increasing_id().alias("_row"), "seq", reason.alias("reason"), "_importer", "gid", "cid", "pid",
        "cat_name", "pm_name", "amount_v", "date_v", "tag_list", "names", "shares",
        *(F.col(c).cast("string").alias(c) for c in ("group_name", "creator_username", "expense_description"))), "judged")
    rejects = judged.filter(F.col("reason").isNotNull()).select("seq", "reason")
    ok = judged.filter(F.col("reason").isNull())

    # groups: missing ones are created (importer becomes a member)
    new_groups = ok.filter(F.col("gid").isNull()).groupBy("group_name").agg(F.min("seq").alias("_first"))
    new_groups = (new_groups.withColumn("gid", F.lit(None).cast("long")).filter(F.lit(False)) if new_groups.isEmpty() else
                  allocate_ids(new_groups, ["_first", "group_name"], "gid", next_id_base(ledger, "groups"), stage=True))
    new_groups = new_groups.select(
        "gid", F.lit(as_of).alias("date_created"), "group_name",
        (F.lit(f"Imported group from {source}") if source else
         F.concat(F.lit("Imported group from batch row "), F.col("_first").cast("string"))).alias("description"))
    new_members = new_groups.select(F.lit(importer_uid).cast("long").alias("uid"), "gid")

    # categories and (Admin only) methods created from accepted rows
    new_cats = _new_names(ledger, ok.filter(F.col("cid").isNull()).select("seq", F.col("cat_name").alias("_name")),
                          "categories", "category_name", "cid")
    new_pms = _new_names(ledger, ok.filter(F.col("pid").isNull()).select("seq", F.col("pm_name").alias("_name")),
                         "payment_methods", "method", "pid")
    # creators and ids are looked up for (row, seq) alone; no list or text of a row is dealt for them
    found = (ok.select("_row", "seq", "creator_username")
             .join(users.select(F.col("uid").alias("_cuid"), F.col("username").alias("creator_username")),
                   "creator_username", "left")
             .select("_row", "seq", F.coalesce("_cuid", F.lit(importer_uid).cast("long")).alias("uid")))
    ids = allocate_ids(found, ["seq"], "geid", next_id_base(ledger, "group_expenses"), stage=True).drop("seq")
    # ids found before the rows were stored stay; only the new rows' ids are filled in
    facts = _fill(ok, new_cats, "cat_name", "category_name", "cid")
    facts = _fill(facts, new_pms, "pm_name", "method", "pid")
    facts = _fill(facts, new_groups, "group_name", "group_name", "gid")
    added = facts.join(ids, "_row").select(
        "geid", "uid", "gid", F.col("amount_v").alias("amount"), "cid", "pid",
        F.col("date_v").alias("date"), F.col("expense_description").alias("description"), "seq")
    new_ge = added.drop("seq")
    geids = ids.select("_row", "geid")
    links = (ok.select("_row", "seq", "tag_list").join(geids, "_row")
             .select("geid", "seq", F.explode("tag_list").alias("_name")))
    new_tags, bridge = _link_tags(ledger, links, "geid", ok.select("seq", F.explode("tag_list").alias("_name")))
    # the importer is in every row: that share needs no join, so one hot name never meets the users table
    shares = (ok.select("_row", "_importer", "names", "shares").join(geids, "_row")
              .select("geid", "_importer", F.explode(F.arrays_zip("names", "shares")).alias("z"))
              .select("geid", "_importer", F.col("z.names").alias("username"), F.col("z.shares").alias("split_amount")))
    own = F.col("username") == F.col("_importer")
    splits = (shares.filter(~own).join(users, "username").select("geid", "uid", "split_amount")
              .unionByName(shares.filter(own).select("geid", F.lit(importer_uid).cast("long").alias("uid"),
                                                     "split_amount")))
    rows = {"groups": new_groups, "user_group": new_members, "categories": new_cats, "payment_methods": new_pms,
            "tags": new_tags, "group_expenses": new_ge, "group_expense_tags": bridge, "split_users": splits}
    return _result(ledger, rows, added, rejects, {"splits": splits, "new_categories": new_cats, "new_methods": new_pms,
                                                  "new_groups": new_groups, "new_tags": new_tags})


# ---------------------------------------------------------------- M13

def add_group_expenses(ledger: Ledger, batch: DataFrame) -> LoadResult:
    """Batch (seq, actor_uid, group_name, amount, category, payment_method, date,
    description, tags array, split_usernames array) -> even splits.

    The actor must be a member (or Admin); participants are the listed names
    plus the actor, deduplicated; unknown names are dropped; a known
    non-member rejects the row; fewer than two participants reject it. Each
    participant's share is amount / participants (unrounded).
    """
    users = ledger.users.select("uid", "username", "role")
    b = (batch.join(ledger.groups.select("gid", "group_name"), "group_name", "left")
         .join(users.select(F.col("uid").alias("actor_uid"), F.col("username").alias("_actor"),
                            F.col("role").alias("_actor_role")), "actor_uid", "left")
         .join(ledger.user_group.select(F.col("uid").alias("actor_uid"), "gid",
                                        F.lit(True).alias("_actor_in")), ["actor_uid", "gid"], "left")
         .withColumn("category", norm_name("category"))
         .withColumn("payment_method", norm_name("payment_method"))
         .withColumn("tag_list", F.transform(F.coalesce("tags", F.array().cast("array<string>")),
                                             lambda t: F.lower(strip(t))))
         .withColumn("people", F.array_distinct(F.filter(
             F.concat(F.coalesce("split_usernames", F.array().cast("array<string>")), F.array("_actor")),
             lambda x: x.isNotNull()))))
    b = _lookup(b, name_lookup(ledger.categories, "category_name", "cid", True), "category", "cid")
    b = _lookup(b, name_lookup(ledger.payment_methods, "method", "pid", True), "payment_method", "pid")
    # per-row participant check: explode, look up, count -- rows are judged by their own seq
    people = (b.select("seq", "gid", F.explode("people").alias("username"))
              .join(users.select("uid", "username"), "username", "left")
              .join(ledger.user_group.select("uid", "gid", F.lit(True).alias("_member")), ["uid", "gid"], "left"))
    counts = people.groupBy("seq").agg(
        F.count(F.when(F.col("uid").isNotNull() & F.col("_member").isNull(), 1)).alias("_outsiders"),
        F.count(F.when(F.col("_member").isNotNull(), 1)).alias("_kept"))
    b = b.join(counts, "seq", "left")
    reason = _first_failing(
        (F.col("gid").isNull(), R_UNKNOWN_GROUP),
        (F.col("_actor_in").isNull() & (F.coalesce(F.col("_actor_role"), F.lit("")) != "Admin"),
         R_ACTOR_NOT_MEMBER),
        (F.col("cid").isNull(), R_UNKNOWN_CATEGORY),
        (F.col("pid").isNull(), R_UNKNOWN_METHOD),
        (F.coalesce("_outsiders", F.lit(0)) > 0, R_NON_MEMBER),
        (F.coalesce("_kept", F.lit(0)) < 2, R_TOO_FEW),
        (F.col("amount").isNull() | F.isnan("amount"), R_INVALID_AMOUNT),
        *_amount_rules(F.col("amount")),
        (F.col("date").isNull(), R_INVALID_DATE),
        (has_duplicates(F.col("tag_list")), R_REPEATED_TAG))
    judged = _materialise(b.withColumn("reason", reason))
    rejects = judged.filter(F.col("reason").isNotNull()).select("seq", "reason")
    ok = judged.filter(F.col("reason").isNull()).withColumn("uid", F.col("actor_uid"))
    ok = allocate_ids(ok, ["seq"], "geid", next_id_base(ledger, "group_expenses"))
    new_ge = conform(ok, "group_expenses")
    splits = (ok.select("geid", "gid", "amount", "_kept", F.explode("people").alias("username"))
              .join(users.select("uid", "username"), "username")
              .join(ledger.user_group, ["uid", "gid"], "left_semi")
              .select("geid", "uid", (F.col("amount") / F.col("_kept")).alias("split_amount")))
    links = ok.select("geid", "seq", F.explode("tag_list").alias("_name"))
    new_tags, bridge = _link_tags(ledger, links, "geid")
    return _result(ledger, {"tags": new_tags, "group_expenses": new_ge, "split_users": splits,
                            "group_expense_tags": bridge}, new_ge, rejects, {"splits": splits, "new_tags": new_tags})


# ---------------------------------------------------------------- file entry points

def import_expense_file(ledger: Ledger, path: str, uid: int) -> LoadResult:
    """M14 from a CSV file (set) of one acting user: read by header name, then validate and add."""
    from ledgerline.sources.csv_io import read_expense_csv

    batch = read_expense_csv(ledger.users.sparkSession, path).withColumn("uid", F.lit(uid).cast("long"))
    return import_expenses(ledger, batch)


def import_group_file(ledger: Ledger, path: str, group_name: str, importer_uid: int, as_of=None) -> LoadResult:
    """M15 from a group CSV file: every row goes to ``group_name`` (the file's own
    group_name column is ignored, as in the reference)."""
    from ledgerline.sources.csv_io import read_group_csv

    batch = read_group_csv(ledger.users.sparkSession, path).withColumn("group_name", F.lit(group_name))
    return import_group(ledger, batch, importer_uid, as_of, source=path)
