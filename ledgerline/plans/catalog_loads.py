"""Catalogue part 2: CSV sources and sinks, parsing, and the validated loads.

The batches come from :mod:`ledgerline.sources.batches`; their SQL twins below
derive the same text rows from the same tables, so each oracle re-runs the
whole import in DuckDB -- parsing, rules, lookups, id allocation and splits.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions.parse import DATE_PATTERN, NUMBER_PATTERN, parse_amount, parse_date
from ledgerline.functions.text import WHITESPACE, month, norm_name, split_list
from ledgerline.operators import exports as X
from ledgerline.operators import loads as M
from ledgerline.plans.catalog import VIEWS
from ledgerline.plans.registry import register
from ledgerline.session import scratch_path
from ledgerline.sources import batches as B
from ledgerline.sources import csv_io
from ledgerline.sources.testdata import ledger_from_testdata

SAMPLE_UID = 5
MEMBER_UID = 120  # an ordinary user in one group only


def _strip_sql(x: str) -> str:
    return f"trim({x}, '{WHITESPACE}')"


def _amount_sql(x: str) -> str:
    t = _strip_sql(x)
    v = f"TRY_CAST(replace({t}, '_', '') AS DOUBLE)"
    return (f"(CASE WHEN regexp_full_match({t}, '{NUMBER_PATTERN}') AND isfinite({v}) "
            f"THEN {v} END)")


def _date_sql(x: str) -> str:
    return (f"(CASE WHEN regexp_full_match({x}, '{DATE_PATTERN}') "
            f"THEN CAST(try_strptime({x}, '%Y-%m-%d') AS DATE) END)")


def _split_sql(x: str) -> str:
    return (f"list_filter(list_transform(string_split(COALESCE({x}, ''), ','), "
            f"lambda s: {_strip_sql('s')}), lambda s: s <> '')")


_AMOUNT_TEXT = """CASE WHEN o.o_orderkey % 17 = 0 THEN 'abc' WHEN o.o_orderkey % 19 = 0 THEN '-5'
     WHEN o.o_orderkey % 23 = 0 THEN '' ELSE CAST(o.o_totalprice AS VARCHAR) END"""
_DATE_TEXT = """CASE WHEN o.o_orderkey % 29 = 0 THEN '2024-02-30'
     WHEN o.o_orderkey % 31 = 0 THEN CAST(year(o.o_orderdate) AS VARCHAR) || '-' || CAST(month(o.o_orderdate) AS VARCHAR)
          || '-' || CAST(day(o.o_orderdate) AS VARCHAR)
     ELSE strftime(CAST(o.o_orderdate AS DATE), '%Y-%m-%d') END"""

PERSONAL_CTES = {
    "order_tags": """SELECT et.eid AS k, string_agg(t.tag_name, ',' ORDER BY t.tag_name) AS tag_text
        FROM expenses_tags et JOIN tags t ON et.tid = t.tid GROUP BY et.eid""",
    "personal_batch": f"""SELECT CAST(o.o_orderkey AS BIGINT) AS seq, CAST(o.o_custkey AS BIGINT) AS uid,
        {_AMOUNT_TEXT} AS amount,
        CASE WHEN o.o_orderkey % 37 = 0 THEN 'unknown'
             WHEN o.o_orderkey % 3 = 0 THEN '  ' || upper(o.o_orderpriority) || ' '
             ELSE o.o_orderpriority END AS category,
        CASE WHEN o.o_orderkey % 41 = 0 THEN 'cheque' ELSE o.o_orderstatus END AS payment_method,
        {_DATE_TEXT} AS date,
        'order ' || CAST(o.o_orderkey AS VARCHAR) AS description,
        CASE WHEN o.o_orderkey % 43 = 0 THEN 'Brand#1' WHEN o.o_orderkey % 47 = 0 THEN 'brand#1,brand#1'
             ELSE COALESCE(ot.tag_text, '') END AS tag
        FROM orders o LEFT JOIN order_tags ot ON ot.k = o.o_orderkey
        WHERE o.o_orderkey % 2 = 1""",
    "pb_parsed": f"""SELECT seq, uid, {_amount_sql('amount')} AS amount_v, {_date_sql('date')} AS date_v,
        category IS NULL AS no_cat, payment_method IS NULL AS no_pm,
        lower({_strip_sql('category')}) AS category, lower({_strip_sql('payment_method')}) AS payment_method,
        description, {_split_sql('tag')} AS tags
        FROM personal_batch""",
    "pb_judged": """SELECT v.*, c.cid, p.pid,
        CASE WHEN amount_v IS NULL THEN 'invalid amount'
             WHEN date_v IS NULL THEN 'invalid date'
             WHEN no_cat OR no_pm THEN 'missing category or payment method'
             WHEN c.cid IS NULL THEN 'unknown category'
             WHEN p.pid IS NULL THEN 'unknown payment method'
             WHEN amount_v <= 0 THEN 'amount must be positive'
             WHEN len(list_filter(tags, lambda t: t <> lower(t))) > 0 THEN 'tag not lower-case'
             WHEN len(list_distinct(tags)) <> len(tags) THEN 'repeated tag'
        END AS reason
        FROM pb_parsed v
        LEFT JOIN (SELECT category_name AS name, min(cid) AS cid FROM categories GROUP BY category_name) c
               ON c.name = v.category
        LEFT JOIN (SELECT method AS name, min(pid) AS pid FROM payment_methods GROUP BY method) p
               ON p.name = v.payment_method""",
}


def _ledger(spark, sf):
    return ledger_from_testdata(spark, sf)


# ---------------------------------------------------------------- S2 / S3 sources

def _nullif_all(cols: list[str]) -> str:
    return ", ".join(f"NULLIF({c}, '') AS {c}" for c in cols)


@register("src_expense_csv", f"SELECT {_nullif_all(csv_io.EXPENSE_CSV_COLUMNS)} FROM personal_batch",
          PERSONAL_CTES)
def q_src_expense_csv(spark, sf):
    """Write the derived batch as a CSV file set, read it back by header name."""
    path = scratch_path(spark, "expense-csv")
    csv_io.write_csv(B.personal_batch(spark, sf).select(*csv_io.EXPENSE_CSV_COLUMNS), path)
    return csv_io.read_expense_csv(spark, path).drop("seq")


@register("src_expense_csv_mixed", f"SELECT {_nullif_all(csv_io.EXPENSE_CSV_COLUMNS)} FROM personal_batch",
          PERSONAL_CTES)
def q_src_expense_csv_mixed(spark, sf):
    """Files of one set with different column orders, read back by each file's own header."""
    path = scratch_path(spark, "expense-csv-mixed")
    b = B.personal_batch(spark, sf)
    turned = ["tag", "category", "amount", "date", "description", "payment_method"]
    csv_io.write_csv(b.filter(F.col("seq") % 3 == 0).select(*csv_io.EXPENSE_CSV_COLUMNS), f"{path}/first files")
    csv_io.write_csv(b.filter(F.col("seq") % 3 != 0).select(*turned), f"{path}/second+files")
    return csv_io.read_expense_csv(spark, f"{path}/*").drop("seq")


# ---------------------------------------------------------------- F parsing / normalising

@register("scalar_parse", f"SELECT seq, amount_v, date_v FROM pb_parsed", PERSONAL_CTES)
def q_scalar_parse(spark, sf):
    b = B.personal_batch(spark, sf)
    return b.select("seq", parse_amount("amount").alias("amount_v"), parse_date("date").alias("date_v"))


@register("scalar_normalise", f"""
SELECT seq, lower({_strip_sql('category')}) AS category, lower({_strip_sql('payment_method')}) AS payment_method,
       array_to_string({_split_sql('tag')}, ', ') AS tag_list,
       strftime({_date_sql('date')}, '%Y-%m') AS month
FROM personal_batch""", PERSONAL_CTES)
def q_scalar_normalise(spark, sf):
    b = B.personal_batch(spark, sf)
    return b.select("seq", norm_name("category").alias("category"),
                    norm_name("payment_method").alias("payment_method"),
                    F.array_join(split_list("tag"), ", ").alias("tag_list"),
                    month(parse_date("date")).alias("month"))


# ---------------------------------------------------------------- M14 personal import

@register("import_expenses", """
SELECT (SELECT COALESCE(max(eid), 0) FROM expenses WHERE eid % 2 = 0) + row_number() OVER (ORDER BY seq) AS eid,
       uid, amount_v AS amount, cid, pid, date_v AS date, description,
       array_to_string(list_sort(tags), ', ') AS tags
FROM pb_judged WHERE reason IS NULL
""", PERSONAL_CTES)
def q_import_expenses(spark, sf):
    return M.import_expenses(B.base_ledger(spark, sf), B.personal_batch(spark, sf)).accepted


@register("import_expense_rejects", "SELECT seq, reason FROM pb_judged WHERE reason IS NOT NULL",
          PERSONAL_CTES)
def q_import_expense_rejects(spark, sf):
    return M.import_expenses(B.base_ledger(spark, sf), B.personal_batch(spark, sf)).rejects


@register("import_new_tag_links", """
SELECT j.eid, t.tid FROM (
  SELECT (SELECT COALESCE(max(eid), 0) FROM expenses WHERE eid % 2 = 0) + row_number() OVER (ORDER BY seq) AS eid,
         tags FROM pb_judged WHERE reason IS NULL) j,
  unnest(j.tags) AS u(tag_name)
JOIN tags t ON t.tag_name = u.tag_name
""", PERSONAL_CTES)
def q_import_new_tag_links(spark, sf):
    return M.import_expenses(B.base_ledger(spark, sf), B.personal_batch(spark, sf)).extra["new_links"]


# ---------------------------------------------------------------- M15 group import

_IMP = "(SELECT username FROM users WHERE uid = 0)"

GROUP_CTES = {
    "order_tags2": """SELECT et.eid AS k, string_agg(t.tag_name, ', ' ORDER BY t.tag_name) AS tag_text
        FROM expenses_tags et JOIN tags t ON et.tid = t.tid GROUP BY et.eid""",
    "group_names": """SELECT su.geid AS k, list_sort(list(u.username)) AS names
        FROM split_users su JOIN users u ON u.uid = su.uid WHERE su.geid % 2 = 1 GROUP BY su.geid""",
    "gb_rows": f"""SELECT o.*, g.group_name, cu.username AS creator, gn.names, {_IMP} AS importer, ot.tag_text
        FROM orders o
        JOIN group_expenses ge ON ge.geid = o.o_orderkey AND ge.geid % 2 = 1
        JOIN groups g ON g.gid = ge.gid
        JOIN users cu ON cu.uid = ge.uid
        JOIN group_names gn ON gn.k = o.o_orderkey
        LEFT JOIN order_tags2 ot ON ot.k = o.o_orderkey""",
    "gb_lists": """SELECT *,
        CASE WHEN o_orderkey % 53 = 0 THEN CAST([] AS VARCHAR[])
             WHEN o_orderkey % 47 = 0 THEN list_concat(names, [names[1]])
             WHEN o_orderkey % 43 = 0 THEN list_sort(list_concat(names, ['nobody']))
             WHEN o_orderkey % 5 = 0 THEN list_filter(names, lambda n: n <> importer)
             ELSE list_sort(list_distinct(list_concat(list_filter(names, lambda n: n <> importer), [importer])))
        END AS nl
        FROM gb_rows""",
    "gb_shares": """SELECT *, list_transform(nl, lambda n: CAST(o_totalprice / greatest(len(nl), 1) AS VARCHAR)) AS shares
        FROM gb_lists""",
    "group_batch": f"""SELECT CAST(o.o_orderkey AS BIGINT) AS seq, o.group_name, '1995-01-01' AS date_created,
        '' AS description, CAST(o.o_orderkey AS VARCHAR) AS expense_id,
        CASE WHEN o.o_orderkey % 31 = 0 THEN 'nobody' ELSE o.creator END AS creator_username,
        {_AMOUNT_TEXT} AS amount,
        CASE WHEN o.o_orderkey % 37 = 0 THEN 'new category' ELSE o.o_orderpriority END AS category_name,
        CASE WHEN o.o_orderkey % 41 = 0 THEN 'cheque' ELSE o.o_orderstatus END AS payment_method,
        {_DATE_TEXT} AS expense_date,
        'order ' || CAST(o.o_orderkey AS VARCHAR) AS expense_description,
        COALESCE(o.tag_text, '') AS tags,
        array_to_string(o.nl, ', ') AS split_usernames,
        array_to_string(CASE
            WHEN o.o_orderkey % 11 = 0 THEN list_slice(o.shares, 2, len(o.shares))
            WHEN o.o_orderkey % 13 = 0 THEN list_transform(o.shares, lambda x, i: CASE WHEN i = 1 THEN 'x' ELSE x END)
            WHEN o.o_orderkey % 7 = 0 THEN list_transform(o.shares,
                 lambda x, i: CASE WHEN i = 1 THEN CAST(CAST(x AS DOUBLE) - 5 AS VARCHAR) ELSE x END)
            ELSE o.shares END, ', ') AS split_amounts
        FROM gb_shares o""",
    "gb_parsed": f"""SELECT b.*, {_IMP} AS importer,
        {_amount_sql('b.amount')} AS amount_v, {_date_sql('b.expense_date')} AS date_v,
        lower(b.category_name) AS cat_name, lower(b.payment_method) AS pm_name,
        list_transform({_split_sql('b.tags')}, lambda t: lower(t)) AS tag_list,
        {_split_sql('b.split_usernames')} AS names0,
        CASE WHEN len({_split_sql('b.split_usernames')}) > 0 THEN {_split_sql('b.split_amounts')}
             ELSE CAST([] AS VARCHAR[]) END AS given
        FROM group_batch b""",
    "gb_names": f"""SELECT p.*,
        CASE WHEN list_contains(names0, importer) THEN names0 ELSE list_append(names0, importer) END AS names,
        list_transform(given, lambda a: {_amount_sql('a')}) AS given_v
        FROM gb_parsed p""",
    "gb_total": """SELECT n.*,
        len(given) > 0 AND len(given) = len(names) AND len(list_filter(given_v, lambda a: a IS NULL)) = 0 AS use_given,
        list_reduce(list_prepend(0.0::DOUBLE, given_v), lambda a, b: a + b) AS total
        FROM gb_names n""",
    "gb_shared": """SELECT t.*,
        CASE WHEN use_given THEN
               CASE WHEN abs(total - amount_v) > 0.01
                    THEN list_transform(given_v, lambda x, i: CASE WHEN i = 1 THEN x + (amount_v - total) ELSE x END)
                    ELSE given_v END
             ELSE list_transform(names, lambda n: amount_v / len(names)) END AS split_shares
        FROM gb_total t""",
    "gb_judged": """SELECT s.*, c.cid, p.pid,
        CASE WHEN NOT (COALESCE(amount, '') <> '' AND COALESCE(category_name, '') <> ''
                       AND COALESCE(payment_method, '') <> '' AND COALESCE(expense_date, '') <> '')
               THEN 'missing required field'
             WHEN p.pid IS NULL AND NOT COALESCE((SELECT role = 'Admin' FROM users WHERE uid = 0), FALSE)
               THEN 'unknown payment method'
             WHEN amount_v IS NULL THEN 'invalid amount'
             WHEN amount_v <= 0 THEN 'amount must be positive'
             WHEN date_v IS NULL THEN 'invalid date'
             WHEN len(list_distinct(tag_list)) <> len(tag_list) THEN 'repeated tag'
             WHEN len(list_distinct(names)) <> len(names) THEN 'repeated participant'
             WHEN len(list_filter(split_shares, lambda x: x < 0)) > 0 THEN 'negative share'
        END AS reason
        FROM gb_shared s
        LEFT JOIN (SELECT lower(category_name) AS name, min(cid) AS cid FROM categories GROUP BY 1) c
               ON c.name = s.cat_name
        LEFT JOIN (SELECT lower(method) AS name, min(pid) AS pid FROM payment_methods GROUP BY 1) p
               ON p.name = s.pm_name""",
    "gb_ok": "SELECT * FROM gb_judged WHERE reason IS NULL",
    "new_cats": """SELECT cat_name AS category_name,
        (SELECT max(cid) FROM categories) + row_number() OVER (ORDER BY min(seq), cat_name) AS cid
        FROM gb_ok WHERE cid IS NULL GROUP BY cat_name""",
    "new_pms": """SELECT pm_name AS method,
        (SELECT max(pid) FROM payment_methods) + row_number() OVER (ORDER BY min(seq), pm_name) AS pid
        FROM gb_ok WHERE pid IS NULL GROUP BY pm_name""",
    "gb_accepted": """SELECT (SELECT COALESCE(max(geid), 0) FROM group_expenses WHERE geid % 2 = 0)
               + row_number() OVER (ORDER BY k.seq) AS geid,
        COALESCE(cu.uid, 0) AS uid, g.gid, k.amount_v AS amount,
        COALESCE(k.cid, nc.cid) AS cid, COALESCE(k.pid, np.pid) AS pid,
        k.date_v AS date, k.expense_description AS description, k.seq, k.names, k.split_shares
        FROM gb_ok k
        JOIN groups g ON g.group_name = k.group_name
        LEFT JOIN users cu ON cu.username = k.creator_username
        LEFT JOIN new_cats nc ON nc.category_name = k.cat_name
        LEFT JOIN new_pms np ON np.method = k.pm_name""",
}


@register("src_group_csv", f"SELECT {_nullif_all(csv_io.GROUP_CSV_COLUMNS)} FROM group_batch", GROUP_CTES)
def q_src_group_csv(spark, sf):
    path = scratch_path(spark, "group-csv")
    csv_io.write_csv(B.group_batch(spark, sf).select(*csv_io.GROUP_CSV_COLUMNS), path)
    return csv_io.read_group_csv(spark, path).drop("seq")


def _import_group(spark, sf, importer_uid):
    """M15 of the batch into the base ledger, both of one mapping."""
    full = ledger_from_testdata(spark, sf, stage=("group_expenses", "split_users"))
    return M.import_group(B.base_ledger(spark, sf, full), B.group_batch(spark, sf, full), importer_uid)


@register("import_group", """
SELECT geid, uid, gid, amount, cid, pid, date, description, seq FROM gb_accepted
""", GROUP_CTES)
def q_import_group(spark, sf):
    return _import_group(spark, sf, B.IMPORTER_UID).accepted


@register("import_group_rejects", "SELECT seq, reason FROM gb_judged WHERE reason IS NOT NULL", GROUP_CTES)
def q_import_group_rejects(spark, sf):
    return _import_group(spark, sf, B.IMPORTER_UID).rejects


# an ordinary user who is a member of one group only: rows of all other groups are refused
_MEMBER_CTES = dict(GROUP_CTES)
_MEMBER_CTES["gb_parsed"] = GROUP_CTES["gb_parsed"].replace(_IMP, _IMP.replace("uid = 0", f"uid = {MEMBER_UID}"))
_MEMBER_CTES["gb_judged"] = (
    GROUP_CTES["gb_judged"].replace("uid = 0", f"uid = {MEMBER_UID}")
    .replace("SELECT s.*, c.cid, p.pid,\n        CASE", f"""SELECT s.*, c.cid, p.pid,
        CASE WHEN s.group_name NOT IN (SELECT g.group_name FROM groups g JOIN user_group m ON m.gid = g.gid
                                       WHERE m.uid = {MEMBER_UID}) THEN 'no access to group'"""))


@register("import_group_member", """
SELECT seq, COALESCE(reason, 'accepted') AS outcome FROM gb_judged
""", _MEMBER_CTES)
def q_import_group_member(spark, sf):
    """M15's scope rule: every row of the batch with its outcome, accepted ones included."""
    res = _import_group(spark, sf, MEMBER_UID)
    return (res.accepted.select("seq", F.lit("accepted").alias("outcome"))
            .unionByName(res.rejects.withColumnRenamed("reason", "outcome")))


@register("import_group_splits", """
SELECT a.geid, u.uid, s.split_amount FROM (
  SELECT geid, unnest(names) AS username, unnest(split_shares) AS split_amount FROM gb_accepted) s
JOIN gb_accepted a ON a.geid = s.geid
JOIN users u ON u.username = s.username
""", GROUP_CTES)
def q_import_group_splits(spark, sf):
    return _import_group(spark, sf, B.IMPORTER_UID).extra["splits"]


@register("import_group_new_categories", "SELECT cid, category_name FROM new_cats", GROUP_CTES)
def q_import_group_new_categories(spark, sf):
    return _import_group(spark, sf, B.IMPORTER_UID).extra["new_categories"]


# ---------------------------------------------------------------- S4 / S5 sinks

def _export_sql(uid: int | None = None) -> str:
    """Export text of the personal layout; the user's name only when all users are exported."""
    who, keep = ('username AS "User", ', "TRUE") if uid is None else ("", f"uid = {uid}")
    return f"""SELECT eid::VARCHAR AS "ID", {who}amount::VARCHAR AS "Amount", category_name AS "Category",
       method AS "Payment Method", date::VARCHAR AS "Date", ifnull(description, '') AS "Description",
       ifnull(tags, '') AS "Tags"
FROM (SELECT * FROM named WHERE {keep}) JOIN (SELECT uid, username FROM users) USING (uid)
LEFT JOIN tag_list USING (eid)"""


@register("export_expenses_all", _export_sql(), VIEWS)
def q_export_expenses_all(spark, sf):
    return X.expense_export(_ledger(spark, sf), "date")


@register("export_expenses_user", _export_sql(SAMPLE_UID), VIEWS)
def q_export_expenses_user(spark, sf):
    return X.expense_export(_ledger(spark, sf), "amount", uid=SAMPLE_UID)


# every sort field, written as files and read back (empty fields come back as NULL)
@register("export_expenses_files", f"""
SELECT f AS sorted_by, {", ".join(f'NULLIF("{c}", \'\') AS "{c}"' for c in X.ALL_USERS_HEADER)}
FROM ({_export_sql()}), unnest({sorted(X.PERSONAL_SORT)}) AS fields(f)
""", VIEWS)
def q_export_expenses_files(spark, sf):
    path = scratch_path(spark, "expense-export")
    for name in X.PERSONAL_SORT:
        csv_io.write_csv(X.expense_export(_ledger(spark, sf), name), f"{path}/sorted_by={name}")
    return spark.read.option("header", True).option("escape", '"').csv(path)


# each list is sorted once as pairs of name and share, then read by part
_GROUP_EXPORT_SQL = f"""
WITH shares AS (SELECT geid, list_sort(list({{'who': username, 'part': split_amount}})) AS pairs
                FROM split_users JOIN (SELECT uid, username FROM users) USING (uid) GROUP BY geid),
labels AS (SELECT geid, array_to_string(list_sort(list(tag_name)), ', ') AS tags
           FROM group_expense_tags JOIN tags USING (tid) GROUP BY geid),
about AS (SELECT gid, CAST(date_created AS VARCHAR) AS date_created, ifnull(description, '') AS about FROM groups)
SELECT group_name, date_created, about AS description, geid::VARCHAR AS expense_id, username AS creator_username,
       amount::VARCHAR AS amount, category_name, method AS payment_method, spent_on::VARCHAR AS expense_date,
       ifnull(description, '') AS expense_description, ifnull(tags, '') AS tags,
       ifnull(array_to_string(list_transform(pairs, lambda p: p.who), ', '), '') AS split_usernames,
       ifnull(array_to_string(list_transform(pairs, lambda p: p.part::VARCHAR), ', '), '') AS split_amounts
FROM group_named JOIN about USING (gid) JOIN (SELECT uid, username FROM users) USING (uid)
LEFT JOIN labels USING (geid) LEFT JOIN shares USING (geid)
"""


@register("export_group", _GROUP_EXPORT_SQL, VIEWS)
def q_export_group(spark, sf):
    return X.group_export(_ledger(spark, sf))


# the default order and every sort field, written as files and read back (empty fields come back as NULL)
@register("export_group_files", f"""
SELECT f AS sorted_by, {", ".join(f'NULLIF("{c}", \'\') AS "{c}"' for c in X.GROUP_HEADER)}
FROM ({_GROUP_EXPORT_SQL}), unnest({["group", *sorted(X.GROUP_SORT)]}) AS fields(f)
""", VIEWS)
def q_export_group_files(spark, sf):
    path, stored, L = scratch_path(spark, "group-export"), scratch_path(spark, "group-export-rows"), _ledger(spark, sf)
    X.group_export_rows(L).write.parquet(stored)
    rows = spark.read.parquet(stored)
    for name in ("group", *X.GROUP_SORT):
        export = X.group_export(L, sort_field=None if name == "group" else name, rows=rows)
        csv_io.write_csv(export, f"{path}/sorted_by={name}", compression="gzip")
    return spark.read.option("header", True).option("escape", '"').csv(path)


# ---------------------------------------------------------------- J8 lookups, J9 new names

@register("lookup_ids", f"""
SELECT b.seq, c.cid, p.pid, u.uid
FROM personal_batch b
LEFT JOIN (SELECT lower(category_name) AS name, min(cid) AS cid FROM categories GROUP BY 1) c
       ON c.name = lower({_strip_sql('b.category')})
LEFT JOIN (SELECT lower(method) AS name, min(pid) AS pid FROM payment_methods GROUP BY 1) p
       ON p.name = lower({_strip_sql('b.payment_method')})
LEFT JOIN users u ON u.uid = b.uid
""", PERSONAL_CTES)
def q_lookup_ids(spark, sf):
    """One left join per dimension over the whole batch; a NULL id marks a failed lookup."""
    L = _ledger(spark, sf)
    b = B.personal_batch(spark, sf).select(
        "seq", "uid", norm_name("category").alias("category"), norm_name("payment_method").alias("payment_method"))
    b = M._lookup(b, M.name_lookup(L.categories, "category_name", "cid", True), "category", "cid")
    b = M._lookup(b, M.name_lookup(L.payment_methods, "method", "pid", True), "payment_method", "pid")
    known = L.users.select("uid", F.col("uid").alias("_uid"))
    return b.join(known, "uid", "left").select("seq", "cid", "pid", F.col("_uid").alias("uid"))


@register("new_tags", f"""
SELECT u.tag_name, min(b.seq) AS first_seq
FROM personal_batch b, unnest({_split_sql('b.tag')}) AS u(tag_name)
WHERE u.tag_name NOT IN (SELECT tag_name FROM tags)
GROUP BY u.tag_name
""", PERSONAL_CTES)
def q_new_tags(spark, sf):
    """Tag names used by the batch that the tags table lacks, with their first use."""
    L = _ledger(spark, sf)
    uses = B.personal_batch(spark, sf).select("seq", F.explode(split_list("tag")).alias("tag_name"))
    return (uses.join(L.tags.select("tag_name"), "tag_name", "left_anti")
            .groupBy("tag_name").agg(F.min("seq").alias("first_seq")))
