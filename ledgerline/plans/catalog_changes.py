"""Catalogue part 3: keyed batch changes.

Each key derives a change batch from the test tables (suppliers as new users,
part types as new categories, event types as new payment methods, orders as
updates / deletes / membership requests, ...), applies it to the mapped ledger
and returns the *new snapshot* of the table the change is about. The oracle
computes the same snapshot in SQL, including id allocation and batch-duplicate
rules.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import functions as F

from ledgerline.operators import changes as C
from ledgerline.operators import loads as M
from ledgerline.operators import reports as R
from ledgerline.plans.catalog import VIEWS, _list_sql
from ledgerline.plans.catalog_loads import _amount_sql, _strip_sql
from ledgerline.plans.oracle_views import money_sql
from ledgerline.plans.registry import register
from ledgerline.schema import Ledger
from ledgerline.session import scratch_path
from ledgerline.sources import batches as B
from ledgerline.sources import store
from ledgerline.sources.testdata import ledger_from_testdata, read_table

AS_OF = _dt.date(2001, 7, 15)
ADMIN = 0


def _led(spark, sf):
    return ledger_from_testdata(spark, sf)


def _dedup_sql(batch: str, pre: str, key: str) -> str:
    """SQL twin of the batch-duplicate rule: among passing rows the lowest seq per key wins."""
    return f"""SELECT *, CASE WHEN pre IS NULL
                          AND seq <> min(seq) FILTER (WHERE pre IS NULL) OVER (PARTITION BY {key})
                         THEN 'duplicate in batch' ELSE pre END AS reason
               FROM (SELECT *, {pre} AS pre FROM {batch})"""


# ---------------------------------------------------------------- M1 users

def _users_batch(spark, sf):
    s = read_table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        k.cast("long").alias("seq"),
        F.when(k % 9 == 0, F.concat(F.lit("Customer#"), F.lpad(k.cast("string"), 9, "0")))
         .when(k % 11 == 0, F.lit("Supplier#dup")).otherwise(F.col("s_name")).alias("username"),
        F.when(k % 7 == 0, F.lit("Guest")).otherwise(F.lit("User")).alias("role"))


_USERS_CTES = {
    "ub": f"""SELECT CAST(s_suppkey AS BIGINT) AS seq,
        {_strip_sql("CASE WHEN s_suppkey % 9 = 0 THEN 'Customer#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') "
                    "WHEN s_suppkey % 11 = 0 THEN 'Supplier#dup' ELSE s_name END")} AS username,
        CASE WHEN s_suppkey % 7 = 0 THEN 'Guest' ELSE 'User' END AS role FROM supplier""",
    "uj": _dedup_sql("ub", """CASE WHEN username IS NULL OR username = '' THEN 'empty name'
        WHEN role IS NULL OR role NOT IN ('Admin', 'User') THEN 'invalid role'
        WHEN username IN (SELECT username FROM users) THEN 'already exists' END""", "username"),
}


@register("change_add_users", """
SELECT uid, username, role FROM users
UNION ALL
SELECT (SELECT max(uid) FROM users) + row_number() OVER (ORDER BY seq), username, role FROM uj WHERE reason IS NULL
""", _USERS_CTES)
def q_change_add_users(spark, sf):
    return C.add_users(_led(spark, sf), _users_batch(spark, sf)).ledger.users


@register("change_add_users_rejects", "SELECT seq, reason FROM uj WHERE reason IS NOT NULL", _USERS_CTES)
def q_change_add_users_rejects(spark, sf):
    return C.add_users(_led(spark, sf), _users_batch(spark, sf)).rejects


# ---------------------------------------------------------------- M2 categories, M3 methods, M4 tags

def _named_sql(batch: str, name: str, table: str, name_col: str, id_col: str, ci: bool = False) -> str:
    key = f"lower({name})" if ci else name
    existing = f"(SELECT lower({name_col}) FROM {table})" if ci else f"(SELECT {name_col} FROM {table})"
    pre = f"""CASE WHEN {name} IS NULL OR {name} = '' THEN 'empty name'
                   WHEN {key} IN {existing} THEN 'already exists' END"""
    return f"""
SELECT {id_col}, {name_col} FROM {table}
UNION ALL
SELECT (SELECT max({id_col}) FROM {table}) + row_number() OVER (ORDER BY seq), {name}
FROM ({_dedup_sql(batch, pre, key)}) WHERE reason IS NULL
"""


@register("change_add_categories", _named_sql(
    f"(SELECT CAST(p_partkey AS BIGINT) AS seq, lower({_strip_sql('p_type')}) AS category_name FROM part)",
    "category_name", "categories", "category_name", "cid"))
def q_change_add_categories(spark, sf):
    b = read_table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("seq"),
                                             F.col("p_type").alias("category_name"))
    return C.add_categories(_led(spark, sf), b).ledger.categories


@register("change_add_payment_methods", _named_sql(
    f"(SELECT CAST(event_id AS BIGINT) AS seq, {_strip_sql('event_type')} AS method FROM events)",
    "method", "payment_methods", "method", "pid", ci=True))
def q_change_add_payment_methods(spark, sf):
    b = read_table(spark, sf, "events").select(F.col("event_id").cast("long").alias("seq"),
                                               F.col("event_type").alias("method"))
    return C.add_payment_methods(_led(spark, sf), b).ledger.payment_methods


@register("change_add_tags", _named_sql(
    f"""(SELECT CAST(p_partkey AS BIGINT) AS seq,
         lower({_strip_sql("CASE WHEN p_partkey % 5 = 0 THEN p_brand ELSE p_type END")}) AS tag_name FROM part)""",
    "tag_name", "tags", "tag_name", "tid"))
def q_change_add_tags(spark, sf):
    p = read_table(spark, sf, "part")
    b = p.select(F.col("p_partkey").cast("long").alias("seq"),
                 F.when(F.col("p_partkey") % 5 == 0, F.col("p_brand")).otherwise(F.col("p_type")).alias("tag_name"))
    return C.add_tags(_led(spark, sf), b).ledger.tags


# ---------------------------------------------------------------- M5 groups

def _groups_batch(spark, sf):
    r = read_table(spark, sf, "region").select(
        F.col("r_regionkey").cast("long").alias("seq"), F.col("r_regionkey").cast("long").alias("uid"),
        F.col("r_name").alias("group_name"), F.concat(F.lit("region "), F.col("r_name")).alias("description"))
    n = read_table(spark, sf, "nation").select(
        (F.col("n_nationkey") + 1000).cast("long").alias("seq"), F.col("n_nationkey").cast("long").alias("uid"),
        F.col("n_name").alias("group_name"), F.lit("copy").alias("description"))
    return r.unionByName(n)


_GROUPS_CTES = {
    "gb5": f"""SELECT CAST(r_regionkey AS BIGINT) AS seq, CAST(r_regionkey AS BIGINT) AS uid,
               {_strip_sql('r_name')} AS group_name, 'region ' || r_name AS description FROM region
        UNION ALL
        SELECT CAST(n_nationkey + 1000 AS BIGINT), CAST(n_nationkey AS BIGINT), {_strip_sql('n_name')}, 'copy'
        FROM nation""",
    "gj5": _dedup_sql("gb5", """CASE WHEN group_name IS NULL OR group_name = '' THEN 'empty name'
        WHEN uid NOT IN (SELECT uid FROM users) THEN 'unknown user'
        WHEN group_name IN (SELECT group_name FROM groups) THEN 'already exists' END""", "group_name"),
}


@register("change_add_groups", f"""
SELECT gid, date_created, group_name, description FROM groups
UNION ALL
SELECT (SELECT max(gid) FROM groups) + row_number() OVER (ORDER BY seq), DATE '{AS_OF}', group_name, description
FROM gj5 WHERE reason IS NULL
""", _GROUPS_CTES)
def q_change_add_groups(spark, sf):
    return C.add_groups(_led(spark, sf), _groups_batch(spark, sf), AS_OF).ledger.groups


# ---------------------------------------------------------------- M6 members

def _members_batch(spark, sf):
    o = read_table(spark, sf, "orders")
    c = read_table(spark, sf, "customer")
    n = read_table(spark, sf, "nation")
    k = F.col("o_orderkey")
    # odd orders ask for another group than the customer's own: new pairs, outsiders as actors, repeats
    nation = F.when(k % 2 == 1, F.pmod(c.c_nationkey + k, F.lit(25))).otherwise(c.c_nationkey)
    return (o.join(c, o.o_custkey == c.c_custkey).withColumn("_nation", nation).join(n, F.col("_nation") == n.n_nationkey)
            .select(k.cast("long").alias("seq"),
                    F.when(k % 3 == 0, F.lit(ADMIN)).otherwise(F.col("o_custkey")).cast("long").alias("actor_uid"),
                    F.col("c_name").alias("username"), F.col("n_name").alias("group_name")))


@register("change_add_members", """
SELECT uid, gid FROM user_group
UNION ALL
SELECT uid, gid FROM (""" + _dedup_sql("""(
    SELECT b.seq, b.actor_uid, u.uid, g.gid FROM (
      SELECT CAST(o.o_orderkey AS BIGINT) AS seq,
             CAST(CASE WHEN o.o_orderkey % 3 = 0 THEN 0 ELSE o.o_custkey END AS BIGINT) AS actor_uid,
             c.c_name AS username, n.n_name AS group_name
      FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
      JOIN nation n ON n.n_nationkey = CASE WHEN o.o_orderkey % 2 = 1 THEN (c.c_nationkey + o.o_orderkey) % 25
                                            ELSE c.c_nationkey END) b
    LEFT JOIN users u ON u.username = b.username
    LEFT JOIN groups g ON g.group_name = b.group_name)""",
    """CASE WHEN uid IS NULL THEN 'unknown user' WHEN gid IS NULL THEN 'unknown group'
            WHEN gid IN (SELECT gid FROM user_group)
                 AND NOT EXISTS (SELECT 1 FROM user_group m(mu, mg) WHERE mu = actor_uid AND mg = gid) THEN 'actor not a member'
            WHEN EXISTS (SELECT 1 FROM user_group m(mu, mg) WHERE mu = uid AND mg = gid) THEN 'already exists' END""",
    "uid, gid") + """) WHERE reason IS NULL
""")
def q_change_add_members(spark, sf):
    return C.add_members(_led(spark, sf), _members_batch(spark, sf)).ledger.user_group


# ---------------------------------------------------------------- M7 typed personal adds

def _typed_batch(spark, sf):
    full = _led(spark, sf)
    o = read_table(spark, sf, "orders")
    k = F.col("o_orderkey")
    tags = (full.expenses_tags.join(full.tags, "tid").groupBy(F.col("eid").alias("o_orderkey"))
            .agg(F.sort_array(F.collect_list("tag_name")).alias("tl")))
    return (o.filter(k % 2 == 1).join(tags, "o_orderkey", "left")
            .select(k.cast("long").alias("seq"), F.col("o_custkey").cast("long").alias("uid"),
                    F.when(k % 19 == 0, F.lit(-5.0)).otherwise(F.col("o_totalprice")).alias("amount"),
                    F.upper("o_orderpriority").alias("category"),
                    F.when(k % 41 == 0, F.lit("cheque")).otherwise(F.col("o_orderstatus")).alias("payment_method"),
                    F.to_date("o_orderdate").alias("date"),
                    F.concat(F.lit("order "), k.cast("string")).alias("description"),
                    F.when(k % 43 == 0, F.concat(F.coalesce("tl", F.array().cast("array<string>")),
                                                 F.array(F.lit("Brand#1"))))
                    .otherwise(F.coalesce("tl", F.array().cast("array<string>"))).alias("tags")))


@register("change_add_expenses", """
SELECT * FROM expenses WHERE eid % 2 = 0
UNION ALL
SELECT (SELECT max(eid) FROM expenses WHERE eid % 2 = 0) + row_number() OVER (ORDER BY seq),
       uid, amount, cid, pid, date, description
FROM (
  SELECT b.*, c.cid, p.pid,
    CASE WHEN amount IS NULL OR isnan(amount) THEN 'invalid amount'
         WHEN amount <= 0 THEN 'amount must be positive'
         WHEN c.cid IS NULL THEN 'unknown category' WHEN p.pid IS NULL THEN 'unknown payment method'
         WHEN date IS NULL THEN 'invalid date'
         WHEN len(list_filter(tags, lambda t: t <> lower(t))) > 0 THEN 'tag not lower-case'
         WHEN len(list_distinct(tags)) <> len(tags) THEN 'repeated tag' END AS reason
  FROM (
    SELECT CAST(o.o_orderkey AS BIGINT) AS seq, CAST(o.o_custkey AS BIGINT) AS uid,
           CASE WHEN o.o_orderkey % 19 = 0 THEN -5.0 ELSE o.o_totalprice END AS amount,
           lower(upper(o.o_orderpriority)) AS category,
           lower(CASE WHEN o.o_orderkey % 41 = 0 THEN 'cheque' ELSE o.o_orderstatus END) AS payment_method,
           CAST(o.o_orderdate AS DATE) AS date, 'order ' || CAST(o.o_orderkey AS VARCHAR) AS description,
           CASE WHEN o.o_orderkey % 43 = 0 THEN list_append(COALESCE(t.tl, CAST([] AS VARCHAR[])), 'Brand#1')
                ELSE COALESCE(t.tl, CAST([] AS VARCHAR[])) END AS tags
    FROM orders o LEFT JOIN (
        SELECT et.eid, list_sort(list(tg.tag_name)) AS tl FROM expenses_tags et JOIN tags tg ON et.tid = tg.tid
        GROUP BY et.eid) t ON t.eid = o.o_orderkey
    WHERE o.o_orderkey % 2 = 1) b
  LEFT JOIN (SELECT lower(category_name) AS name, min(cid) AS cid FROM categories GROUP BY 1) c ON c.name = b.category
  LEFT JOIN (SELECT lower(method) AS name, min(pid) AS pid FROM payment_methods GROUP BY 1) p ON p.name = b.payment_method
) WHERE reason IS NULL
""")
def q_change_add_expenses(spark, sf):
    return M.add_expenses(B.base_ledger(spark, sf), _typed_batch(spark, sf)).ledger.expenses


# ---------------------------------------------------------------- M8 updates, M9 deletes

def _update_batch(spark, sf):
    o = read_table(spark, sf, "orders")
    k = F.col("o_orderkey")
    field = (F.when(k % 7 == 0, F.lit("colour")).when(k % 3 == 0, F.lit("amount"))
             .when(k % 3 == 1, F.lit("category")).otherwise(F.lit("description")))
    value = (F.when(k % 3 == 0, (F.col("o_totalprice") * 2).cast("string"))
             .when(k % 3 == 1, F.lit("5-LOW"))
             .otherwise(F.concat(F.lit("updated "), k.cast("string"))))
    return o.select(k.cast("long").alias("seq"), k.cast("long").alias("eid"),
                    F.when(k % 10 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).cast("long")
                    .alias("actor_uid"), field.alias("field"), value.alias("value"))


@register("change_update_expenses", f"""
SELECT e.eid, e.uid,
       CASE WHEN u.field = 'amount' THEN {_amount_sql('u.value')} ELSE e.amount END AS amount,
       CASE WHEN u.field = 'category' THEN (SELECT min(cid) FROM categories WHERE category_name = lower(u.value))
            ELSE e.cid END AS cid,
       e.pid, e.date,
       CASE WHEN u.field = 'description' THEN u.value ELSE e.description END AS description
FROM expenses e LEFT JOIN (
  SELECT * FROM (
    SELECT CAST(o.o_orderkey AS BIGINT) AS eid,
      CASE WHEN o.o_orderkey % 10 = 0 THEN o.o_custkey + 1 ELSE o.o_custkey END AS actor_uid,
      CASE WHEN o.o_orderkey % 7 = 0 THEN 'colour' WHEN o.o_orderkey % 3 = 0 THEN 'amount'
           WHEN o.o_orderkey % 3 = 1 THEN 'category' ELSE 'description' END AS field,
      CASE WHEN o.o_orderkey % 3 = 0 THEN CAST(o.o_totalprice * 2 AS VARCHAR)
           WHEN o.o_orderkey % 3 = 1 THEN '5-LOW' ELSE 'updated ' || CAST(o.o_orderkey AS VARCHAR) END AS value,
      o.o_custkey AS owner
    FROM orders o)
  WHERE field <> 'colour' AND owner = actor_uid
    AND NOT (field = 'amount' AND ({_amount_sql('value')} IS NULL OR {_amount_sql('value')} < 0))
    AND NOT (field = 'category' AND lower(value) NOT IN (SELECT category_name FROM categories))
) u ON u.eid = e.eid
""")
def q_change_update_expenses(spark, sf):
    return C.update_expenses(_led(spark, sf), _update_batch(spark, sf)).ledger.expenses


# dates, methods and tag sets, with a second change for every even key (a quarter of those dates are refused)
@register("change_update_expenses_repeated", """
SELECT uid, eid, amount, category_name,
       CASE WHEN eid % 3 <> 1 THEN method WHEN eid % 2 = 0 THEN 'p' ELSE 'f' END AS method,
       CASE WHEN eid % 3 <> 0 THEN date WHEN eid % 4 = 2 THEN DATE '2000-03-04' ELSE DATE '1999-01-02' END AS date,
       description,
       CASE WHEN eid % 3 <> 2 THEN tags WHEN eid % 4 = 0 THEN NULL WHEN eid % 4 = 2 THEN 'brand#2'
            ELSE 'brand#1, fresh' END AS tags
FROM named LEFT JOIN tag_list USING (eid)
""", VIEWS)
def q_change_update_expenses_repeated(spark, sf):
    k = F.col("o_orderkey").cast("long")
    kind = k % 3
    o = read_table(spark, sf, "orders").select(
        k.alias("eid"), F.col("o_custkey").cast("long").alias("actor_uid"),
        F.when(kind == 0, "date").when(kind == 1, "payment_method").otherwise("tags").alias("field"))
    first = o.withColumn("seq", F.col("eid") * 2).withColumn(
        "value", F.when(F.col("field") == "date", "1999-1-2").when(F.col("field") == "tags", "brand#1, Fresh")
        .otherwise("F"))
    odd_half = F.col("eid") % 4 == 2
    second = o.filter(F.col("eid") % 2 == 0).withColumn("seq", F.col("eid") * 2 + 1).withColumn(
        "value", F.when(F.col("field") == "date", F.when(odd_half, "2000-03-04").otherwise("1999-02-30"))
        .when(F.col("field") == "tags", F.when(odd_half, "brand#2").otherwise("")).otherwise("P"))
    return R.list_expenses(C.update_expenses(_led(spark, sf), first.unionByName(second)).ledger)


@register("change_delete_expenses", """
SELECT e.* FROM expenses e
WHERE NOT EXISTS (
  SELECT 1 FROM orders o
  WHERE o.o_orderkey = e.eid AND o.o_orderkey % 4 = 0
    AND (CASE WHEN o.o_orderkey % 8 = 0 THEN o.o_custkey + 1 ELSE o.o_custkey END) = e.uid)
""")
def q_change_delete_expenses(spark, sf):
    o = read_table(spark, sf, "orders")
    k = F.col("o_orderkey")
    b = o.filter(k % 4 == 0).select(
        k.cast("long").alias("seq"), k.cast("long").alias("eid"),
        F.when(k % 8 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).cast("long").alias("actor_uid"))
    return C.delete_expenses(_led(spark, sf), b).ledger.expenses


# ---------------------------------------------------------------- M10, M11, M12

_ROLE_BY_SEGMENT = "CASE c_mktsegment WHEN 'BUILDING' THEN 'Admin' WHEN 'MACHINERY' THEN 'Root' ELSE 'User' END"


@register("change_update_users", f"""
SELECT u.uid, u.username, CASE WHEN v.value IN ('Admin', 'User') THEN v.value ELSE u.role END AS role
FROM users u LEFT JOIN (SELECT CAST(c_custkey AS BIGINT) AS uid, {_ROLE_BY_SEGMENT} AS value FROM customer) v
  ON v.uid = u.uid
""")
def q_change_update_users(spark, sf):
    c = read_table(spark, sf, "customer")
    seg = F.col("c_mktsegment")
    b = c.select(F.col("c_custkey").cast("long").alias("seq"), F.col("c_custkey").cast("long").alias("uid"),
                 F.lit("role").alias("field"),
                 F.when(seg == "BUILDING", "Admin").when(seg == "MACHINERY", "Root").otherwise("User").alias("value"))
    return C.update_users(_led(spark, sf), b).ledger.users


def _group_update_batch(spark, sf):
    n = read_table(spark, sf, "nation")
    r = read_table(spark, sf, "region")
    k = F.col("n_nationkey")
    rename = F.when(k % 5 == 1, F.lit("NATION_0")).otherwise(F.concat_ws("_", "n_name", "r_name"))
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        k.cast("long").alias("seq"), F.col("n_regionkey").cast("long").alias("actor_uid"),
        F.col("n_name").alias("group_name"),
        F.when(k % 2 == 0, "description").otherwise("group_name").alias("field"),
        F.when(k % 2 == 0, F.concat(F.lit("region "), F.col("r_name"))).otherwise(rename).alias("value"))


@register("change_update_groups", """
SELECT g.gid, g.date_created,
       CASE WHEN b0.ok AND b0.field = 'group_name' AND b0.value NOT IN (SELECT group_name FROM groups)
            THEN b0.value ELSE g.group_name END AS group_name,
       CASE WHEN b0.ok AND b0.field = 'description' THEN b0.value ELSE g.description END AS description
FROM groups g LEFT JOIN (
  SELECT n.n_name AS group_name,
         CASE WHEN n.n_nationkey % 2 = 0 THEN 'description' ELSE 'group_name' END AS field,
         CASE WHEN n.n_nationkey % 2 = 0 THEN 'region ' || r.r_name
              WHEN n.n_nationkey % 5 = 1 THEN 'NATION_0' ELSE n.n_name || '_' || r.r_name END AS value,
         (n.n_regionkey IN (SELECT uid FROM users WHERE role = 'Admin')
          OR EXISTS (SELECT 1 FROM user_group m JOIN groups gg ON gg.gid = m.gid
                     WHERE m.uid = n.n_regionkey AND gg.group_name = n.n_name)) AS ok
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey) b0 ON b0.group_name = g.group_name
""")
def q_change_update_groups(spark, sf):
    return C.update_groups(_led(spark, sf), _group_update_batch(spark, sf)).ledger.groups


@register("change_delete_users", """
SELECT * FROM users WHERE uid NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'AUTOMOBILE')
""")
def q_change_delete_users(spark, sf):
    return C.delete_users(_led(spark, sf), _user_delete_batch(spark, sf)).ledger.users


def _user_delete_batch(spark, sf):
    c = read_table(spark, sf, "customer")
    return c.filter(F.col("c_mktsegment") == "AUTOMOBILE").select(
        F.col("c_custkey").cast("long").alias("seq"), F.col("c_custkey").cast("long").alias("uid"))


# shares of group expenses after their creators and participants went: those who stay hold the whole amount
@register("change_delete_users_cascade", f"""
WITH gone AS (SELECT c_custkey AS uid FROM customer WHERE c_mktsegment = 'AUTOMOBILE'),
kept AS (SELECT geid, amount FROM group_expenses ANTI JOIN gone USING (uid)),
stay AS (SELECT geid, uid, split_amount FROM split_users ANTI JOIN gone USING (uid)),
held AS (SELECT geid, {money_sql('split_amount')} AS held FROM stay GROUP BY geid),
hurt AS (SELECT DISTINCT geid, TRUE AS hurt FROM split_users SEMI JOIN gone USING (uid))
SELECT geid, uid, if(hurt, split_amount * amount / held, split_amount) AS split_amount
FROM stay JOIN kept USING (geid) JOIN held USING (geid) LEFT JOIN hurt USING (geid)
""")
def q_change_delete_users_cascade(spark, sf):
    return C.delete_users(_led(spark, sf), _user_delete_batch(spark, sf), cascade=True).ledger.split_users


@register("change_delete_tags", f"""
SELECT * FROM tags WHERE tag_name NOT IN (
  SELECT lower({_strip_sql("CASE WHEN p_brand LIKE '%5' THEN p_brand ELSE p_type END")}) FROM part)
""")
def q_change_delete_tags(spark, sf):
    p = read_table(spark, sf, "part")
    b = p.select(F.col("p_partkey").cast("long").alias("seq"),
                 F.when(F.col("p_brand").endswith("5"), F.col("p_brand")).otherwise(F.col("p_type"))
                 .alias("tag_name"))
    return C.delete_tags(_led(spark, sf), b).ledger.tags


_DELETED_GIDS = f"""
SELECT g.gid FROM nation n JOIN groups g ON g.group_name = n.n_name
WHERE (CASE WHEN n.n_regionkey = 1 THEN {ADMIN} ELSE n.n_nationkey + 1000 END) IN (SELECT uid FROM users WHERE role = 'Admin')
   OR EXISTS (SELECT 1 FROM user_group m WHERE m.gid = g.gid
              AND m.uid = (CASE WHEN n.n_regionkey = 1 THEN {ADMIN} ELSE n.n_nationkey + 1000 END))
"""


@register("change_delete_groups", f"SELECT * FROM group_expenses WHERE gid NOT IN ({_DELETED_GIDS})")
def q_change_delete_groups(spark, sf):
    n = read_table(spark, sf, "nation")
    b = n.select(F.col("n_nationkey").cast("long").alias("seq"), F.col("n_name").alias("group_name"),
                 F.when(F.col("n_regionkey") == 1, F.lit(ADMIN)).otherwise(F.col("n_nationkey") + 1000)
                 .cast("long").alias("actor_uid"))
    return C.delete_groups(_led(spark, sf), b).ledger.group_expenses


@register("change_delete_groups_splits", f"""
SELECT * FROM split_users WHERE geid NOT IN (SELECT geid FROM group_expenses WHERE gid IN ({_DELETED_GIDS}))
""")
def q_change_delete_groups_splits(spark, sf):
    n = read_table(spark, sf, "nation")
    b = n.select(F.col("n_nationkey").cast("long").alias("seq"), F.col("n_name").alias("group_name"),
                 F.when(F.col("n_regionkey") == 1, F.lit(ADMIN)).otherwise(F.col("n_nationkey") + 1000)
                 .cast("long").alias("actor_uid"))
    return C.delete_groups(_led(spark, sf), b).ledger.split_users


# ---------------------------------------------------------------- S1 stored ledgers

# stored, its later expenses appended as load 1, read back
@register("list_expenses_stored", _list_sql(), VIEWS)
def q_list_expenses_stored(spark, sf):
    led = ledger_from_testdata(spark, sf, stage=("expenses_tags", "group_expenses", "split_users"))
    root = scratch_path(spark, "stored-ledger")
    late = F.col("date") >= F.lit(_dt.date(2000, 1, 1))
    led.with_tables(expenses=led.expenses.filter(~late)).write(root)
    store.append_rows(root, 1, {"expenses": led.expenses.filter(late)})
    return R.list_expenses(Ledger.read(spark, root))


# ---------------------------------------------------------------- M13 even splits

def _group_add_batch(spark, sf, full):
    o = read_table(spark, sf, "orders")
    k = F.col("o_orderkey")
    names = (full.split_users.join(full.users.select("uid", "username"), "uid")
             .groupBy(F.col("geid").alias("o_orderkey")).agg(F.sort_array(F.collect_list("username")).alias("nl")))
    tags = (full.group_expense_tags.join(full.tags, "tid").groupBy(F.col("geid").alias("o_orderkey"))
            .agg(F.sort_array(F.collect_list("tag_name")).alias("tl")))
    ge = full.group_expenses.select(F.col("geid").alias("o_orderkey"), "gid")
    extra = (F.when(k % 7 == 0, F.array(F.lit("nobody")))
             .when(k % 11 == 0, F.array(F.lit("Customer#000000000")))
             .otherwise(F.array().cast("array<string>")))
    return (o.filter(k % 2 == 1).join(ge, "o_orderkey").join(full.groups.select("gid", "group_name"), "gid")
            .join(names, "o_orderkey", "left").join(tags, "o_orderkey", "left")
            .select(k.cast("long").alias("seq"), F.col("o_custkey").cast("long").alias("actor_uid"),
                    "group_name", F.col("o_totalprice").alias("amount"),
                    F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("payment_method"),
                    F.to_date("o_orderdate").alias("date"),
                    F.concat(F.lit("order "), k.cast("string")).alias("description"),
                    F.coalesce("tl", F.array().cast("array<string>")).alias("tags"),
                    F.concat(F.coalesce("nl", F.array().cast("array<string>")), extra).alias("split_usernames")))


_M13_CTES = {
    "m13_names": """SELECT su.geid AS k, list_sort(list(u.username)) AS nl
        FROM split_users su JOIN users u ON u.uid = su.uid GROUP BY su.geid""",
    "m13_tags": """SELECT gt.geid AS k, list_sort(list(t.tag_name)) AS tl
        FROM group_expense_tags gt JOIN tags t ON t.tid = gt.tid GROUP BY gt.geid""",
    "m13_b": f"""SELECT CAST(o.o_orderkey AS BIGINT) AS seq, CAST(o.o_custkey AS BIGINT) AS actor_uid, g.gid,
        o.o_totalprice AS amount, lower({_strip_sql('o.o_orderpriority')}) AS category,
        lower({_strip_sql('o.o_orderstatus')}) AS payment_method, CAST(o.o_orderdate AS DATE) AS date,
        list_transform(COALESCE(t.tl, CAST([] AS VARCHAR[])), lambda x: lower({_strip_sql('x')})) AS tag_list,
        list_distinct(list_filter(list_concat(
            list_concat(COALESCE(n.nl, CAST([] AS VARCHAR[])),
                        CASE WHEN o.o_orderkey % 7 = 0 THEN ['nobody']
                             WHEN o.o_orderkey % 11 = 0 THEN ['Customer#000000000']
                             ELSE CAST([] AS VARCHAR[]) END),
            [au.username]), lambda x: x IS NOT NULL)) AS people,
        au.role AS actor_role,
        EXISTS (SELECT 1 FROM user_group m WHERE m.uid = o.o_custkey AND m.gid = g.gid) AS actor_in
        FROM orders o
        JOIN group_expenses ge ON ge.geid = o.o_orderkey
        JOIN groups g ON g.gid = ge.gid
        LEFT JOIN m13_names n ON n.k = o.o_orderkey
        LEFT JOIN m13_tags t ON t.k = o.o_orderkey
        LEFT JOIN users au ON au.uid = o.o_custkey
        WHERE o.o_orderkey % 2 = 1""",
    "m13_pe": "SELECT seq, gid, unnest(people) AS username FROM m13_b",
    "m13_pc": """SELECT pe.seq,
        count(*) FILTER (WHERE u.uid IS NOT NULL AND m.uid IS NULL) AS outsiders,
        count(*) FILTER (WHERE m.uid IS NOT NULL) AS kept
        FROM m13_pe pe LEFT JOIN users u ON u.username = pe.username
        LEFT JOIN user_group m ON m.uid = u.uid AND m.gid = pe.gid GROUP BY pe.seq""",
    "m13_j": """SELECT b.*, pc.kept, c.cid, p.pid,
        CASE WHEN b.gid IS NULL THEN 'unknown group'
             WHEN NOT b.actor_in AND COALESCE(b.actor_role, '') <> 'Admin' THEN 'actor not a member'
             WHEN c.cid IS NULL THEN 'unknown category' WHEN p.pid IS NULL THEN 'unknown payment method'
             WHEN COALESCE(pc.outsiders, 0) > 0 THEN 'participant not a member'
             WHEN COALESCE(pc.kept, 0) < 2 THEN 'fewer than two participants'
             WHEN b.amount IS NULL OR isnan(b.amount) THEN 'invalid amount'
             WHEN b.amount <= 0 THEN 'amount must be positive'
             WHEN b.date IS NULL THEN 'invalid date'
             WHEN len(list_distinct(b.tag_list)) <> len(b.tag_list) THEN 'repeated tag' END AS reason
        FROM m13_b b LEFT JOIN m13_pc pc ON pc.seq = b.seq
        LEFT JOIN (SELECT lower(category_name) AS name, min(cid) AS cid FROM categories GROUP BY 1) c
               ON c.name = b.category
        LEFT JOIN (SELECT lower(method) AS name, min(pid) AS pid FROM payment_methods GROUP BY 1) p
               ON p.name = b.payment_method""",
    "m13_ok": """SELECT (SELECT max(geid) FROM group_expenses WHERE geid % 2 = 0)
               + row_number() OVER (ORDER BY seq) AS geid, *
        FROM m13_j WHERE reason IS NULL""",
}


@register("change_add_group_expenses", """
SELECT * FROM split_users WHERE geid % 2 = 0
UNION ALL
SELECT a.geid, u.uid, a.amount / a.kept AS split_amount
FROM (SELECT geid, gid, amount, kept, unnest(people) AS username FROM m13_ok) a
JOIN users u ON u.username = a.username
WHERE EXISTS (SELECT 1 FROM user_group m WHERE m.uid = u.uid AND m.gid = a.gid)
""", _M13_CTES)
def q_change_add_group_expenses(spark, sf):
    full = ledger_from_testdata(spark, sf, stage=("group_expenses", "split_users", "user_group"))
    return M.add_group_expenses(B.base_ledger(spark, sf, full), _group_add_batch(spark, sf, full)).ledger.split_users
