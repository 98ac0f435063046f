"""The named queries of SURVEY section 2, each with its DuckDB oracle.

Parameters are fixed values chosen to hit rows in the test data. Oracles
are stated from the meaning of each report, over the ledger's SQL views and a few
views of their own (``VIEWS``), and run in another engine.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import audit as A
from ledgerline.operators import dashboard as D
from ledgerline.operators import groups as G
from ledgerline.operators import joins as J
from ledgerline.operators import reports as R
from ledgerline.plans.oracle_views import money_sql as _money
from ledgerline.plans.registry import register
from ledgerline.schema import FOREIGN_KEYS, PRIMARY_KEYS, SCHEMAS, UNIQUE_KEYS
from ledgerline.sources.testdata import ledger_from_testdata

# Fixed query parameters.
SAMPLE_UID = 5
MEMBER_UID = 120  # an ordinary user in one group only
TOP_N = 5
TOP_N_PER_USER = 3
RANGE_START, RANGE_END = "1996-01-01", "1997-12-31"
SAMPLE_DATE = "1997-08-23"
SAMPLE_TAG = "Brand#13"
SAMPLE_CATEGORY = "3-MEDIUM"
SAMPLE_METHOD = "O"
MIN_AMOUNT, MAX_AMOUNT = "300000", "20000"
AMOUNT_RANGE = "100000-150000"
COMBO = {"category": "1-urgent", "min-amount": "250000", "tag": "brand#7"}




def ledger(spark: SparkSession, sf_dir: str):
    return ledger_from_testdata(spark, sf_dir)


# Views shared by the oracles: one row per expense with its names, tag lists and participant lists per expense.
VIEWS = {
    "named": "SELECT * FROM expenses JOIN categories USING (cid) JOIN payment_methods USING (pid)",
    "tag_pairs": "SELECT eid, tag_name FROM expenses_tags JOIN tags USING (tid)",
    "tag_list": "SELECT eid, array_to_string(list_sort(list(tag_name)), ', ') AS tags FROM tag_pairs GROUP BY eid",
    "group_named": """SELECT ge.* RENAME (date AS spent_on), category_name, method, group_name
        FROM group_expenses ge JOIN categories USING (cid) JOIN payment_methods USING (pid)
        JOIN (SELECT gid, group_name FROM groups) USING (gid)""",
    "group_tag_list": """SELECT geid, array_to_string(list_sort(list(DISTINCT tag_name)), ',') AS tags
        FROM group_expense_tags JOIN tags USING (tid) GROUP BY geid""",
    "people_list": """SELECT geid, array_to_string(list_sort(list(DISTINCT username)), ',') AS usernames
        FROM split_users JOIN users USING (uid) GROUP BY geid""",
}

# ---------------------------------------------------------------- R0 + filters

def _list_sql(cond: str = "TRUE", all_users: bool = True, tag: str | None = None) -> str:
    """Expenses with names and tags; with ``tag``, those that carry it, listing that tag alone."""
    lists = "LEFT JOIN tag_list" if tag is None else (
        f"JOIN (SELECT eid, lower('{tag}') AS tags FROM tag_pairs WHERE tag_name = lower('{tag}'))")
    return (f"SELECT {'uid, ' if all_users else ''}eid, amount, category_name, method, date, description, tags "
            f"FROM (SELECT * FROM named WHERE {cond}) {lists} USING (eid)")


@register("list_expenses", _list_sql(), VIEWS)
def q_list_expenses(spark, sf):
    return R.list_expenses(ledger(spark, sf))


@register("filter_user", _list_sql(f"uid = {SAMPLE_UID}", all_users=False), VIEWS)
def q_filter_user(spark, sf):
    return R.list_expenses(ledger(spark, sf), uid=SAMPLE_UID)


@register("filter_category", _list_sql(f"category_name = lower('{SAMPLE_CATEGORY}')"), VIEWS)
def q_filter_category(spark, sf):
    return R.list_expenses(ledger(spark, sf), {"category": SAMPLE_CATEGORY})


@register("filter_payment_method", _list_sql(f"method = lower('{SAMPLE_METHOD}')"), VIEWS)
def q_filter_payment_method(spark, sf):
    return R.list_expenses(ledger(spark, sf), {"payment_method": SAMPLE_METHOD})


@register("filter_min_amount", _list_sql(f"amount >= {MIN_AMOUNT}"), VIEWS)
def q_filter_min_amount(spark, sf):
    return R.list_expenses(ledger(spark, sf), {"min_amount": MIN_AMOUNT})


@register("filter_max_amount", _list_sql(f"amount <= {MAX_AMOUNT}"), VIEWS)
def q_filter_max_amount(spark, sf):
    return R.list_expenses(ledger(spark, sf), {"max-amount": MAX_AMOUNT})


_LO, _HI = AMOUNT_RANGE.split("-", 1)


@register("filter_amount_range", _list_sql(f"amount BETWEEN {_LO} AND {_HI}"), VIEWS)
def q_filter_amount_range(spark, sf):
    return R.list_expenses(ledger(spark, sf), {"amount": AMOUNT_RANGE})


@register("filter_date", _list_sql(f"date = DATE '{SAMPLE_DATE}'"), VIEWS)
def q_filter_date(spark, sf):
    return R.list_expenses(ledger(spark, sf), {"date": SAMPLE_DATE})


@register("filter_tag_narrow", _list_sql(tag=SAMPLE_TAG), VIEWS)
def q_filter_tag_narrow(spark, sf):
    return R.list_expenses(ledger(spark, sf), {"tag": SAMPLE_TAG})


@register("filter_combo", _list_sql("category_name = '1-urgent' AND amount >= 250000", tag="brand#7"), VIEWS)
def q_filter_combo(spark, sf):
    return R.list_expenses(ledger(spark, sf), COMBO)


# ---------------------------------------------------------------- R1-R9

def _top_sql(n: int, uid: int | None = None) -> str:
    """Largest amounts of the date range: ranked first, tags fetched for the winners."""
    part, keep = ("", f" AND uid = {uid}") if uid is not None else ("PARTITION BY uid ", "")
    return f"""SELECT {'uid, ' if uid is None else ''}eid, amount, category_name, method, date, description, tags
FROM (SELECT *, row_number() OVER ({part}ORDER BY amount DESC, eid) AS place FROM named
      WHERE date >= DATE '{RANGE_START}' AND date <= DATE '{RANGE_END}'{keep}) r
LEFT JOIN tag_list USING (eid) WHERE place <= {n}"""


@register("top_expenses", _top_sql(TOP_N, SAMPLE_UID), VIEWS)
def q_top_expenses(spark, sf):
    return R.top_expenses(ledger(spark, sf), TOP_N, RANGE_START, RANGE_END, uid=SAMPLE_UID)


@register("top_expenses_per_user", _top_sql(TOP_N_PER_USER), VIEWS)
def q_top_expenses_per_user(spark, sf):
    return R.top_expenses(ledger(spark, sf), TOP_N_PER_USER, RANGE_START, RANGE_END)


@register("category_spending", f"""
WITH high AS (SELECT uid, category_name, {_money('amount')} AS total FROM named GROUP BY ALL)
SELECT * FROM high WHERE category_name = '2-high' AND total <> 0
""", VIEWS)
def q_category_spending(spark, sf):
    return R.category_spending(ledger(spark, sf), "2-HIGH")


@register("above_average_expenses", f"""
WITH usual AS (SELECT cid, {_money('amount')} / count(*) AS category_avg FROM expenses GROUP BY cid)
SELECT named.*, category_avg FROM named JOIN usual ON usual.cid = named.cid AND named.amount > usual.category_avg
""", VIEWS)
def q_above_average_expenses(spark, sf):
    return R.above_average_expenses(ledger(spark, sf))


@register("monthly_category_spending", f"""
WITH dated AS (SELECT uid, left(CAST(date AS VARCHAR), 7) AS month, category_name, amount FROM named)
SELECT uid, month, category_name, {_money('amount')} AS total, count(*) AS "count" FROM dated GROUP BY ALL
""", VIEWS)
def q_monthly_category_spending(spark, sf):
    return R.monthly_category_spending(ledger(spark, sf))


# amounts from 1e9 times to 1e-12 times the usual
@register("monthly_category_spending_wide", """
WITH scaled AS (SELECT uid, left(CAST(date AS VARCHAR), 7) AS month, category_name, amount * if(eid % 2 = 0, 1e9, 1e-12) AS v FROM named)
SELECT uid, month, category_name, fsum(v) AS total, count(*) AS "count" FROM scaled GROUP BY ALL
""", VIEWS)
def q_monthly_category_spending_wide(spark, sf):
    L = ledger(spark, sf)
    scaled = F.col("amount") * F.when(F.col("eid") % 2 == 0, F.lit(1e9)).otherwise(F.lit(1e-12))
    return R.monthly_category_spending(L.with_tables(expenses=L.expenses.withColumn("amount", scaled)))


@register("highest_spender_per_month", f"""
WITH spent AS (SELECT uid, strftime(date, '%Y-%m') AS month, {_money('amount')} AS total FROM expenses GROUP BY ALL),
competing AS (SELECT month, username, total FROM spent JOIN users USING (uid)),
best AS (SELECT month, max(total) AS total FROM competing GROUP BY month)
SELECT month, username, total FROM competing JOIN best USING (month, total)
""")
def q_highest_spender_per_month(spark, sf):
    return R.highest_spender_per_month(ledger(spark, sf))


@register("frequent_category", """
WITH uses AS (SELECT uid, category_name, count(*) AS n FROM named GROUP BY ALL),
most AS (SELECT uid, max(n) AS n FROM uses GROUP BY uid)
SELECT uid, category_name, n AS "count" FROM uses SEMI JOIN most USING (uid, n)
""", VIEWS)
def q_frequent_category(spark, sf):
    return R.frequent_category(ledger(spark, sf))


@register("payment_method_usage", f"""
SELECT uid, method, {_money('amount')} AS total_spent, count(*) AS expense_count FROM named GROUP BY ALL
""", VIEWS)
def q_payment_method_usage(spark, sf):
    return R.payment_method_usage(ledger(spark, sf))


@register("tag_expenses", """
SELECT uid, tag_name, count(*) AS expense_count FROM (SELECT eid, uid FROM named) JOIN tag_pairs USING (eid) GROUP BY ALL
""", VIEWS)
def q_tag_expenses(spark, sf):
    return R.tag_expenses(ledger(spark, sf))


@register("list_users", "SELECT uid, username, role FROM users")
def q_list_users(spark, sf):
    return R.list_users(ledger(spark, sf))


@register("list_categories", "SELECT cid, category_name FROM categories")
def q_list_categories(spark, sf):
    return R.list_categories(ledger(spark, sf))


@register("list_payment_methods", "SELECT pid, method FROM payment_methods")
def q_list_payment_methods(spark, sf):
    return R.list_payment_methods(ledger(spark, sf))


@register("list_tags", "SELECT tid, tag_name FROM tags")
def q_list_tags(spark, sf):
    return R.list_tags(ledger(spark, sf))


# ---------------------------------------------------------------- R10-R15, group operators

SAMPLE_GROUP = "NATION_7"
SAMPLE_GROUP_CATEGORY = "5-LOW"
GROUP_TAG = "Brand#22"


@register("list_groups", "SELECT group_name, date_created, description FROM groups")
def q_list_groups(spark, sf):
    return G.list_groups(ledger(spark, sf))


_SCOPE = f"""
SELECT ug.gid FROM user_group ug WHERE ug.uid = {{uid}}
UNION
SELECT g.gid FROM groups g WHERE EXISTS (SELECT 1 FROM users u WHERE u.uid = {{uid}} AND u.role = 'Admin')
"""


@register("list_groups_of_user", f"""
SELECT g.group_name, g.date_created, g.description FROM groups g
WHERE g.gid IN ({_SCOPE.format(uid=MEMBER_UID)})
""")
def q_list_groups_of_user(spark, sf):
    return G.list_groups(ledger(spark, sf), uid=MEMBER_UID)


@register("group_scope", _SCOPE.format(uid=MEMBER_UID))
def q_group_scope(spark, sf):
    return G.group_scope(ledger(spark, sf), MEMBER_UID)


@register("group_scope_admin", _SCOPE.format(uid=0))
def q_group_scope_admin(spark, sf):
    return G.group_scope(ledger(spark, sf), 0)


@register("group_member_count", """
SELECT g.group_name, COUNT(*) AS member_count
FROM user_group ug JOIN groups g ON g.gid = ug.gid GROUP BY g.group_name
""")
def q_group_member_count(spark, sf):
    return G.group_member_count(ledger(spark, sf))


def _group_list_sql(cond: str = "TRUE", one: bool = False) -> str:
    """Group expenses with names, all their tags and all their participants."""
    return f"""SELECT {'' if one else 'group_name, '}geid, amount, category_name, method, spent_on AS date,
       description, tags, usernames
FROM (SELECT * FROM group_named WHERE {cond})
LEFT JOIN group_tag_list USING (geid) LEFT JOIN people_list USING (geid)"""


@register("group_expenses", _group_list_sql(), VIEWS)
def q_group_expenses(spark, sf):
    return G.group_expenses(ledger(spark, sf))


@register("group_expenses_one", _group_list_sql(
    f"group_name = '{SAMPLE_GROUP}' AND category_name = '1-urgent' AND amount >= 100000", one=True), VIEWS)
def q_group_expenses_one(spark, sf):
    return G.group_expenses(ledger(spark, sf), SAMPLE_GROUP,
                            {"category": "1-URGENT", "min_amount": "100000"})


@register("group_filter_tag", _group_list_sql(f"""geid IN (
    SELECT geid FROM group_expense_tags WHERE tid IN (SELECT tid FROM tags WHERE tag_name = lower('{GROUP_TAG}')))"""),
          VIEWS)
def q_group_filter_tag(spark, sf):
    return G.group_expenses(ledger(spark, sf), None, {"tag": GROUP_TAG})


@register("group_category_spending", f"""
WITH spent AS (SELECT group_name, category_name, {_money('amount')} AS total FROM group_named GROUP BY ALL)
SELECT * FROM spent WHERE category_name = lower('{SAMPLE_GROUP_CATEGORY}') AND total <> 0
""", VIEWS)
def q_group_category_spending(spark, sf):
    return G.group_category_spending(ledger(spark, sf), SAMPLE_GROUP_CATEGORY)


_TAG_USES = """
WITH uses AS (SELECT gid, tid, count(*) AS expense_count
              FROM (SELECT geid, gid FROM group_expenses) JOIN group_expense_tags USING (geid) GROUP BY gid, tid)
"""


@register("group_tag_usage", _TAG_USES + """
SELECT group_name, tag_name, expense_count FROM uses JOIN tags USING (tid) JOIN groups USING (gid)
""")
def q_group_tag_usage(spark, sf):
    return G.group_tag_usage(ledger(spark, sf))


@register("group_tag_usage_one", _TAG_USES + f"""
SELECT tag_name, expense_count FROM uses JOIN tags USING (tid)
SEMI JOIN (SELECT gid FROM groups WHERE group_name = '{SAMPLE_GROUP}') AS one USING (gid)
""")
def q_group_tag_usage_one(spark, sf):
    return G.group_tag_usage(ledger(spark, sf), SAMPLE_GROUP)


@register("group_user_expenses", f"""
WITH paid AS (SELECT gid, s.uid, {_money('split_amount')} AS total_spent
              FROM split_users s JOIN (SELECT geid, gid FROM group_expenses) USING (geid) GROUP BY gid, s.uid)
SELECT group_name, username, total_spent FROM paid JOIN users USING (uid) JOIN groups USING (gid)
""")
def q_group_user_expenses(spark, sf):
    return G.group_user_expenses(ledger(spark, sf))


# the same reports for a caller who is a member of one group only
_CALLER = f"gid IN (SELECT gid FROM user_group WHERE uid = {MEMBER_UID})"


@register("group_expenses_caller", _group_list_sql(_CALLER), VIEWS)
def q_group_expenses_caller(spark, sf):
    return G.group_expenses(ledger(spark, sf), uid=MEMBER_UID)


@register("group_category_spending_caller", f"""
SELECT group_name, {_money('amount')} AS total, category_name FROM group_named
WHERE {_CALLER} AND category_name = lower('{SAMPLE_GROUP_CATEGORY}') GROUP BY group_name, category_name
""", VIEWS)
def q_group_category_spending_caller(spark, sf):
    return G.group_category_spending(ledger(spark, sf), SAMPLE_GROUP_CATEGORY, uid=MEMBER_UID)


@register("group_tag_usage_caller", _TAG_USES + f"""
SELECT group_name, tag_name, expense_count FROM uses JOIN tags USING (tid) JOIN groups USING (gid) WHERE {_CALLER}
""")
def q_group_tag_usage_caller(spark, sf):
    return G.group_tag_usage(ledger(spark, sf), uid=MEMBER_UID)


@register("group_user_expenses_caller", f"""
WITH paid AS (SELECT gid, s.uid, {_money('split_amount')} AS total_spent
              FROM split_users s JOIN (SELECT geid, gid FROM group_expenses) USING (geid) GROUP BY gid, s.uid)
SELECT group_name, username, total_spent FROM paid JOIN users USING (uid) JOIN groups USING (gid) WHERE {_CALLER}
""")
def q_group_user_expenses_caller(spark, sf):
    return G.group_user_expenses(ledger(spark, sf), uid=MEMBER_UID)


# ---------------------------------------------------------------- joins, aggregates, sorts, sets

@register("join_expense_dims", """
SELECT e.eid, e.uid, e.amount, c.category_name, p.method, e.date
FROM expenses e JOIN categories c ON e.cid = c.cid JOIN payment_methods p ON e.pid = p.pid
""")
def q_join_expense_dims(spark, sf):
    L = ledger(spark, sf)
    return J.with_dims(L.expenses, L).select("eid", "uid", "amount", "category_name", "method", "date")


@register("join_expense_tags", """
SELECT e.eid, string_agg(t.tag_name, ', ' ORDER BY t.tag_name) AS tags
FROM expenses e LEFT JOIN expenses_tags et ON e.eid = et.eid LEFT JOIN tags t ON et.tid = t.tid
GROUP BY e.eid
""")
def q_join_expense_tags(spark, sf):
    L = ledger(spark, sf)
    return J.with_tags(L.expenses.select("eid"), L)


@register("agg_tags", """
SELECT et.eid, string_agg(t.tag_name, ', ' ORDER BY t.tag_name) AS tags
FROM expenses_tags et JOIN tags t ON et.tid = t.tid GROUP BY et.eid
""")
def q_agg_tags(spark, sf):
    return J.tag_lists(ledger(spark, sf))


@register("semi_tagged_expenses", """
SELECT e.eid, e.uid, e.amount FROM expenses e
WHERE EXISTS (SELECT 1 FROM expenses_tags et WHERE et.eid = e.eid)
""")
def q_semi_tagged_expenses(spark, sf):
    L = ledger(spark, sf)
    return L.expenses.join(L.expenses_tags, "eid", "left_semi").select("eid", "uid", "amount")


@register("sort_expenses", "SELECT eid, amount, date FROM expenses ORDER BY amount DESC, eid")
def q_sort_expenses(spark, sf):
    L = ledger(spark, sf)
    return L.expenses.select("eid", "amount", "date").orderBy(F.desc("amount"), "eid")


@register("split_participants", """
SELECT geid, uid FROM split_users UNION SELECT geid, uid FROM group_expenses
""")
def q_split_participants(spark, sf):
    L = ledger(spark, sf)
    return (L.split_users.select("geid", "uid")
            .unionByName(L.group_expenses.select("geid", "uid")).distinct())


# the mapping makes every participant a member, so every third user has left all groups here
@register("split_non_members", """
WITH people AS (SELECT geid, uid FROM split_users UNION SELECT geid, uid FROM group_expenses)
SELECT geid, people.uid FROM people JOIN (SELECT geid, gid FROM group_expenses) USING (geid)
ANTI JOIN (SELECT uid, gid FROM user_group WHERE uid % 3 <> 0) AS still USING (uid, gid)
""")
def q_split_non_members(spark, sf):
    L = ledger(spark, sf)
    members = L.user_group.filter(F.col("uid") % 3 != 0)
    parts = (L.split_users.select("geid", "uid")
             .unionByName(L.group_expenses.select("geid", "uid")).distinct())
    return (parts.join(L.group_expenses.select("geid", "gid"), "geid")
            .join(members, ["uid", "gid"], "left_anti").select("geid", "uid"))


# ---------------------------------------------------------------- D1-D9

AS_OF = "2001-07-15"
PIVOT_CATEGORIES = ["1-urgent", "2-high", "3-medium", "4-not specified", "5-low"]

_TOP_DIM = """
SELECT uid, {col}, "count" FROM (
  SELECT e.uid, {col}, COUNT(*) AS "count",
         row_number() OVER (PARTITION BY e.uid ORDER BY COUNT(*) DESC, MAX(e.date) DESC, {col}) AS rn
  FROM expenses e JOIN categories c ON e.cid = c.cid JOIN payment_methods p ON e.pid = p.pid
  GROUP BY e.uid, {col}
) WHERE rn = 1
"""


@register("dash_top_category", _TOP_DIM.format(col="c.category_name").replace(
    "SELECT uid, c.category_name,", "SELECT uid, category_name,"))
def q_dash_top_category(spark, sf):
    return D.top_category(ledger(spark, sf))


@register("dash_top_method", _TOP_DIM.format(col="p.method").replace(
    "SELECT uid, p.method,", "SELECT uid, method,"))
def q_dash_top_method(spark, sf):
    return D.top_method(ledger(spark, sf))


@register("dash_month_totals", f"""
SELECT uid, this_month, last_month,
       CASE WHEN last_month > 0 THEN (this_month - last_month) / last_month * 100 END AS pct_change
FROM (
  SELECT uid,
    COALESCE({_money("CASE WHEN date >= DATE '2001-07-01' THEN amount END")}, 0.0) AS this_month,
    COALESCE({_money("CASE WHEN date >= DATE '2001-06-01' AND date < DATE '2001-07-01' THEN amount END")}, 0.0) AS last_month
  FROM expenses GROUP BY uid
)
""")
def q_dash_month_totals(spark, sf):
    return D.month_totals(ledger(spark, sf), AS_OF)


@register("dash_category_totals", f"""
SELECT e.uid, c.category_name, {_money('e.amount')} AS total
FROM expenses e JOIN categories c ON e.cid = c.cid GROUP BY e.uid, c.category_name
""")
def q_dash_category_totals(spark, sf):
    return D.category_totals(ledger(spark, sf))


@register("dash_monthly_totals", f"""
SELECT uid, strftime(date, '%Y-%m') AS month, {_money('amount')} AS total
FROM expenses GROUP BY uid, strftime(date, '%Y-%m')
""")
def q_dash_monthly_totals(spark, sf):
    return D.monthly_totals(ledger(spark, sf))


@register("dash_recent", """
SELECT e.uid, e.eid, e.amount, c.category_name, p.method, e.date, e.description
FROM expenses e JOIN categories c ON e.cid = c.cid JOIN payment_methods p ON e.pid = p.pid
QUALIFY row_number() OVER (PARTITION BY e.uid ORDER BY e.date DESC, e.eid DESC) <= 5
""")
def q_dash_recent(spark, sf):
    return D.recent(ledger(spark, sf))


_PIVOT_COLS = ",\n".join(
    f"""  {_money(f"CASE WHEN c.category_name = '{n}' THEN e.amount END")} AS "{n}" """ for n in PIVOT_CATEGORIES)


@register("monthly_category_pivot", f"""
SELECT e.uid, strftime(e.date, '%Y-%m') AS month,
{_PIVOT_COLS}
FROM expenses e JOIN categories c ON e.cid = c.cid
GROUP BY e.uid, strftime(e.date, '%Y-%m')
""")
def q_monthly_category_pivot(spark, sf):
    return D.monthly_category_pivot(ledger(spark, sf), PIVOT_CATEGORIES)


# ---------------------------------------------------------------- C1-C5

# SQL text of the CHECK constraints (fixed values; same rules as schema.check_constraints)
_CHECK_SQL = {
    "users": [("role_in_admin_user", "role IN ('Admin', 'User')")],
    "categories": [("category_name_lower", "category_name = lower(category_name)")],
    "tags": [("tag_name_lower", "tag_name = lower(tag_name)")],
    "expenses": [("amount_non_negative", "amount >= 0")],
    "group_expenses": [("amount_non_negative", "amount >= 0")],
    "split_users": [("split_amount_non_negative", "split_amount >= 0")],
}


def _audit_not_null_sql() -> str:
    parts = []
    for table, schema in SCHEMAS.items():
        for f in schema:
            if not f.nullable:
                parts.append(f"""SELECT '{table}' AS table_name, 'not_null:{f.name}' AS constraint_name,
                    COUNT(*) FILTER (WHERE "{f.name}" IS NULL) AS violations FROM "{table}" """)
    return "\nUNION ALL\n".join(parts)


def _audit_unique_sql() -> str:
    parts = []
    keys = [(t, k, "pk") for t, k in PRIMARY_KEYS.items()] + [(t, k, "unique") for t, k in UNIQUE_KEYS.items()]
    for table, key, kind in keys:
        cols = ", ".join(key)
        parts.append(f"""SELECT '{table}' AS table_name, '{kind}:{','.join(key)}' AS constraint_name,
            CAST(COALESCE(SUM(n), 0) AS BIGINT) AS violations
            FROM (SELECT {cols}, COUNT(*) AS n FROM "{table}" GROUP BY {cols} HAVING COUNT(*) > 1)""")
    return "\nUNION ALL\n".join(parts)


def _audit_check_sql() -> str:
    return "\nUNION ALL\n".join(
        f"""SELECT '{table}' AS table_name, 'check:{name}' AS constraint_name,
            COUNT(*) FILTER (WHERE NOT ({cond})) AS violations FROM "{table}" """
        for table, checks in _CHECK_SQL.items() for name, cond in checks)


def _audit_fk_sql() -> str:
    return "\nUNION ALL\n".join(
        f"""SELECT '{t}' AS table_name, 'fk:{c}->{p}.{pc}' AS constraint_name, COUNT(*) AS violations
            FROM "{t}" x WHERE x.{c} IS NOT NULL
              AND NOT EXISTS (SELECT 1 FROM "{p}" y WHERE y.{pc} = x.{c})"""
        for t, c, p, pc in FOREIGN_KEYS)


_SPLIT_BALANCE_SQL = f"""
SELECT 'split_users' AS table_name, 'balance:sum(split_amount)=amount' AS constraint_name,
       COUNT(*) AS violations
FROM group_expenses ge
LEFT JOIN (SELECT geid, {_money('split_amount')} AS shares
           FROM split_users GROUP BY geid) s ON s.geid = ge.geid
WHERE abs(COALESCE(s.shares, 0.0) - ge.amount) > 0.01
"""


@register("audit_not_null", _audit_not_null_sql())
def q_audit_not_null(spark, sf):
    return A.not_null(ledger(spark, sf))


@register("audit_unique", _audit_unique_sql())
def q_audit_unique(spark, sf):
    return A.unique(ledger(spark, sf))


@register("audit_check", _audit_check_sql())
def q_audit_check(spark, sf):
    return A.check(ledger(spark, sf))


@register("audit_foreign_keys", _audit_fk_sql())
def q_audit_foreign_keys(spark, sf):
    return A.foreign_keys(ledger(spark, sf))


@register("audit_split_balance", _SPLIT_BALANCE_SQL)
def q_audit_split_balance(spark, sf):
    return A.split_balance(ledger(spark, sf))


# The same audits over a ledger with violations of every kind, planted at key residues.
_DAMAGE = {
    "d_users": "SELECT uid, CASE WHEN uid % 7 = 0 THEN NULL ELSE username END AS username, "
               "CASE WHEN uid % 5 = 0 THEN 'Guest' ELSE role END AS role FROM u0",
    "d_expenses": "SELECT eid - CASE WHEN eid % 13 = 0 THEN 1 ELSE 0 END AS eid, "
                  "CASE WHEN eid % 11 = 0 THEN -uid - 1 ELSE uid END AS uid, "
                  "CASE WHEN eid % 3 = 0 THEN -amount ELSE amount END AS amount, cid, pid, date, description FROM e0",
    "d_split_users": "SELECT geid, uid, CASE WHEN geid % 17 = 0 THEN split_amount + 1 ELSE split_amount END "
                     "AS split_amount FROM s0",
}


def _damaged(spark, sf):
    # the audit reads each table several times
    L = ledger_from_testdata(spark, sf, stage=("expenses_tags", "group_expenses", "split_users", "user_group",
                                               "group_expense_tags"))
    uid, eid, geid = F.col("uid"), F.col("eid"), F.col("geid")
    return L.with_tables(
        users=L.users.select("uid", F.when(uid % 7 != 0, F.col("username")).alias("username"),
                             F.when(uid % 5 == 0, F.lit("Guest")).otherwise(F.col("role")).alias("role")),
        expenses=L.expenses.select(
            (eid - F.when(eid % 13 == 0, 1).otherwise(0)).alias("eid"),
            F.when(eid % 11 == 0, -uid - 1).otherwise(uid).alias("uid"),
            F.when(eid % 3 == 0, -F.col("amount")).otherwise(F.col("amount")).alias("amount"),
            "cid", "pid", "date", "description"),
        split_users=L.split_users.select(
            "geid", "uid", F.when(geid % 17 == 0, F.col("split_amount") + 1)
            .otherwise(F.col("split_amount")).alias("split_amount")))


def _damaged_sql(sql: str) -> str:
    """``sql`` over the damaged tables: they take the names of the good ones inside the query."""
    views = {"users": ("u0", _DAMAGE["d_users"]), "expenses": ("e0", _DAMAGE["d_expenses"]),
             "split_users": ("s0", _DAMAGE["d_split_users"])}
    old = ", ".join(f"{alias} AS (SELECT * FROM {t})" for t, (alias, _) in views.items())
    new = ", ".join(f"{t} AS ({text})" for t, (_, text) in views.items())
    return f"WITH {old} SELECT * FROM (WITH {new} {sql})"


@register("audit_planted", _damaged_sql("\nUNION ALL\n".join(
    f"SELECT * FROM ({part})" for part in (_audit_not_null_sql(), _audit_unique_sql(), _audit_check_sql(),
                                           _audit_fk_sql(), _SPLIT_BALANCE_SQL))))
def q_audit_planted(spark, sf):
    return A.audit(_damaged(spark, sf))
