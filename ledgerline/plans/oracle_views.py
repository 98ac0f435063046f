"""The test-table -> ledger mapping as SQL CTEs, for the DuckDB oracles.

It restates :mod:`ledgerline.sources.testdata` in plain SQL so an independent
engine can compute every report from the same raw tables.
"""

from __future__ import annotations

LEDGER_CTES = {
    "users": """SELECT CAST(c_custkey AS BIGINT) AS uid, c_name AS username,
        CASE WHEN c_custkey = 0 THEN 'Admin' ELSE 'User' END AS role FROM customer""",
    "categories": """SELECT DISTINCT CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS cid,
        lower(o_orderpriority) AS category_name FROM orders""",
    "payment_methods": """SELECT DISTINCT CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2
        WHEN 'P' THEN 3 END AS BIGINT) AS pid, lower(o_orderstatus) AS method FROM orders""",
    "expenses": """SELECT CAST(o_orderkey AS BIGINT) AS eid, CAST(o_custkey AS BIGINT) AS uid,
        CAST(o_totalprice AS DOUBLE) AS amount, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS cid,
        CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 WHEN 'P' THEN 3 END AS BIGINT) AS pid,
        CAST(o_orderdate AS DATE) AS date, CAST(NULL AS VARCHAR) AS description FROM orders""",
    "tags": """SELECT DISTINCT CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS tid,
        lower(p_brand) AS tag_name FROM part""",
    "expenses_tags": """SELECT DISTINCT CAST(l.l_orderkey AS BIGINT) AS eid,
        CAST(replace(p.p_brand, 'Brand#', '') AS BIGINT) AS tid
        FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
        WHERE l.l_orderkey IN (SELECT o_orderkey FROM orders)""",
    "groups": """SELECT CAST(n_nationkey AS BIGINT) AS gid, DATE '1995-01-01' AS date_created,
        n_name AS group_name, CAST(NULL AS VARCHAR) AS description FROM nation""",
    "participants": """SELECT CAST(l_orderkey AS BIGINT) AS geid, CAST(l_suppkey AS BIGINT) AS uid
        FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)
        UNION SELECT CAST(o_orderkey AS BIGINT), CAST(o_custkey AS BIGINT) FROM orders""",
    "participant_counts": """SELECT geid, COUNT(*) AS n FROM participants GROUP BY geid
        HAVING COUNT(*) >= 2""",
    "group_expenses": """SELECT e.eid AS geid, e.uid, CAST(c.c_nationkey AS BIGINT) AS gid, e.amount,
        e.cid, e.pid, e.date, e.description
        FROM expenses e JOIN participant_counts pc ON pc.geid = e.eid
        JOIN customer c ON c.c_custkey = e.uid""",
    "split_users": """SELECT p.geid, p.uid, ge.amount / pc.n AS split_amount
        FROM participants p JOIN participant_counts pc ON pc.geid = p.geid
        JOIN group_expenses ge ON ge.geid = p.geid""",
    "user_group": """SELECT DISTINCT s.uid, ge.gid FROM split_users s
        JOIN group_expenses ge ON ge.geid = s.geid""",
    "group_expense_tags": """SELECT eid AS geid, tid FROM expenses_tags
        WHERE eid IN (SELECT geid FROM participant_counts)""",
}


def money_sql(expr: str) -> str:
    """The exact sum of doubles in SQL text, rounded once: one 128-bit integer of 2^-64 units, read back from its
    decimal digits. Exact for amounts of 2^-11 and more and sums below 2^63."""
    unit = "18446744073709551616.0"
    return f"CAST(CAST(SUM(CAST(({expr}) * {unit} AS HUGEINT)) AS VARCHAR) AS DOUBLE) / {unit}"


def with_ledger(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the ledger CTEs (and optional extra CTEs after them)."""
    ctes = dict(LEDGER_CTES)
    if extra:
        ctes.update(extra)
    if sql.lstrip().startswith("WITH"):  # a query with views of its own
        sql = f"SELECT * FROM ({sql})"
    body = ",\n".join(f'"{name}" AS MATERIALIZED (\n{text}\n)' for name, text in ctes.items())
    return f"WITH {body}\n{sql}"
