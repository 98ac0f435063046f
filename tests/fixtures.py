"""Hand-written edge ledgers (FIXTURES.md section 4)."""

import datetime as dt

from ledgerline.schema import Ledger

D = dt.date


def small_ledger(spark, **override):
    rows = dict(
        users=[(0, "admin", "Admin"), (1, "ann", "User"), (2, "bob", "User"), (3, "cid", "User"),
               (4, "dan", "User")],
        categories=[(1, "food"), (2, "travel")],
        payment_methods=[(1, "cash"), (2, "Online")],
        expenses=[(1, 1, 100.0, 1, 1, D(2024, 3, 1), "lunch"),
                  (2, 1, 50.0, 2, 1, D(2024, 3, 5), None),
                  (3, 2, 200.0, 1, 2, D(2024, 3, 7), "dinner"),
                  (4, 2, 150.0, 1, 1, D(2024, 4, 2), None),
                  (5, 1, 150.0, 2, 1, D(2024, 4, 3), None),
                  (6, 3, 150.0, 2, 2, D(2024, 4, 9), None)],
        tags=[(1, "a"), (2, "b"), (3, "never")],
        expenses_tags=[(1, 1), (1, 2), (3, 1)],
        groups=[(1, D(2024, 1, 1), "trip", None), (2, D(2024, 1, 1), "home", "flat")],
        user_group=[(1, 1), (2, 1), (3, 1), (4, 2)],
        group_expenses=[(10, 1, 1, 90.0, 1, 1, D(2024, 3, 2), "fuel"),
                        (11, 2, 1, 30.0, 2, 2, D(2024, 3, 3), None)],
        split_users=[(10, 1, 30.0), (10, 2, 30.0), (10, 3, 30.0), (11, 1, 15.0), (11, 2, 15.0)],
        group_expense_tags=[(10, 1), (10, 2)],
    )
    rows.update(override)
    return Ledger.from_rows(spark, **rows)
