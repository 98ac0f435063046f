"""Edge cases of the reports, filters and dashboard (FIXTURES.md section 4)."""

import datetime as dt

import pytest
from fixtures import D, small_ledger

from ledgerline.operators import dashboard as Dash
from ledgerline.operators import groups as G
from ledgerline.operators import reports as R


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_untagged_expense_has_null_tags(spark):
    out = {r.eid: r.tags for r in R.list_expenses(small_ledger(spark), uid=1).collect()}
    assert out[2] is None and out[1] == "a, b"


def test_list_is_newest_first(spark):
    assert [r.eid for r in R.list_expenses(small_ledger(spark), uid=1).collect()] == [5, 2, 1]


def test_personal_tag_filter_narrows_the_list(spark):
    out = rows(R.list_expenses(small_ledger(spark), {"tag": "A"}, uid=1).select("eid", "tags"))
    assert out == [(1, "a")]


def test_group_tag_filter_keeps_all_tags(spark):
    out = rows(G.group_expenses(small_ledger(spark), "trip", {"tag": "a"}).select("geid", "tags", "usernames"))
    assert out == [(10, "a,b", "ann,bob,cid")]


def test_uid_none_equals_union_of_users(spark):
    led = small_ledger(spark)
    everyone = {r.eid for r in R.list_expenses(led).filter("uid = 2").collect()}
    assert everyone == {r.eid for r in R.list_expenses(led, uid=2).collect()}


def test_highest_spender_keeps_ties(spark):
    # April: bob 150, ann 150, cid 150 -> three-way tie
    out = {(r.month, r.username) for r in R.highest_spender_per_month(small_ledger(spark)).collect()}
    assert {("2024-04", "ann"), ("2024-04", "bob"), ("2024-04", "cid")} <= out
    assert ("2024-03", "bob") in out


def test_frequent_category_keeps_ties(spark):
    assert rows(R.frequent_category(small_ledger(spark), uid=1)) == [("travel", 2)]


def test_frequent_category_tie(spark):
    led = small_ledger(spark, expenses=[(1, 1, 5.0, 1, 1, D(2024, 1, 1), None),
                                        (2, 1, 5.0, 2, 1, D(2024, 1, 2), None)])
    assert sorted(rows(R.frequent_category(led, uid=1))) == [("food", 1), ("travel", 1)]


def test_above_average_is_strict_and_uses_all_users(spark):
    # food: 100, 200, 150 -> avg 150; ann's 100 is below, bob's 200 above, bob's 150 equal (excluded)
    out = rows(R.above_average_expenses(small_ledger(spark)).select("eid", "category_avg"))
    assert (3, 150.0) in out and all(e != 4 for e, _ in out)


def test_unused_tag_absent(spark):
    names = {r.tag_name for r in R.tag_expenses(small_ledger(spark)).collect()}
    assert "never" not in names and names == {"a", "b"}


def test_top_range_inclusive_and_checked(spark):
    led = small_ledger(spark)
    out = rows(R.top_expenses(led, 5, "2024-03-05", "2024-03-05", uid=1).select("eid"))
    assert out == [(2,)]
    with pytest.raises(ValueError):
        R.top_expenses(led, 5, "2024-04-01", "2024-03-01", uid=1)


def test_top_per_user_limits_each_user(spark):
    out = R.top_expenses(small_ledger(spark), 1, "2024-01-01", "2024-12-31")
    assert {(r.uid, r.eid) for r in out.collect()} == {(1, 5), (2, 3), (3, 6)}


def test_unknown_filter_key_raises(spark):
    with pytest.raises(ValueError):
        R.list_expenses(small_ledger(spark), {"colour": "red"})


def test_amount_range_filter(spark):
    out = {r.eid for r in R.list_expenses(small_ledger(spark), {"amount": "60-160"}).collect()}
    assert out == {1, 4, 5, 6}


def test_member_without_splits_absent(spark):
    out = {r.username for r in G.group_user_expenses(small_ledger(spark), "trip").collect()}
    assert out == {"ann", "bob", "cid"}


def test_group_scope_admin_and_member(spark):
    led = small_ledger(spark)
    assert {r.gid for r in G.group_scope(led, 0).collect()} == {1, 2}
    assert {r.gid for r in G.group_scope(led, 4).collect()} == {2}


def test_group_tag_usage_counts_only_group(spark):
    assert sorted(rows(G.group_tag_usage(small_ledger(spark), "trip"))) == [("a", 1), ("b", 1)]
    assert rows(G.group_tag_usage(small_ledger(spark), "home")) == []


def test_month_totals_and_null_change(spark):
    led = small_ledger(spark)
    out = {r.uid: r for r in Dash.month_totals(led, dt.date(2024, 4, 20)).collect()}
    assert out[1].this_month == 150.0 and out[1].last_month == 150.0 and out[1].pct_change == 0.0
    assert out[3].last_month == 0.0 and out[3].pct_change is None


def test_top_category_tie_breaks_on_latest_use(spark):
    led = small_ledger(spark, expenses=[(1, 1, 5.0, 1, 1, D(2024, 1, 1), None),
                                        (2, 1, 5.0, 2, 1, D(2024, 1, 2), None)])
    assert rows(Dash.top_category(led, uid=1)) == [("travel", 1)]


def test_pivot_keeps_first_month(spark):
    out = Dash.monthly_category_pivot(small_ledger(spark), ["food", "travel"], uid=1).orderBy("month")
    assert rows(out) == [("2024-03", 100.0, 50.0), ("2024-04", None, 150.0)]


def test_highest_spender_ignores_deleted_users(spark):
    base = small_ledger(spark)
    rows = [tuple(r) for r in base.expenses.collect()] + [(9, 99, 1000.0, 1, 1, D(2024, 4, 5), None)]
    led = small_ledger(spark, expenses=rows)
    out = {(r.month, r.username) for r in R.highest_spender_per_month(led).collect()}
    assert {u for m, u in out if m == "2024-04"} == {"ann", "bob", "cid"}
