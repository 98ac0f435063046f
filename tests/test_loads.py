"""Loads, changes and audit on hand-written ledgers (FIXTURES.md section 4)."""

import pytest
from fixtures import D, small_ledger

from ledgerline.operators import audit as A
from ledgerline.operators import changes as C
from ledgerline.operators import loads as M

TEXT = "seq long, uid long, amount string, category string, payment_method string, date string, description string, tag string"


def reasons(res):
    return dict((r.seq, r.reason) for r in res.rejects.collect())


def test_personal_import_rules(spark):
    led = small_ledger(spark)
    batch = spark.createDataFrame([
        (1, 1, " 12.5 ", " FOOD ", "cash", "2024-3-5", "ok", "a, new"),
        (2, 1, "abc", "food", "cash", "2024-03-05", None, None),
        (3, 1, "5", "food", "cash", "2024-02-30", None, None),
        (4, 1, "5", "nosuch", "cash", "2024-03-05", None, None),
        (5, 1, "5", "food", "online", "2024-03-05", None, None),
        (6, 1, "-5", "food", "cash", "2024-03-05", None, None),
        (7, 1, "5", "food", "cash", "2024-03-05", None, "Upper"),
        (8, 1, "5", "food", "cash", "2024-03-05", None, "x,x"),
        (9, 1, "inf", "food", "cash", "2024-03-05", None, None),
        (10, 1, "1_000", "food", "cash", "2024-03-05", None, None),
    ], TEXT)
    res = M.import_expenses(led, batch)
    assert reasons(res) == {2: "invalid amount", 3: "invalid date", 4: "unknown category",
                            5: "unknown payment method", 6: "amount must be positive",
                            7: "tag not lower-case", 8: "repeated tag", 9: "invalid amount"}
    acc = {r.eid: r for r in res.accepted.collect()}
    assert sorted(acc) == [7, 8]  # ids continue after the largest eid, in seq order
    assert acc[7].amount == 12.5 and acc[7].date == D(2024, 3, 5) and acc[7].tags == "a, new"
    assert acc[8].amount == 1000.0
    new_tags = {r.tag_name: r.tid for r in res.ledger.tags.collect()}
    assert new_tags["new"] == 4
    assert res.ledger.expenses.count() == 8
    # accepted + rejected = input
    assert res.accepted.count() + res.rejects.count() == batch.count()


def test_method_case_import_vs_direct_add(spark):
    """Stored 'Online': the import's exact lower-case match fails, the direct add finds it."""
    led = small_ledger(spark)
    imp = spark.createDataFrame([(1, 1, "5", "food", "Online", "2024-03-05", None, None)], TEXT)
    assert reasons(M.import_expenses(led, imp)) == {1: "unknown payment method"}
    typed = spark.createDataFrame(
        [(1, 1, 5.0, "food", "online", D(2024, 3, 5), None, [])],
        "seq long, uid long, amount double, category string, payment_method string, date date, "
        "description string, tags array<string>")
    res = M.add_expenses(led, typed)
    assert reasons(res) == {} and [r.pid for r in res.accepted.collect()] == [2]


GROUP = ("seq long, group_name string, creator_username string, amount string, category_name string, "
         "payment_method string, expense_date string, expense_description string, tags string, "
         "split_usernames string, split_amounts string")


def _group_batch(spark, rows):
    return spark.createDataFrame(rows, GROUP)


def _splits(res):
    names = {0: "admin", 1: "ann", 2: "bob", 3: "cid", 4: "dan"}
    return {(r.geid, names[r.uid]): r.split_amount for r in res.extra["splits"].collect()}


def test_group_import_split_rules(spark):
    led = small_ledger(spark)
    res = M.import_group(led, _group_batch(spark, [
        # amounts off by 0.005: kept as given
        (1, "trip", "ann", "30", "food", "cash", "2024-05-01", None, None, "admin, ann, bob", "10.005, 10, 9.995"),
        # off by 1: the first share takes the difference
        (2, "trip", "ann", "30", "food", "cash", "2024-05-01", None, None, "admin, ann, bob", "9, 10, 10"),
        # importer missing from the names: counts differ -> even split, given amounts ignored
        (3, "trip", "ann", "30", "food", "cash", "2024-05-01", None, None, "ann, bob", "20, 10"),
        # unknown name: counted in the even split, its share is lost
        (4, "trip", "ann", "30", "food", "cash", "2024-05-01", None, None, "admin, nobody", None),
        # repeated participant rejects the row
        (5, "trip", "ann", "30", "food", "cash", "2024-05-01", None, None, "ann, ann", None),
        # new category is created, missing fields reject
        (6, "newgrp", "zed", "30", "Snacks", "cash", "2024-05-01", None, "X, y", None, None),
        (7, "trip", "ann", "", "food", "cash", "2024-05-01", None, None, None, None),
    ]), importer_uid=0, as_of=D(2024, 6, 1))
    assert reasons(res) == {5: "repeated participant", 7: "missing required field"}
    s = _splits(res)
    g = {r.seq: r.geid for r in res.accepted.collect()}
    assert s[(g[1], "admin")] == 10.005 and s[(g[1], "bob")] == 9.995
    assert s[(g[2], "admin")] == pytest.approx(10.0) and s[(g[2], "ann")] == 10.0
    assert s[(g[3], "ann")] == 10.0 and s[(g[3], "admin")] == 10.0
    assert s[(g[4], "admin")] == 15.0 and (g[4], "nobody") not in s
    cats = {r.category_name for r in res.ledger.categories.collect()}
    assert "snacks" in cats
    newgrp = res.ledger.groups.filter("group_name = 'newgrp'").collect()
    assert len(newgrp) == 1 and newgrp[0].date_created == D(2024, 6, 1)
    assert {r.tag_name for r in res.extra["new_tags"].collect()} == {"x", "y"}
    # creator falls back to the importer when the name is unknown
    assert {r.uid for r in res.accepted.filter("seq = 6").collect()} == {0}


M13 = ("seq long, actor_uid long, group_name string, amount double, category string, payment_method string, "
       "date date, description string, tags array<string>, split_usernames array<string>")


def test_even_split_rules(spark):
    led = small_ledger(spark)
    batch = spark.createDataFrame([
        (1, 1, "trip", 100.0, "FOOD", "cash", D(2024, 5, 1), None, [], ["bob", "cid"]),
        (2, 1, "trip", 60.0, "food", "cash", D(2024, 5, 1), None, [], ["bob", "ghost"]),
        (3, 1, "trip", 60.0, "food", "cash", D(2024, 5, 1), None, [], ["dan"]),
        (4, 1, "trip", 60.0, "food", "cash", D(2024, 5, 1), None, [], []),
        (5, 4, "trip", 60.0, "food", "cash", D(2024, 5, 1), None, [], ["ann"]),
        (6, 0, "trip", 60.0, "food", "cash", D(2024, 5, 1), None, [], ["ann"]),
    ], M13)
    res = M.add_group_expenses(led, batch)
    assert reasons(res) == {3: "participant not a member", 4: "fewer than two participants",
                            5: "actor not a member", 6: "participant not a member"}
    s = _splits(res)
    g = {r.description: r for r in res.accepted.collect()}
    shares = sorted(v for (geid, _), v in s.items())
    assert shares.count(100.0 / 3) == 3 and shares.count(30.0) == 2
    assert res.ledger.split_users.groupBy("geid").count().count() == 4


def test_update_and_delete_expenses(spark):
    led = small_ledger(spark)
    upd = spark.createDataFrame([
        (1, 1, 1, "amount", "12"), (2, 1, 1, "amount", "13"), (3, 2, 1, "description", "x"),
        (4, 1, 2, "category", "FOOD"), (5, 1, 2, "tags", "z, a"), (6, 1, 1, "colour", "red"),
        (7, 1, 5, "date", "2024-13-01")], "seq long, actor_uid long, eid long, field string, value string")
    res = C.update_expenses(led, upd)
    assert reasons(res) == {3: "not the owner", 6: "invalid field", 7: "invalid value"}
    e = {r.eid: r for r in res.ledger.expenses.collect()}
    assert e[1].amount == 13.0 and e[1].description == "lunch" and e[2].cid == 1
    links = {(r.eid, r.tid) for r in res.ledger.expenses_tags.collect()}
    assert (2, 1) in links and (2, 4) in links and (1, 1) in links
    dele = spark.createDataFrame([(1, 2, 1), (2, 1, 1)], "seq long, actor_uid long, eid long")
    res2 = C.delete_expenses(led, dele)
    assert reasons(res2) == {1: "not the owner"}
    assert 1 not in {r.eid for r in res2.ledger.expenses.collect()}
    assert all(r.eid != 1 for r in res2.ledger.expenses_tags.collect())


def test_add_dimension_rows_and_duplicates(spark):
    led = small_ledger(spark)
    b = spark.createDataFrame([(1, "eve", "Boss"), (2, "eve", "User"), (3, "eve", "User"), (4, "ann", "User")],
                              "seq long, username string, role string")
    res = C.add_users(led, b)
    assert reasons(res) == {1: "invalid role", 3: "duplicate in batch", 4: "already exists"}
    assert [(r.uid, r.username) for r in res.ledger.users.filter("username = 'eve'").collect()] == [(5, "eve")]
    pm = C.add_payment_methods(led, spark.createDataFrame([(1, "ONLINE"), (2, "card")], "seq long, method string"))
    assert reasons(pm) == {1: "already exists"}


def test_members_and_group_updates(spark):
    led = small_ledger(spark)
    b = spark.createDataFrame([(1, 4, "ann", "trip"), (2, 1, "dan", "trip"), (3, 1, "dan", "trip"),
                               (4, 1, "ann", "trip"), (5, 1, "zed", "trip")],
                              "seq long, actor_uid long, username string, group_name string")
    res = C.add_members(led, b)
    assert reasons(res) == {1: "actor not a member", 3: "duplicate in batch", 4: "already exists",
                            5: "unknown user"}
    u = C.update_groups(led, spark.createDataFrame(
        [(1, 4, "trip", "description", "x"), (2, 1, "trip", "group_name", "home"),
         (3, 1, "trip", "group_name", "tour")],
        "seq long, actor_uid long, group_name string, field string, value string"))
    assert reasons(u) == {1: "no access to group", 2: "already exists"}
    assert {r.group_name for r in u.ledger.groups.collect()} == {"tour", "home"}


def test_delete_group_cascades(spark):
    led = small_ledger(spark)
    res = C.delete_groups(led, spark.createDataFrame([(1, 1, "trip")], "seq long, actor_uid long, group_name string"))
    L2 = res.ledger
    assert L2.group_expenses.count() == 0 and L2.split_users.count() == 0
    assert L2.group_expense_tags.count() == 0 and {r.gid for r in L2.user_group.collect()} == {2}
    assert {r.group_name for r in L2.groups.collect()} == {"home"}


def test_audit_finds_planted_violations(spark):
    led = small_ledger(spark, users=[(0, "admin", "Admin"), (1, "ann", "Chief"), (1, "ann2", "User"),
                                     (2, "bob", "User"), (3, "cid", "User"), (4, "dan", "User")],
                       tags=[(1, "a"), (2, "B"), (3, "never")],
                       split_users=[(10, 1, 30.0), (10, 2, 30.0), (11, 1, 15.0), (11, 2, 15.0)])
    # a user deleted with expenses left -> orphans
    led = C.delete_users(led, spark.createDataFrame([(1, 3)], "seq long, uid long")).ledger
    got = {(r.table_name, r.constraint_name): r.violations for r in A.audit(led).collect()}
    assert got[("users", "pk:uid")] == 2
    assert got[("users", "check:role_in_admin_user")] == 1
    assert got[("tags", "check:tag_name_lower")] == 1
    assert got[("expenses", "fk:uid->users.uid")] == 1
    assert got[("split_users", "balance:sum(split_amount)=amount")] == 1
    assert sum(v for (t, c), v in got.items() if c.startswith("not_null")) == 0


def test_ids_are_not_reused_after_delete(spark, tmp_path):
    led = small_ledger(spark)
    gone = C.delete_expenses(led, spark.createDataFrame([(1, 3, 6)], "seq long, actor_uid long, eid long")).ledger
    assert 6 not in {r.eid for r in gone.expenses.collect()}
    # the mark survives a write / read of the version
    path = str(tmp_path / "v1")
    gone.write(path)
    again = __import__("ledgerline").Ledger.read(spark, path)
    typed = spark.createDataFrame([(1, 1, 5.0, "food", "cash", D(2024, 3, 5), None, [])],
                                  "seq long, uid long, amount double, category string, payment_method string, "
                                  "date date, description string, tags array<string>")
    res = M.add_expenses(again, typed)
    assert [r.eid for r in res.accepted.collect()] == [7]


def test_even_splits_balance(spark):
    led = small_ledger(spark)
    batch = spark.createDataFrame([
        (1, 1, "trip", 100.0, "food", "cash", D(2024, 5, 1), None, ["t"], ["bob", "cid"]),
        (2, 2, "trip", 0.07, "food", "cash", D(2024, 5, 1), None, [], ["ann"])], M13)
    res = M.add_group_expenses(led, batch)
    got = A.split_balance(res.ledger).collect()[0]
    assert got.violations == 0


def test_allocate_ids_is_a_gapless_rank(spark):
    from pyspark.sql import functions as F

    from ledgerline.operators.ids import allocate_ids

    rows = spark.range(0, 30000).select(((F.col("id") * 7919) % 100003).alias("seq"))  # unique, shuffled
    base = spark.createDataFrame([(41,)], "_base long")
    out = allocate_ids(rows, ["seq"], "eid", base).toPandas().sort_values("seq")
    assert list(out["eid"]) == list(range(42, 42 + 30000))


def test_delete_user_with_and_without_cascade(spark):
    led = small_ledger(spark)
    batch = spark.createDataFrame([(1, 2), (2, 99)], "seq long, uid long")
    plain = C.delete_users(led, batch)
    assert reasons(plain) == {2: "not found"}
    assert plain.ledger.expenses.filter("uid = 2").count() == 2  # orphans stay (no cascade)
    full = C.delete_users(led, batch, cascade=True).ledger
    assert full.expenses.filter("uid = 2").count() == 0
    assert {r.eid for r in full.expenses_tags.collect()} == {1}  # expense 3 (bob's) lost its tag link
    assert full.user_group.filter("uid = 2").count() == 0
    # bob created 11, so it goes; in 10 his 30.0 pass to the other two
    assert {tuple(r) for r in full.split_users.collect()} == {(10, 1, 45.0), (10, 3, 45.0)}
    assert {r.geid for r in full.group_expenses.collect()} == {10}
    odd = small_ledger(spark, split_users=[(10, 2, 90.0), (11, 1, 0.0), (11, 2, 30.0)], group_expenses=[
        (10, 1, 1, 90.0, 1, 1, D(2024, 3, 2), None), (11, 1, 1, 30.0, 2, 2, D(2024, 3, 3), None)])
    one = C.delete_users(odd, batch, cascade=True).ledger  # nobody is left in 10; in 11 a share of 0 takes all
    assert [tuple(r) for r in one.split_users.collect()] == [(11, 1, 30.0)] and one.group_expenses.count() == 1
    for after in (full, one):
        assert A.foreign_keys(after).unionByName(A.split_balance(after)).filter("violations > 0").count() == 0
    tags = C.delete_tags(led, spark.createDataFrame([(1, " A "), (2, "zzz")], "seq long, tag_name string"),
                         cascade=True)
    assert reasons(tags) == {2: "not found"}
    assert all(r.tid != 1 for r in tags.ledger.expenses_tags.collect())
    assert all(r.tid != 1 for r in tags.ledger.group_expense_tags.collect())


def test_add_groups_and_update_users(spark):
    led = small_ledger(spark)
    res = C.add_groups(led, spark.createDataFrame(
        [(1, 1, " club ", "x"), (2, 2, "club", "y"), (3, 9, "solo", None), (4, 2, "trip", None)],
        "seq long, uid long, group_name string, description string"), as_of=D(2024, 6, 1))
    assert reasons(res) == {2: "duplicate in batch", 3: "unknown user", 4: "already exists"}
    club = res.ledger.groups.filter("group_name = 'club'").collect()
    assert len(club) == 1 and club[0].gid == 3 and club[0].date_created == D(2024, 6, 1)
    assert (1, 3) in {(r.uid, r.gid) for r in res.ledger.user_group.collect()}
    up = C.update_users(led, spark.createDataFrame(
        [(1, 1, "role", "Admin"), (2, 1, "role", "User"), (3, 2, "role", "Root"), (4, 9, "role", "User"),
         (5, 2, "password", "x")], "seq long, uid long, field string, value string"))
    assert reasons(up) == {3: "invalid value", 4: "not found", 5: "invalid field"}
    assert {r.uid: r.role for r in up.ledger.users.collect()}[1] == "User"  # last change wins


def test_group_import_scope_rule(spark):
    """Members and Admins write to an existing group, others do not; new groups are open; importers must exist."""
    cols = ("seq long, group_name string, creator_username string, amount string, category_name string, "
            "payment_method string, expense_date string, expense_description string, tags string, "
            "split_usernames string, split_amounts string")
    rows = [(i, g, "ann", "30", "food", "cash", "2024-05-01", "x", "", "ann, bob", "15, 15")
            for i, g in enumerate(["trip", "home", "brand new"], 1)]
    batch = spark.createDataFrame(rows, cols)
    led = small_ledger(spark)

    def refused(uid):
        return sorted((r.seq, r.reason) for r in M.import_group(led, batch, uid).rejects.collect())

    assert refused(0) == []
    assert refused(1) == [(2, M.R_NO_ACCESS)]
    assert refused(4) == [(1, M.R_NO_ACCESS)]
    assert refused(99) == [(i, M.R_UNKNOWN_IMPORTER) for i in (1, 2, 3)]


def test_no_amount_is_too_large(spark):
    from ledgerline.operators import reports as R

    led = small_ledger(spark)
    batch = spark.createDataFrame(
        [(1, 1, "1e12", "2024-05-01", "food", "cash", "", ""), (2, 1, "3e300", "2024-05-01", "food", "cash", "", ""),
         (3, 1, "2e-7", "2024-05-01", "travel", "cash", "", "")],
        "seq long, uid long, amount string, date string, category string, payment_method string, "
        "description string, tag string")
    res = M.import_expenses(led, batch)
    assert res.rejects.count() == 0
    got = {(r.month, r.category_name): r.total for r in R.monthly_category_spending(res.ledger, 1).collect()}
    assert got["2024-05", "food"] == 3e300 and got["2024-05", "travel"] == 2e-7
