"""Stored ledgers: appended loads, month folders, changes that rewrite touched folders only."""

import os
from datetime import date as D

from fixtures import small_ledger

from ledgerline.operators import changes as C
from ledgerline.operators import dashboard as D_
from ledgerline.operators import groups as G
from ledgerline.operators import ids
from ledgerline.operators import loads as M
from ledgerline.operators import reports as R
from ledgerline.plans.inspect import explain_text as _plan
from ledgerline.schema import TABLES, Ledger, conform
from ledgerline.sources import store

TYPED = ("seq long, uid long, amount double, category string, payment_method string, date date, "
         "description string, tags array<string>")


def _files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
            for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")}


def _rows(led):
    return {t: sorted(map(str, conform(led.table(t), t).collect())) for t in TABLES}


def _stored(spark, tmp_path):
    root = str(tmp_path / "ledger")
    small_ledger(spark).write(root)
    return root


def test_stored_ledger_reads_back_equal_and_marks_every_id(spark, tmp_path):
    root, led = _stored(spark, tmp_path), small_ledger(spark)
    back = Ledger.read(spark, root)
    assert _rows(back) == _rows(led)
    assert back.marks_current and back.id_marks.count() == 7


def test_load_appends_new_files_only_and_may_be_repeated(spark, tmp_path):
    root = _stored(spark, tmp_path)
    before = _files(root)
    batch = spark.createDataFrame([(1, 1, 5.0, "food", "cash", D(2024, 3, 5), None, ["fresh"]),
                                   (2, 1, -5.0, "food", "cash", D(2024, 3, 5), None, []),
                                   (3, 2, 6.0, "food", "cash", D(2031, 1, 31), None, ["fresh", "b"])], TYPED)
    want = None
    for _ in range(2):  # the second run stands for a retry
        res = M.add_expenses(Ledger.read(spark, root, before=1), batch)
        store.save(res, root, 1)
        got = _rows(Ledger.read(spark, root))
        assert want is None or got == want
        want = got
    assert got == _rows(res.ledger)
    after = _files(root)
    assert all(after[f] == t for f, t in before.items())
    assert all("load_id=1" in f for f in after.keys() - before.keys())
    again = M.add_expenses(Ledger.read(spark, root, before=2), batch)
    assert min(r.eid for r in again.accepted.collect()) == max(r.eid for r in res.accepted.collect()) + 1


def test_ids_come_from_the_marks_without_a_scan_of_the_facts(spark, tmp_path):
    root = _stored(spark, tmp_path)
    plan = _plan(ids.next_id_base(Ledger.read(spark, root), "expenses"))
    assert "id_marks" in plan and "ledger/expenses" not in plan


def test_date_filters_prune_month_folders(spark, tmp_path):
    led = Ledger.read(spark, _stored(spark, tmp_path))
    for df in (R.list_expenses(led, {"date": "2024-03-05"}), R.top_expenses(led, 3, "2024-02-10", "2024-03-09"),
               G.group_expenses(led, None, {"date": "2024-03-05"}), D_.month_totals(led, "2024-03-15", uid=1)):
        plan = [line for line in _plan(df).splitlines() if "PartitionFilters" in line]
        assert any("part_month" in line for line in plan), plan
    mem = small_ledger(spark)
    for lo, hi in (("2024-01-31", "2024-02-01"), ("2024-03-01", "2024-03-31"), ("2000-01-01", "2040-01-01")):
        assert R.top_expenses(led, 9, lo, hi).collect() == R.top_expenses(mem, 9, lo, hi).collect()


def test_changes_rewrite_touched_folders_only(spark, tmp_path):
    root, mem = _stored(spark, tmp_path), small_ledger(spark)
    before = _files(root)
    one = mem.expenses.orderBy("eid").first()
    moved = spark.createDataFrame([(1, one.uid, one.eid, "date", "2030-12-31"), (2, one.uid, one.eid, "tags", "new one, b")],
                                  "seq long, actor_uid long, eid long, field string, value string")
    res = C.update_expenses(Ledger.read(spark, root, before=1), moved)
    want = _rows(C.update_expenses(mem, moved).ledger)
    store.save(res, root, 1)
    assert _rows(Ledger.read(spark, root)) == want
    old_month = f"part_month={one.date.replace(day=1)}"
    after = _files(root)
    for f, t in before.items():
        if "/expenses/" in f and old_month not in f:
            assert after[f] == t
        if "/users/" in f or "/group_expenses/" in f:
            assert after[f] == t


def test_deletes_empty_folders_and_keep_ids(spark, tmp_path):
    root, mem = _stored(spark, tmp_path), small_ledger(spark)
    pairs = [(i, r.uid, r.eid) for i, r in enumerate(mem.expenses.collect())]
    gone = spark.createDataFrame(pairs, "seq long, actor_uid long, eid long")  # every expense: every folder loses its rows
    store.save(C.delete_expenses(Ledger.read(spark, root, before=1), gone), root, 1)
    led = Ledger.read(spark, root, before=2)
    assert led.expenses.count() == 0 and led.expenses_tags.count() == 0
    batch = spark.createDataFrame([(1, 1, 5.0, "food", "cash", D(2024, 3, 5), None, [])], TYPED)
    assert M.add_expenses(led, batch).accepted.first().eid == max(e for _, _, e in pairs) + 1
    trip = spark.createDataFrame([(1, 1, "trip")], "seq long, actor_uid long, group_name string")
    res = C.delete_groups(led, trip)
    want = _rows(res.ledger)
    folder = str(tmp_path / "staged")
    removed = store.stage_change(res, folder)
    for _ in range(2):  # an interrupted change is applied again
        store.apply_staged(spark, folder, root, 2, list(res.added), removed)
        assert _rows(Ledger.read(spark, root)) == want


def test_users_and_roles_over_a_stored_ledger(spark, tmp_path):
    root = _stored(spark, tmp_path)
    led = Ledger.read(spark, root, before=1)
    store.save(C.add_users(led, spark.createDataFrame([(1, "zoe", "User")], "seq long, username string, role string")), root, 1)
    led = Ledger.read(spark, root, before=2)
    zoe = led.users.filter("username = 'zoe'").first().uid
    up = C.update_users(led, spark.createDataFrame([(1, zoe, "role", "Admin")], "seq long, uid long, field string, value string"))
    want = _rows(up.ledger)
    store.save(up, root, 2)
    led = Ledger.read(spark, root, before=3)
    assert _rows(led) == want
    drop = C.delete_users(led, spark.createDataFrame([(1, 2)], "seq long, uid long"), cascade=True)
    want = _rows(drop.ledger)
    store.save(drop, root, 3)
    assert _rows(Ledger.read(spark, root)) == want


def _batch(spark, i):
    rows = [(1, 1, 5.0 + i, "food", "cash", D(2024, 3, 5), None, ["fresh"]), (2, 2, 6.0, "food", "cash", D(2024, 4 + i % 2, 1), None, [])]
    return spark.createDataFrame(rows, TYPED)


def test_deletes_of_ids_open_the_folders_of_their_blocks_only(spark, tmp_path, monkeypatch):
    from ledgerline import schema

    monkeypatch.setattr(schema, "INDEX_BLOCK", 2)  # the small ledger's ids then lie in several blocks
    root = _stored(spark, tmp_path)
    for n in (1, 2, 3):
        store.save(M.add_expenses(Ledger.read(spark, root, before=n), _batch(spark, n)), root, n)
    led = Ledger.read(spark, root, before=4)
    newest = max(r.eid for r in led.expenses.collect())
    keys = spark.createDataFrame([(newest,)], "eid long")
    opened = store.folders_with(spark, root, "expenses", keys, 4)
    assert any("concat_ws" in line for line in _plan(opened).splitlines() if "PartitionFilters" in line)
    assert {r[0] for r in opened.select("load_id").distinct().collect()} == {3}
    all_files = _files(f"{root}/expenses")
    owner = led.expenses.filter(f"eid = {newest}").first().uid
    gone = spark.createDataFrame([(1, owner, newest)], "seq long, actor_uid long, eid long")
    res = C.delete_expenses(led, gone)
    want = _rows(res.ledger)
    store.save(res, root, 4)
    assert _rows(Ledger.read(spark, root)) == want
    after = _files(f"{root}/expenses")
    assert all(after[f] == t for f, t in all_files.items() if "load_id=3" not in f)


def test_folding_loads_keeps_every_row_in_few_files(spark, tmp_path):
    root, n = _stored(spark, tmp_path), 6
    for i in range(1, n + 1):
        store.save(M.add_expenses(Ledger.read(spark, root, before=i), _batch(spark, i)), root, i)
    want, marks = _rows(Ledger.read(spark, root)), sorted(map(str, Ledger.read(spark, root).id_marks.groupBy("table_name").max("max_id").collect()))
    folder = str(tmp_path / "fold")
    store.stage_fold(spark, root, 0, n, folder)
    for _ in range(2):  # an interrupted fold is applied again
        store.apply_fold(spark, folder, root, n)
        led = Ledger.read(spark, root)
        assert _rows(led) == want and led.marks_current
    assert sorted(map(str, led.id_marks.groupBy("table_name").max("max_id").collect())) == marks
    months = [os.path.dirname(f) for f in _files(f"{root}/expenses")]
    assert all("load_id=6" in m for m in months) and len(set(months)) == len(months)  # one file a month here
    # the ledger goes on: a load, a delete by id, and another fold
    res = M.add_expenses(Ledger.read(spark, root, before=n + 1), _batch(spark, 9))
    want = _rows(res.ledger)
    store.save(res, root, n + 1)
    store.fold(spark, root, 3, n + 1)
    assert _rows(Ledger.read(spark, root)) == want
    led = Ledger.read(spark, root, before=n + 2)
    one = led.expenses.orderBy("eid").first()
    res = C.delete_expenses(led, spark.createDataFrame([(1, one.uid, one.eid)], "seq long, actor_uid long, eid long"))
    want = _rows(res.ledger)
    store.save(res, root, n + 2)
    assert _rows(Ledger.read(spark, root)) == want
