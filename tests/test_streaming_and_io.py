"""CSV readers, CSV round trip (group export -> group import), export text."""

import tempfile

from fixtures import small_ledger

from ledgerline.functions.text import float_text
from ledgerline.operators import exports as X
from ledgerline.operators import loads as M
from ledgerline.session import scratch_path
from ledgerline.sources import csv_io


def test_csv_reader_maps_by_header_and_drops_extra_fields(spark):
    path = tempfile.mkdtemp(prefix="csv-")
    with open(f"{path}/x.csv", "w") as f:
        f.write("tag,date,payment_method,category,amount\n")
        f.write('"a, b",2024-03-25,cash,travel,150.00,surplus\n')
    row = csv_io.read_expense_csv(spark, path).collect()[0]
    assert (row.amount, row.category, row.tag, row.description) == ("150.00", "travel", "a, b", None)


def test_group_export_round_trips_through_group_import(spark):
    led = small_ledger(spark)
    path = scratch_path(spark, "group-export")
    csv_io.write_csv(X.group_export(led, "trip"), path, single_file=True)
    back = csv_io.read_group_csv(spark, path)
    # import into an empty copy of the group's expenses, as admin who is not a participant ->
    # admin is appended, so shares become even; with ann (a participant) as importer they stay
    empty = led.with_tables(group_expenses=led.group_expenses.limit(0), split_users=led.split_users.limit(0))
    res = M.import_group(empty, back, importer_uid=1)
    assert res.rejects.count() == 0
    got = {(r.amount, r.date) for r in res.accepted.collect()}
    assert got == {(r.amount, r.date) for r in led.group_expenses.collect()}
    shares = sorted((r.uid, r.split_amount) for r in res.extra["splits"].collect())
    assert shares == sorted((r.uid, r.split_amount) for r in led.split_users.collect())


def test_personal_export_text(spark):
    led = small_ledger(spark, expenses=[(1, 1, 12345678.0, 1, 1, __import__("datetime").date(2024, 1, 1), None)])
    row = X.expense_export(led, "amount").collect()[0]
    assert row["Amount"] == "12345678.0" and row["Tags"] == "a, b" and row["Description"] == ""


def test_files_with_different_headers_are_mapped_each_by_its_own(spark):
    path = tempfile.mkdtemp(prefix="mixed drops+")
    with open(f"{path}/one.csv", "w") as f:
        f.write("amount,category,payment_method,date\n10,food,cash,2024-05-01\n")
    with open(f"{path}/two 2.csv", "w") as f:
        f.write("category,amount,date,payment_method,tag\nfood,20,2024-05-02,cash,a\n")
    rows = csv_io.read_expense_csv(spark, path).collect()
    assert sorted((r.amount, r.category, r.date, r.tag) for r in rows) == [
        ("10", "food", "2024-05-01", None), ("20", "food", "2024-05-02", "a")]
    assert len({r.seq for r in rows}) == 2


def test_import_file_drops_a_surplus_field(spark):
    path = tempfile.mkdtemp(prefix="imp-")
    with open(f"{path}/may.csv", "w") as f:
        f.write("date,amount,tag,category,description,payment_method\n")
        f.write('2024-05-17,8.25,"b",food,"Soup, bread",cash,left over,more\n')
    res = M.import_expense_file(small_ledger(spark), path, uid=2)
    row = res.accepted.collect()[0]
    assert (row.eid, row.uid, row.amount, row.cid, row.pid, row.description, row.tags) == \
        (7, 2, 8.25, 1, 1, "Soup, bread", "b")
    assert res.rejects.count() == 0


def test_float_text_is_pythons(spark):
    xs = [0.0005, 1e-9, 1.25e-5, 0.001, -0.00012345, 1e7, 12345678.9, 9.5e14, 1e15, 1e16, 0.0, 42.0]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", float_text("x").alias("t")).collect()
    assert [r.t for r in rows] == [str(x) for x in xs]
