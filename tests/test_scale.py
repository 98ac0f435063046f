"""Stages keyed by order grow with the lines; several sorts of a group export join once."""

import datetime as dt

import pytest

from ledgerline.operators import changes
from ledgerline.operators import exports as X
from ledgerline.plans import catalog, catalog_changes, catalog_loads
from ledgerline.sources import batches, testdata


@pytest.fixture()
def tables(spark, tmp_path):
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    put("nation", [(0, "N0"), (1, "N1")], "n_nationkey int, n_name string")
    put("customer", [(i, f"C{i}", i % 2) for i in range(20)], "c_custkey long, c_name string, c_nationkey int")
    put("part", [(i, f"Brand#{i % 5}") for i in range(30)], "p_partkey long, p_brand string")
    put("orders", [(i, i % 20, "FOP"[i % 3], 10.5 * i, dt.datetime(1996, 1 + i % 12, 1), f"{1 + i % 5}-LOW")
                   for i in range(60)],
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, "
        "o_orderpriority string")
    put("lineitem", [(k // 4, k % 30, k % 7) for k in range(260)],  # the last 20 lines have no order
        "l_orderkey long, l_partkey long, l_suppkey long")
    return str(tmp_path)


def test_keyed_stages_grow_with_the_lines(spark, tables, monkeypatch):
    monkeypatch.setattr(testdata, "ROWS_PER_TASK", 10)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        led = testdata.ledger_from_testdata(spark, tables)
        assert testdata.key_partitions(testdata.read_table(spark, tables, "lineitem")) == 26
        assert led.expenses_tags.select("eid").distinct().count() == 60
        assert led.expenses_tags.groupBy("eid").count().rdd.getNumPartitions() == 26
        assert led.split_users.groupBy("geid").count().rdd.getNumPartitions() == 26
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_group_export_files_join_once(spark, tables, monkeypatch):
    led, calls = testdata.ledger_from_testdata(spark, tables), []
    plain = {f: [tuple(r) for r in X.group_export(led, sort_field=f).collect()] for f in (None, "tags")}
    lists = X.split_lists
    monkeypatch.setattr(X, "split_lists", lambda ledger: calls.append(1) or lists(ledger))
    rows = X.group_export_rows(led).persist()
    for f, expected in plain.items():
        assert [tuple(r) for r in X.group_export(led, sort_field=f, rows=rows).collect()] == expected
    rows.unpersist()
    del calls[:]
    out = catalog_loads.q_export_group_files(spark, tables)
    assert len(calls) == 1
    assert sorted(r["sorted_by"] for r in out.groupBy("sorted_by").count().collect()) == sorted(["group", *X.GROUP_SORT])
    for f, expected in plain.items():
        got = out.filter(out.sorted_by == (f or "group")).drop("sorted_by").collect()
        assert sorted(tuple(v or "" for v in r) for r in got) == sorted(expected)


def test_staged_mapping_is_computed_once_and_equal(spark, tables):
    plain = testdata.ledger_from_testdata(spark, tables)
    names = ("expenses_tags", "group_expenses", "split_users", "user_group", "group_expense_tags")
    staged = testdata.ledger_from_testdata(spark, tables, stage=names)
    for t, rows in plain.items():
        assert sorted(map(str, rows.collect())) == sorted(map(str, staged.table(t).collect())), t
    for t in names:
        assert all("mapped-" in f for f in staged.table(t).inputFiles()), t
    assert staged.split_users.filter("geid >= 60").isEmpty()  # the lines without an order


@pytest.mark.parametrize("query, module", [
    ("audit_planted", catalog), ("list_expenses_stored", catalog_changes), ("change_add_group_expenses", catalog_changes),
    ("import_group_splits", catalog_loads)])
def test_queries_that_read_the_ledger_often_map_it_once(spark, tables, monkeypatch, query, module):
    mapped, calls = testdata.ledger_from_testdata, []
    for m in (module, batches):
        monkeypatch.setattr(m, "ledger_from_testdata", lambda *a, **k: calls.append(k.get("stage")) or mapped(*a, **k))
    getattr(module, f"q_{query}")(spark, tables).collect()
    assert len(calls) == 1 and {"group_expenses", "split_users"} <= set(calls[0])


def test_updates_are_dealt_by_expense(spark, tables, monkeypatch):
    monkeypatch.setattr(testdata, "ROWS_PER_TASK", 10)
    led = testdata.ledger_from_testdata(spark, tables)
    batch = spark.createDataFrame([(1, 3, 3, "tags", "brand#1, fresh"), (2, 4, 4, "tags", "")],
                                  "seq long, actor_uid long, eid long, field string, value string")
    out = changes.update_expenses(led, batch).ledger
    assert out.expenses_tags.rdd.getNumPartitions() == led.key_parts == 26
    names = out.expenses_tags.join(out.tags, "tid")
    assert sorted(r.tag_name for r in names.filter("eid = 3").collect()) == ["brand#1", "fresh"]
    assert names.filter("eid = 4").isEmpty() and names.select("eid").distinct().count() == 59
