"""Keyed tables and catalog snapshots: appends, repeats, corrections, crashes,
writers at the same time, readers of an older version."""

import datetime as dt
import shutil
from decimal import Decimal as D

import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SMALL
from ledgerloom.operators import finance, ledger
from ledgerloom.sources import catalog as cat
from ledgerloom.sources import files
from ledgerloom.sources.versions import ConcurrentWrite, KeyedTable, Versions


def rows(spark, *found):
    full = [(i, dt.date.fromisoformat(d) if d else None, "customer", "inflow", D(a), 1, "ORDER_PAYMENT", i, None)
            for i, d, a in found]
    return spark.createDataFrame(full, "id bigint, transaction_date date, type string, direction string, "
                                 "amount decimal(18,2), location_id bigint, source_table string, source_id bigint, notes string")


def held(spark, path, version=None):
    return sorted(((r.id, str(r.transaction_date or ""), float(r.amount), r.tx_month)
                   for r in ledger.read_ledger(spark, path, version).collect()), key=str)


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "ledger")


def test_second_batch_of_a_month_keeps_the_first(spark, path):
    ledger.sink_ledger(rows(spark, (1, "2024-01-05", "1"), (2, "2024-01-06", "2"), (9, "2024-02-01", "9")), path)
    ledger.sink_ledger(rows(spark, (3, "2024-01-07", "3")), path)
    want = [(1, "2024-01-05", 1.0, "2024-01"), (2, "2024-01-06", 2.0, "2024-01"), (3, "2024-01-07", 3.0, "2024-01"),
            (9, "2024-02-01", 9.0, "2024-02")]
    assert held(spark, path) == want
    for _ in range(2):  # a repeated batch changes nothing
        ledger.sink_ledger(rows(spark, (3, "2024-01-07", "3")), path)
        assert held(spark, path) == want
    assert [r[0] for r in held(spark, path, 1)] == [1, 2, 9]  # an older version stays readable


def test_only_touched_months_are_written(spark, path):
    ledger.sink_ledger(rows(spark, (1, "2024-01-05", "1"), (2, "2024-02-06", "2")), path)
    before = ledger.ledger_table(spark, path).versions.manifest()["parts"]
    ledger.sink_ledger(rows(spark, (3, "2024-02-07", "3")), path)
    after = ledger.ledger_table(spark, path).versions.manifest()["parts"]
    assert before["tx_month=2024-01"] == after["tx_month=2024-01"] and before["tx_month=2024-02"] != after["tx_month=2024-02"]


def test_corrections_move_months_and_the_last_repeat_holds(spark, path):
    ledger.sink_ledger(rows(spark, (1, "2024-01-05", "1"), (2, "2024-01-06", "2"), (4, None, "4")), path)
    batch = rows(spark, (1, "2024-03-05", "10"), (4, "2024-01-01", "40"), (2, None, "20"), (5, "2024-05-01", "1")).withColumn("seq", F.lit(1))
    again = rows(spark, (5, "2024-06-01", "50")).withColumn("seq", F.lit(2))
    ledger.sink_ledger(batch.unionByName(again), path, order=["seq"])
    assert held(spark, path) == sorted([
        (1, "2024-03-05", 10.0, "2024-03"), (4, "2024-01-01", 40.0, "2024-01"), (2, "", 20.0, None),
        (5, "2024-06-01", 50.0, "2024-06")], key=str)


def test_deletes_appends_and_empty_batches(spark, path):
    ledger.sink_ledger(rows(spark, (1, "2024-01-05", "1"), (2, "2024-02-06", "2"), (3, "2024-02-07", "3")), path)
    gone = spark.createDataFrame([(2,), (77,)], "id bigint")
    version = ledger.sink_ledger(None, path, deletes=gone)
    assert [r[0] for r in held(spark, path)] == [1, 3]
    assert ledger.sink_ledger(None, path, deletes=gone) == version  # nothing left to delete
    assert ledger.sink_ledger(rows(spark), path) == version
    ledger.sink_ledger(rows(spark, (1, "2024-01-05", "99"), (6, "2024-01-05", "6")), path, mode="append")
    assert [(r[0], r[2]) for r in held(spark, path)] == [(1, 1.0), (3, 3.0), (6, 6.0)]
    ledger.sink_ledger(None, path, deletes=spark.createDataFrame([(3,)], "id bigint"))
    assert "tx_month=2024-02" not in ledger.ledger_table(spark, path).versions.manifest()["parts"]
    with pytest.raises(ValueError):
        ledger.sink_ledger(rows(spark), path, mode="other")


def test_a_crash_before_the_switch_leaves_the_old_ledger(spark, path, monkeypatch):
    ledger.sink_ledger(rows(spark, (1, "2024-01-05", "1")), path)
    before = held(spark, path)

    def fail(self, content, base):
        raise RuntimeError("lost the driver")

    monkeypatch.setattr(Versions, "commit", fail)
    with pytest.raises(RuntimeError):
        ledger.sink_ledger(rows(spark, (2, "2024-01-06", "2")), path)
    monkeypatch.undo()
    assert held(spark, path) == before
    assert len(files.names(spark, f"{path}/data")) == 2
    ledger.ledger_table(spark, path).vacuum()
    assert len(files.names(spark, f"{path}/data")) == 1 and held(spark, path) == before
    ledger.sink_ledger(rows(spark, (2, "2024-01-06", "2")), path)
    assert [r[0] for r in held(spark, path)] == [1, 2]


def test_a_writer_that_loses_starts_again_from_the_new_version(spark, path, monkeypatch):
    ledger.sink_ledger(rows(spark, (1, "2024-01-05", "1")), path)
    commit, other = Versions.commit, rows(spark, (2, "2024-01-06", "2"))
    state = {"first": True}

    def racing(self, content, base):
        if state["first"]:
            state["first"] = False
            ledger.sink_ledger(other, path)  # another writer is faster
        return commit(self, content, base)

    monkeypatch.setattr(Versions, "commit", racing)
    ledger.sink_ledger(rows(spark, (3, "2024-01-07", "3")), path)
    assert [r[0] for r in held(spark, path)] == [1, 2, 3]
    with pytest.raises(ConcurrentWrite):
        commit(Versions(spark, path), {"parts": {}}, 0)


def test_hot_key_repeats_in_a_batch(spark, path):
    batch = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("id"), F.lit(dt.date(2024, 1, 1)).alias("transaction_date"),
        F.lit("customer").alias("type"), F.lit("inflow").alias("direction"), F.col("id").cast("decimal(18,2)").alias("amount"),
        F.lit(1).alias("location_id"), F.lit("X").alias("source_table"), F.col("id").alias("source_id"),
        F.lit(None).cast("string").alias("notes"))
    ledger.sink_ledger(batch, path, order=["source_id"])
    got = ledger.read_ledger(spark, path)
    assert got.count() == batch.select("id").distinct().count()
    assert got.filter("id = 7").collect()[0].source_id == 19_998


def test_reports_prune_months_of_a_merged_ledger(spark, path):
    ledger.sink_ledger(rows(spark, *[(i, f"2024-{i:02d}-01", str(i)) for i in range(1, 13)]), path)
    ledger.sink_ledger(rows(spark, (20, "2024-03-09", "20")), path)
    one = finance.ledger_range(ledger.read_ledger(spark, path), *finance.month_bounds(2024, 3))
    assert sorted(r.id for r in one.collect()) == [3, 20]
    assert all("tx_month=2024-03" in f for f in one.inputFiles()) or "PartitionFilters: [isnotnull(tx_month" in one._jdf.queryExecution().toString()


def test_composite_keys_and_null_keys(spark, tmp_path):
    schema = T.StructType.fromDDL("a string, b int, v string")
    t = KeyedTable(spark, str(tmp_path / "t"), schema, ["a", "b"], "p", F.col("a"))
    make = lambda *r: spark.createDataFrame(list(r), schema)
    t.merge(make(("x y", 1, "1"), ("x y", None, "2"), (None, 1, "3"), (None, 1, "4")))
    t.merge(make(("x y", None, "9"), ("a/b=c", 1, "5")))
    assert sorted(map(str, (tuple(r) for r in t.read().select("a", "b", "v").collect()))) == sorted(map(str, [
        ("x y", 1, "1"), ("x y", None, "9"), (None, 1, "4"), ("a/b=c", 1, "5")]))


# ---------------------------------------------------------------- catalogs

def test_snapshots_refresh_only_what_changed(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    shutil.copytree(SMALL, src)
    first = cat.materialize_catalog(spark, src, out)
    assert Versions(spark, out).latest() == 1
    assert cat.refresh_catalog(spark, src, out).snapshot() == first.snapshot()  # nothing changed
    assert Versions(spark, out).latest() == 1

    orders, year = pq.read_table(f"{src}/orders.parquet"), 1996
    raised = pc.if_else(pc.equal(pc.year(orders["o_orderdate"]), year), pc.add(orders["o_totalprice"], 1.0), orders["o_totalprice"])
    at = orders.column_names.index("o_totalprice")
    pq.write_table(orders.set_column(at, "o_totalprice", raised), f"{src}/orders.parquet")
    second = cat.refresh_catalog(spark, src, out)
    moved = {t for t in cat.BUSINESS_TABLES if first.snapshot()[t] != second.snapshot()[t]}
    assert "sales_order" in moved and "item" not in moved and "order_payment" not in moved
    table = cat.stored_table(spark, out, "sales_order")
    parts = [table.versions.manifest(c.snapshot()["sales_order"])["parts"] for c in (first, second)]
    assert {p for p in parts[1] if parts[0].get(p) != parts[1][p]} == {f"stored_part={year}"}
    fresh = cat.load_catalog(spark, src)
    assert second.sales_order.exceptAll(fresh.sales_order).count() == 0 == fresh.sales_order.exceptAll(second.sales_order).count()
    # a reader of the first snapshot still sees the old prices
    old = cat.load_catalog(spark, src, out, version=1)
    assert old.sales_order.exceptAll(second.sales_order).count() > 0
    cat.vacuum_catalog(spark, out, keep=1)
    assert cat.load_catalog(spark, src, out).sales_order.count() == fresh.sales_order.count()
    with pytest.raises(FileNotFoundError):
        cat.load_catalog(spark, src, str(tmp_path / "nowhere")).item  # noqa: B018


def test_failed_build_keeps_the_snapshot_and_pins_move_it(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    first = cat.materialize_catalog(spark, SMALL, out)
    n, replace = first.transaction_log.count(), KeyedTable.replace
    state = {"tables": 0}

    def failing(self, *a, **k):
        state["tables"] += 1
        if state["tables"] == 5:
            raise RuntimeError("lost the driver")
        return replace(self, *a, **k)

    monkeypatch.setattr(KeyedTable, "replace", failing)
    with pytest.raises(RuntimeError):
        cat.materialize_catalog(spark, SMALL, out)
    monkeypatch.undo()
    assert Versions(spark, out).latest() == 1
    assert cat.load_catalog(spark, SMALL, out).snapshot() == first.snapshot()

    version = ledger.sink_ledger(rows(spark, (-5, "1998-03-01", "1")), f"{out}/transaction_log")
    assert cat.load_catalog(spark, SMALL, out).transaction_log.count() == n
    cat.pin(spark, out, {"transaction_log": version})
    assert cat.load_catalog(spark, SMALL, out).transaction_log.count() == n + 1
