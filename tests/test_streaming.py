"""Streams against their batch twins: late files, repeats far
apart, statuses that change between arrivals.

Each arriving file is processed by a new query on the same checkpoint
(``streaming.replay``), so every test also exercises the restart path."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.operators import finance, windows
from ledgerloom.streaming import jobs, replay


def ledger_rows(spark, rows):
    full = [(i, dt.date.fromisoformat(d) if d else None, "customer", "inflow", Decimal(a), 1, t, s, None)
            for i, d, a, t, s in rows]
    return spark.createDataFrame(full, jobs.LEDGER_SCHEMA)


def test_daily_stream_equals_batch_twin(spark, small_catalog):
    got = replay.stream_ledger_daily(small_catalog)
    twin = finance.daily_flows(small_catalog.transaction_log)
    assert got.count() == twin.count()
    assert got.exceptAll(twin).count() == 0 and twin.exceptAll(got).count() == 0


def test_late_files_count(spark, small_catalog):
    days = ["2024-02-10", "2024-03-10", "2024-04-10", "2024-01-10", "2024-02-10", "2150-01-01"]
    files = [ledger_rows(spark, [(-1 if i == 3 else i, d, "10.00", "ORDER_PAYMENT", i)]) for i, d in enumerate(days)]
    daily = {str(r.date): r["in"] for r in replay.stream_ledger_daily(small_catalog, arrivals=files).collect()}
    assert daily == {"2024-01-10": 10.0, "2024-02-10": 20.0, "2024-03-10": 10.0, "2024-04-10": 10.0, "2150-01-01": 10.0}
    dedup = replay.stream_ledger_dedup(small_catalog, arrivals=files)
    assert sorted(r.source_id for r in dedup.collect()) == [0, 1, 2, 3, 4, 5]


def test_repeats_months_apart_are_one_posting(spark, small_catalog):
    files = [ledger_rows(spark, [(1, "2024-01-01", "5.00", "EXPENSE", 7), (2, "2024-01-01", "1.00", None, None)]),
             ledger_rows(spark, [(3, "2024-09-01", "5.00", "EXPENSE", 7), (4, "2024-09-01", "1.00", None, None)])]
    got = replay.stream_ledger_dedup(small_catalog, arrivals=files).collect()
    assert sorted((r.source_id or 0, r.manual_id or 0) for r in got) == [(0, 2), (0, 4), (7, 0)]


def test_dedup_stream_keeps_one_row_per_source(spark, small_catalog):
    got = replay.stream_ledger_dedup(small_catalog)
    dirty = small_catalog.ledger_dirty
    sourced = got.filter(F.col("source_table").isNotNull())
    assert sourced.count() == dirty.filter(F.col("source_table").isNotNull()) \
        .select("source_table", "source_id").distinct().count()
    assert sourced.groupBy("source_table", "source_id").count().filter("count > 1").count() == 0
    assert got.filter(F.col("manual_id").isNotNull()).count() == dirty.filter(F.col("source_table").isNull()).count()


def test_fulfilment_stream_emits_each_order_once(spark, small_catalog):
    got = replay.stream_order_fulfilment(small_catalog)
    assert got.groupBy("order_id").count().filter("count > 1").count() == 0
    twin = windows.order_fulfilment_date(small_catalog).select("order_id")
    assert got.select("order_id").exceptAll(twin).count() == 0
    assert twin.exceptAll(got.select("order_id")).count() == 0


def test_payments_before_the_order_is_active_count(spark, small_catalog, frames):
    payments = spark.createDataFrame(
        [(0, 1, Decimal("50"), None, "cash"), (1, 1, Decimal("50"), None, "cash"), (2, 2, Decimal("100"), None, "cash"),
         (3, 2, Decimal("1"), None, "cash")], jobs.PAYMENT_SCHEMA)

    def orders_at(arrival):
        status = {1: "backorder" if arrival < 1 else "active", 2: "backorder" if arrival < 2 else "active"}
        return spark.createDataFrame([(i, s, Decimal("100")) for i, s in status.items()],
                                     "id bigint, status string, agreed_price decimal(18,2)")

    got = replay.stream_order_fulfilment(small_catalog, payments, orders_at).collect()
    assert sorted((r.order_id, r.agreed_price) for r in got) == [(1, 100.0), (2, 100.0)]
