"""Invariants over the fixture tables."""

from pyspark.sql import functions as F

from ledgerloom.operators import ledger, rules, validation
from ledgerloom.sources.catalog import Catalog


def _sum(df, col="amount", cond=None):
    if cond is not None:
        df = df.filter(cond)
    return df.agg(F.coalesce(F.sum(col), F.lit(0))).collect()[0][0]


def test_ledger_totals_equal_sum_of_sources(small_catalog):
    c = small_catalog
    led = ledger.post_ledger(c)
    by = {r.source_table: r.s for r in led.groupBy("source_table").agg(F.sum("amount").alias("s")).collect()}
    assert by["ORDER_PAYMENT"] == _sum(c.order_payment)
    assert by["SHIPMENT_INSTALLMENT"] == _sum(c.shipment_installment, cond=F.col("is_paid") == 1)
    assert by["PERSON_PAYMENT"] == _sum(c.person_payment)
    assert by["ITEM_TRANSFER"] == _sum(c.item_transfer, "transport_cost", F.col("transport_cost") > 0)
    assert by["EXPENSE"] == _sum(c.expense)


def test_reconcile_is_empty_on_own_postings(small_catalog):
    led = ledger.post_ledger(small_catalog)
    assert ledger.ledger_reconcile(led, led).count() == 0


def test_post_ledger_matches_fixture_ledger(small_catalog):
    c = small_catalog
    mine = ledger.post_ledger(c)
    fixture = c.transaction_log.filter(F.col("source_table").isNotNull()).select(*ledger.LEDGER_COLS)
    assert mine.exceptAll(fixture).count() == 0 and fixture.exceptAll(mine).count() == 0


def test_repair_jobs_are_idempotent(spark, small_catalog):
    c = small_catalog
    once = rules.order_status_reconcile(c)
    repaired = c.sales_order.join(once.select("id", F.col("status").alias("new_status")), "id").select(
        *[F.col("new_status").alias("status") if n == "status" else F.col(n) for n in c.sales_order.columns])
    items_once = rules.item_status_reconcile(c)
    items = c.item.join(items_once.select("id", F.col("status").alias("new_status")), "id").select(
        *[F.col("new_status").alias("status") if n == "status" else F.col(n) for n in c.item.columns])
    c2 = Catalog.from_frames(spark, {"sales_order": repaired, "item": items, "order_payment": c.order_payment})
    twice = rules.order_status_reconcile(c2)
    assert twice.filter(F.col("status") != F.col("status_before")).count() == 0
    assert rules.item_status_reconcile(c2).filter(F.col("status") != F.col("status_before")).count() == 0


def test_validators_keep_every_input_row(small_catalog):
    c = small_catalog
    assert validation.validate_orders(c).count() == c.order_batch.count()
    assert validation.validate_transfers(c).count() == c.transfer_batch.count()
    assert validation.validate_expenses(c).count() == c.expense_batch.count()
    v = validation.validate_payments(c)
    assert v.count() == c.payment_batch.count() + c.staff_payment_batch.count()
    assert v.filter(F.col("accepted") & F.col("reason").isNotNull()).count() == 0


def test_deletes_partition_the_requests(small_catalog):
    c = small_catalog
    out = rules.apply_deletes(c.item, c.delete_batch, guard=F.col("status") == "sold")
    assert out.count() == c.delete_batch.distinct().count()
    left = rules.surviving_rows(c.item, out)
    deleted = out.filter(F.col("outcome") == "deleted").count()
    assert left.count() == c.item.count() - deleted


def test_sink_ledger_replaces_only_given_months(spark, small_catalog, tmp_path):
    led = ledger.post_ledger(small_catalog)
    path = str(tmp_path / "ledger")
    ledger.sink_ledger(led, path)
    one_month = led.filter(F.date_format("transaction_date", "yyyy-MM") == "1998-03")
    ledger.sink_ledger(one_month, path, mode="replace")  # rerun of one month
    back = ledger.read_ledger(spark, path).select(*ledger.LEDGER_COLS)
    assert back.exceptAll(led).count() == 0 and led.exceptAll(back).count() == 0
