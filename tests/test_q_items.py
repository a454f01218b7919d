"""Literal rows for Q-items and fixture gaps that
the derived views cannot produce."""

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from ledgerloom.operators import rules, stock, supply
from ledgerloom.sources.catalog import Catalog

DAY = dt.date(2024, 1, 10)
AS_OF = dt.date(2024, 1, 31)


def _loc(frames):
    return frames("location", [(1, "Gallery A", "gallery"), (2, "Store B", "warehouse")])


def test_q12_item_without_shipment(spark, frames):
    item = frames("item", [(1, None, 1, "Chair", "Chairs", None, D("10.00"), D("20.00"), "in_storage"),
                           (2, 7, 1, "Desk", "Desks", None, D("10.00"), D("20.00"), "in_storage")])
    c = Catalog.from_frames(spark, {"location": _loc(frames), "item": item, "item_image": frames("item_image", [])})
    assert [r.id for r in stock.shipment_manifest(c).collect()] == [2]
    assert sorted(r.id for r in stock.item_list(c).collect()) == [1, 2]


def test_q16_due_today_is_not_overdue(spark, frames):
    si = frames("shipment_installment", [(1, 9, D("5.00"), AS_OF, 0, None),
                                         (2, 9, D("5.00"), AS_OF - dt.timedelta(days=1), 0, None)])
    sh = frames("shipment", [(9, 1, DAY, D("10.00"), "unpaid")])
    su = frames("erp_supplier", [(1, "S", None, "active")])
    c = Catalog.from_frames(spark, {"shipment_installment": si, "shipment": sh, "erp_supplier": su})
    got = {r.installment_id: r.overdue for r in supply.obligations_suppliers(c, AS_OF).collect()}
    assert got == {1: 0, 2: 1}


def test_q17_supplier_without_shipments_reports_zeros(spark, frames):
    su = frames("erp_supplier", [(1, "S", None, "active"), (2, "T", None, "inactive")])
    sh = frames("shipment", [(9, 1, DAY, D("10.00"), "unpaid")])
    si = frames("shipment_installment", [])
    c = Catalog.from_frames(spark, {"erp_supplier": su, "shipment": sh, "shipment_installment": si})
    r = {x.supplier_id: x for x in supply.supplier_summary(c).collect()}
    assert (r[2].total_shipments, r[2].total_value, r[2].amount_paid, r[2].last_shipment_date) == (0, 0.0, 0.0, None)
    assert [x.id for x in supply.deletable_suppliers(c).collect()] == [2]


def test_declared_zero_shipment_is_settled(spark, frames):
    sh = frames("shipment", [(9, 1, DAY, D("0.00"), "unpaid")])
    si = frames("shipment_installment", [])
    c = Catalog.from_frames(spark, {"shipment": sh, "shipment_installment": si})
    assert supply.shipment_payment_status(c).collect()[0].payment_status == "settled"
    assert supply.shipment_paid_pct(c).collect()[0].paid_pct == 0


def test_q19_cancelled_backorder_can_still_be_assigned(spark, frames):
    so = frames("sales_order", [
        (1, 1, None, 1, D("10.00"), "cancelled", 1, "x", None, DAY, D("0.00"), "not_received"),
        (2, 1, None, 1, D("10.00"), "fulfilled", 1, "x", None, DAY, D("0.00"), "not_received")])
    item = frames("item", [(5, None, 1, "Bed", "Beds", None, D("1.00"), D("2.00"), "in_storage"),
                           (6, None, 1, "Bed", "Beds", None, D("1.00"), D("2.00"), "in_storage")])
    c = Catalog.from_frames(spark, {"sales_order": so, "item": item})
    a = spark.createDataFrame([(1, 5), (2, 6)], "order_id bigint, item_id bigint")
    got = {r.order_id: (r.outcome, r.item_status) for r in rules.backorder_assign(c, a).collect()}
    assert got == {1: ("assigned", "reserved"), 2: ("already_fulfilled", None)}


def test_q22_trip_by_unknown_transporter_earns_zero(spark, frames):
    t = frames("item_transfer", [(1, 5, 1, 2, DAY, D("3.00"), 77), (2, 5, 2, 1, DAY, D("0.00"), 1),
                                 (3, 5, 1, 2, DAY, D("0.00"), None)])
    person = frames("person", [(1, "P", "transporter", D("40.00"))])
    c = Catalog.from_frames(spark, {"item_transfer": t, "person": person})
    got = {r.transfer_id: r.amount_earned for r in rules.trip_work_log(c).collect()}
    assert got == {1: 0.0, 2: 40.0}


def test_q30_ids_zero_and_below_are_invalid(spark, frames):
    item = frames("item", [(1, None, 1, "Chair", "Chairs", None, D("1.00"), D("2.00"), "sold")])
    ids = spark.createDataFrame([(0,), (-3,), (1,), (2,)], "id bigint")
    got = {r.id: r.lookup for r in rules.entity_lookup(item, ids, ["name"]).collect()}
    assert got == {0: "invalid", -3: "invalid", 1: "found", 2: "not_found"}
    out = {r.id: r.outcome for r in rules.apply_deletes(item, ids, guard=F.col("status") == "sold").collect()}
    assert out == {0: "invalid", -3: "invalid", 1: "blocked", 2: "not_found"}
