"""Rules that apply a batch as if one change came after the other."""

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from ledgerloom.functions import date_key, money, remainder
from ledgerloom.operators import ledger, people, rules, validation
from ledgerloom.sources.catalog import Catalog

DAY = dt.date(2024, 5, 1)


def catalog(spark, **frames):
    return Catalog.from_frames(spark, frames)


def order_row(i, back=1, status="backorder"):
    return (i, 1, None, 1, D("100"), status, back)


def test_two_claims_of_one_order(spark, frames):
    c = catalog(spark, sales_order=frames("sales_order", [order_row(3), order_row(4), order_row(5)]),
                item=frames("item", [(i, 1, 1, "x", "c", "d", D(1), D(2), "in_storage") for i in (2, 7, 8)]))
    claims = spark.createDataFrame([(3, 2), (3, 7), (4, 2), (4, 7), (4, 8), (5, 7), (5, 8)], "order_id bigint, item_id bigint")
    got = {(r.order_id, r.item_id): r.outcome for r in rules.backorder_assign(c, claims).collect()}
    assert got == {(3, 2): "assigned", (3, 7): "already_fulfilled", (4, 2): "item_taken", (4, 7): "assigned",
                   (4, 8): "already_fulfilled", (5, 7): "item_taken", (5, 8): "assigned"}


def test_one_item_for_one_order(spark, frames):
    c = catalog(spark, erp_customer=frames("erp_customer", [(1, "c", "01", None)]), location=frames("location", [(1, "l", "gallery")]),
                item=frames("item", [(i, 1, 1, "x", "c", "d", D(1), D(2), "in_storage") for i in (1, 2)]))
    batch = spark.createDataFrame(
        [(1, None, 1, 1), (2, 1, 1, 1), (3, 1, 1, 1), (4, 1, 2, 1), (5, 1, None, 1), (6, 1, 2, 1)],
        "id bigint, customer_id bigint, item_id bigint, location_id bigint").withColumn(
        "agreed_price", F.lit(D("10.00"))).withColumn("is_backorder", F.lit(0)).withColumn(
        "backorder_description", F.lit(None).cast("string")).withColumn("initial_payment", F.lit(D("0.00")))
    got = {r.id: r.reason for r in validation.validate_orders(c, batch).collect()}
    assert got == {1: "customer_id_required", 2: None, 3: "item_unavailable", 4: None, 5: None, 6: "item_unavailable"}
    taken = rules.order_intake(c, batch, validation.validate_orders(c, batch).filter("accepted")).collect()
    assert sorted(r.id for r in taken) == [2, 4, 5]


def test_a_rejected_mark_leaves_the_earlier_one(spark, frames):
    c = catalog(spark, shipment_installment=frames("shipment_installment", [(1, 10, D(5), DAY, 0, None), (2, 10, D(5), DAY, 1, DAY)]))
    marks = spark.createDataFrame([(1, 1, 10, 1, None), (1, 2, 99, 0, None), (2, 1, 10, 0, None), (2, 2, 10, None, None)],
                                  "id bigint, seq int, shipment_id bigint, is_paid int, paid_date date")
    got = {r.id: (r.is_paid, r.paid_date) for r in rules.installment_mark_paid(c, marks, DAY).collect()}
    assert got == {1: (1, DAY), 2: (0, None)}


def test_patches_apply_in_turn(spark, frames):
    item = frames("item", [(1, 1, 1, "old", "cat", "d", D(1), D(2), "in_storage")])
    patches = spark.createDataFrame([(1, {"name": "new", "category": "a"}, 1), (1, {"category": None, "id": "9"}, 2),
                                     (1, {"sale_price": "no number"}, 3)], "patch_id bigint, patch map<string,string>, seq int")
    allowed = ["name", "category", "sale_price"]
    row, = rules.apply_patch(item, patches, allowed, seq="seq").collect()
    assert (row.id, row.name, row.category, row.sale_price) == (1, "new", None, None)
    assert rules.apply_patch(item, patches.drop("seq"), allowed).count() == 1


def test_paid_flag_is_exact(spark, frames):
    flags = ["true", "1", '"true"', '"1"', " TRUE ", "TRUE", "false", None]
    batch = spark.createDataFrame([(1, i, D(5), DAY, f, None) for i, f in enumerate(flags)],
                                  "shipment_id bigint, inst_key bigint, amount decimal(18,2), due_date date, is_paid_raw string, paid_date date")
    ship = frames("shipment", [(1, 1, DAY, D(10), "unpaid")])
    assert {r.inst_key for r in rules.installment_rows(batch, ship).filter("is_paid = 1").collect()} == {0, 1, 2}


def test_empty_replacement_deletes_all_children(spark, frames):
    held = frames("person_location", [(1, 1, 5), (2, 1, 6), (3, 2, 5)])
    new = spark.createDataFrame([(1, None)], "person_id bigint, location_id bigint")
    assert [tuple(r) for r in rules.replace_children(held, new, "person_id", "location_id").collect()] == [(2, 3, 5, "kept")]


def test_bridge_rows_are_listed_each(spark, frames):
    c = catalog(spark, person=frames("person", [(1, "p", "sales", D(1))]), person_location=frames(
        "person_location", [(1, 1, 9), (2, 1, 4), (3, 1, 9)]))
    assert people.people_locations(c, as_csv=True).collect()[0].location_ids_csv == "4,9,9"


def test_manual_rows_keep_their_source_id(spark):
    batch = spark.createDataFrame([(1, D(5), "inflow", "customer", "p", None, DAY, 1, 77)],
                                  "id bigint, amount decimal(18,2), direction string, type string, party string, notes string, "
                                  "transaction_date date, location_id bigint, source_id bigint")
    row, = ledger.manual_transactions(batch, DAY).collect()
    assert (row.source_table, row.source_id) == (None, 77)


def test_reversals_keep_rows_of_other_sources(spark, frames):
    rows = [(1, DAY, "supplier", "outflow", D(1), 1, "SHIPMENT_INSTALLMENT", 10, None),
            (2, DAY, "supplier", "outflow", D(1), 1, "SHIPMENT_INSTALLMENT", None, None),
            (3, DAY, "expense", "outflow", D(1), 1, "EXPENSE", 10, None), (4, DAY, "customer", "inflow", D(1), 1, None, 10, None)]
    inst = frames("shipment_installment", [(10, 1, D(1), DAY, 0, None)])
    exp = frames("expense", [(10, "e", D(1), DAY, "other", 1, None)])
    assert sorted(r.id for r in ledger.ledger_reversals(frames("transaction_log", rows), inst, exp).collect()) == [3, 4]


def test_money_is_exact_beyond_doubles(spark):
    big = spark.createDataFrame([(D("90071992547409931.005"), DAY, D("5.00"))], "a decimal(28,3), d date, p decimal(18,2)")
    row = big.select(F.floor(F.col("a") * 100 + F.lit(D("0.5"))).cast("string").alias("cents"), money("a").alias("m"),
                     date_key("d").alias("k"), money(remainder(F.col("p"), F.col("p") + 1)).alias("r")).first()
    assert row.cents == "9007199254740993101" and row.k == 20240501 and row.r == 0.0
