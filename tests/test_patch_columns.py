"""Patches of every table: the reference's whitelists, whole and no wider."""

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from ledgerloom.operators import rules
from ledgerloom.plans import rules as plans
from ledgerloom.sources.catalog import Catalog

DAY = dt.date(2024, 5, 1)


def test_whitelists_are_the_references(spark, frames):
    person = frames("person", [(1, "p", "sales", D(1), "01", "permanent", "mixed", DAY, None, "active")])
    patch = spark.createDataFrame([(1, {"phone": "02", "contract_end": "2024-06-01", "status": "inactive", "id": "9"})],
                                  "patch_id bigint, patch map<string,string>")
    row, = rules.apply_patch(person, patch, plans.PERSON_PATCH_ALLOWED).collect()
    assert (row.id, row.phone, row.contract_end, row.status) == (1, "02", dt.date(2024, 6, 1), "inactive")
    order = frames("sales_order", [(1, 1, None, 4, D(100), "backorder", 1)])
    patch = spark.createDataFrame([(1, {"location_id": "7", "backorder_description": "b", "fulfillment_trigger": "t"})],
                                  "patch_id bigint, patch map<string,string>")
    row, = rules.apply_patch(order, patch, plans.ORDER_PATCH_ALLOWED).collect()
    assert (row.location_id, row.backorder_description, row.fulfillment_trigger) == (4, "b", "t")


def test_patch_batches_set_every_column_and_a_forbidden_one(small_catalog):
    for batch, allowed in (("item", plans.ITEM_PATCH_ALLOWED), ("person", plans.PERSON_PATCH_ALLOWED),
                           ("order", plans.ORDER_PATCH_ALLOWED), ("shipment", plans.SHIPMENT_PATCH_ALLOWED),
                           ("supplier", plans.SUPPLIER_PATCH_ALLOWED), ("customer", plans.CUSTOMER_PATCH_ALLOWED),
                           ("expense", plans.EXPENSE_PATCH_ALLOWED), ("inventory", plans.INVENTORY_PATCH_ALLOWED)):
        df = small_catalog[f"{batch}_patch_all"]
        used = df.groupBy("seq").agg(*[F.max(f"has_{c}").alias(c) for c in allowed]).collect()
        assert len(used) == 2 and all(r[c] for r in used for c in allowed), batch
        assert [c for c in df.columns[2:] if not c.startswith("has_") and c not in allowed], batch


def test_stock_value_follows_a_patch_and_flags_are_truthy(spark, frames):
    stock = frames("inventory", [(i, "n", "c", 1, 3, D("2.00"), D("1.00")) for i in (1, 2, 3)])
    c = Catalog.from_frames(spark, {"inventory": stock, "inventory_patch_all": spark.createDataFrame(
        [(1, 1, True, 5, False, None, D(9)), (2, 1, False, None, True, "m", D(9)), (3, 1, False, None, False, None, D(9))],
        "inventory_id bigint, seq int, has_quantity boolean, quantity int, has_name boolean, name string, "
        "total_value decimal(18,2)").select("*", *[F.lit(False).alias(f"has_{x}") for x in ("category", "location_id", "unit_price")],
                                            *[F.lit(None).cast("string").alias(x) for x in ("category", "location_id", "unit_price")])})
    got = {r.id: r.total_value for r in plans.ENTRIES["apply_patch_inventory"][0](c).collect()}
    assert got == {1: 10.0, 2: 6.0, 3: 1.0}  # a patch of nothing allowed leaves the stored value
    raw = spark.createDataFrame([(x,) for x in ("true", "1", '"0"', '"false"', "2", "false", "0", "-0.0", '""', None)], "v string")
    assert [r[0] for r in raw.select(rules.truthy(F.col("v"))).collect()] == [1] * 5 + [0] * 5
