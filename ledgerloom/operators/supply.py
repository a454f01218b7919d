"""Supplier and shipment reports.

Pattern used throughout: aggregate the fact per key *before* joining it to
its parent (no fan-out, partial aggregation map-side), then left-join to
the dimension and ``coalesce`` the missing sums to 0 (Q17).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom import fixed as fx
from ledgerloom.functions import date_key, money, remainder, zero_if_null
from ledgerloom.sources.catalog import Catalog


def paid_by_shipment(c: Catalog) -> DataFrame:
    """shipment_id -> total_paid over paid instalments."""
    return (c.shipment_installment.filter(F.col("is_paid") == 1)
            .groupBy("shipment_id").agg(F.sum("amount").alias("total_paid")))


def shipments_with_paid(c: Catalog) -> DataFrame:
    """Shipment rows with exact (decimal) ``paid`` and ``remaining``."""
    paid = paid_by_shipment(c)
    return (c.shipment.join(paid, c.shipment.id == paid.shipment_id, "left")
            .drop("shipment_id")
            .withColumn("paid", zero_if_null("total_paid"))
            .withColumn("remaining", F.col("declared_value") - F.col("paid"))
            .drop("total_paid"))


def supplier_totals(c: Catalog) -> DataFrame:
    """id, name, phone, status + exact ``declared`` and ``paid`` per supplier."""
    per = (shipments_with_paid(c).groupBy("supplier_id")
           .agg(F.sum("declared_value").alias("total_declared"), F.sum("paid").alias("total_paid")))
    s = c.erp_supplier
    return (s.join(per, s.id == per.supplier_id, "left").drop("supplier_id")
            .select("id", "name", "phone", "status",
                    zero_if_null("total_declared").alias("declared"),
                    zero_if_null("total_paid").alias("paid")))


def supplier_balances(c: Catalog, status: str | None = None, has_balance: bool = False) -> DataFrame:
    """Per supplier: outstanding = declared - paid, lifetime paid."""
    t = supplier_totals(c)
    if status:
        t = t.filter(F.col("status") == status)
    t = t.withColumn("outstanding", F.col("declared") - F.col("paid"))
    if has_balance:
        t = t.filter(F.col("outstanding") > 0)
    return (t.select("id", "name", "phone", "status",
                     money("outstanding").alias("outstanding_balance"),
                     money("paid").alias("total_paid_lifetime"))
            .orderBy("id"))


def supplier_summary(c: Catalog, supplier_id: int | None = None) -> DataFrame:
    """Shipment count, value, paid, outstanding and last date per supplier;
    suppliers without shipments give zeros."""
    sh = shipments_with_paid(c)
    if supplier_id is not None:
        sh = sh.filter(F.col("supplier_id") == supplier_id)
    agg = sh.groupBy("supplier_id").agg(
        F.count("id").alias("total_shipments"),
        F.sum("declared_value").alias("total_value"),
        F.sum("paid").alias("amount_paid"),
        F.max("date_received").alias("last_shipment_date"))
    s = c.erp_supplier
    if supplier_id is not None:
        s = s.filter(F.col("id") == supplier_id)
    out = s.join(agg, s.id == agg.supplier_id, "left")
    tv, ap = zero_if_null("total_value"), zero_if_null("amount_paid")
    return out.select(
        s.id.alias("supplier_id"), "name",
        F.coalesce("total_shipments", F.lit(0).cast("bigint")).alias("total_shipments"),
        money(tv).alias("total_value"), money(ap).alias("amount_paid"),
        money(tv - ap).alias("outstanding_balance"), "last_shipment_date")


def supplier_kpis(c: Catalog, as_of) -> DataFrame:
    """Percent paid (rounded, 0 when nothing declared) and days since the
    last shipment, on top of ``supplier_summary``."""
    s = supplier_summary(c)
    pct = F.when(F.col("total_value") == 0, F.lit(0)).otherwise(
        F.floor(F.col("amount_paid") / F.col("total_value") * 100 + 0.5))
    days = F.when(F.col("last_shipment_date").isNull(), F.lit(0)).otherwise(
        F.datediff(F.lit(as_of), F.col("last_shipment_date")))
    return s.select("supplier_id", pct.cast("bigint").alias("paid_pct"),
                    days.cast("int").alias("days_since_last_shipment"))


def shipment_balances(c: Catalog, supplier_id: int | None = None, payment_status: str | None = None,
                      date_from=None, date_to=None) -> DataFrame:
    """Shipments with supplier name, paid and remaining, newest first."""
    sh = c.shipment
    if supplier_id is not None:
        sh = sh.filter(F.col("supplier_id") == supplier_id)
    if payment_status:
        sh = sh.filter(F.col("payment_status") == payment_status)
    if date_from is not None:
        sh = sh.filter(F.col("date_received") >= F.lit(date_from))
    if date_to is not None:
        sh = sh.filter(F.col("date_received") <= F.lit(date_to))
    paid = paid_by_shipment(c)
    s = c.erp_supplier.select(F.col("id").alias("sid"), F.col("name").alias("supplier_name"))
    out = (sh.join(s, sh.supplier_id == s.sid)
           .join(paid, sh.id == paid.shipment_id, "left"))
    p = zero_if_null("total_paid")
    return (out.select(sh.id, "supplier_id", "supplier_name", "date_received",
                       money("declared_value").alias("declared_value"), "payment_status",
                       money(p).alias("amount_paid"),
                       money(F.col("declared_value") - p).alias("remaining_balance"))
            .orderBy(F.col("date_received").desc(), F.col("id")))


def supplier_shipments(c: Catalog, supplier_id: int | None = None) -> DataFrame:
    """Shipments of one supplier (or of every supplier) with balances."""
    return shipment_balances(c, supplier_id=supplier_id)


def shipment_detail(c: Catalog, shipment_id: int | None = None) -> DataFrame:
    """Shipment with balances and its instalments, one row per instalment
    (shipments without instalments keep one row with NULL instalment).
    The flat form scales with any number of instalments per shipment; use
    :func:`shipment_detail_nested` for the nested document of one shipment."""
    sh = shipment_balances(c, supplier_id=None)
    inst = c.shipment_installment
    if shipment_id is not None:
        sh = sh.filter(F.col("id") == shipment_id)
        inst = inst.filter(F.col("shipment_id") == shipment_id)
    inst = inst.select("shipment_id", F.col("id").alias("installment_id"),
                       money("amount").alias("installment_amount"), "due_date", "is_paid", "paid_date")
    return (sh.join(inst, sh.id == inst.shipment_id, "left").drop("shipment_id")
            .orderBy("id", "due_date", "installment_id"))


def shipment_detail_nested(c: Catalog, shipment_id: int) -> DataFrame:
    """Point lookup: one shipment with ``installments`` as an array sorted by
    due date (the API shape). Bounded by the instalments of one shipment."""
    flat = shipment_detail(c, shipment_id).filter(F.col("installment_id").isNotNull())
    inst = (flat.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(
        "due_date", "installment_id", "installment_amount", "is_paid", "paid_date"))).alias("installments")))
    head = shipment_balances(c).filter(F.col("id") == shipment_id)
    return head.join(inst, "id", "left").withColumn(
        "installments", F.coalesce("installments", F.array().cast(inst.schema["installments"].dataType)))


def shipment_payment_status(c: Catalog) -> DataFrame:
    """Derived status: settled if paid >= declared (zero declared is settled),
    partial if paid > 0, else unpaid."""
    sh = shipments_with_paid(c)
    st = (F.when(F.col("paid") >= F.col("declared_value"), "settled")
          .when(F.col("paid") > 0, "partial").otherwise("unpaid"))
    return sh.select("id", "supplier_id", F.col("payment_status").alias("stored_status"),
                     st.alias("payment_status"), money("paid").alias("amount_paid"))


def shipment_paid_pct(c: Catalog) -> DataFrame:
    """Percent paid per shipment, rounded; 0 when nothing is declared."""
    sh = shipments_with_paid(c)
    pct = F.when(F.col("declared_value") == 0, F.lit(0)).otherwise(
        F.floor(money("paid") / money("declared_value") * 100 + 0.5))
    return sh.select("id", pct.cast("bigint").alias("paid_pct"))


def shipments_total_debt(c: Catalog) -> DataFrame:
    """Sum of declared minus paid over the shipments list (which only shows
    shipments of known suppliers)."""
    sh = shipments_with_paid(c)
    known = c.erp_supplier.select(F.col("id").alias("s_id"))
    sh = sh.join(known, sh.supplier_id == known.s_id, "left_semi")
    return sh.agg(money(zero_if_null(F.sum("remaining"))).alias("total_debt"))


def suppliers_total_debt(c: Catalog) -> DataFrame:
    """Sum of the suppliers' outstanding balances."""
    t = supplier_totals(c)
    return t.agg(money(zero_if_null(F.sum(F.col("declared") - F.col("paid")))).alias("total_debt"))


def top_supplier_by_paid(c: Catalog) -> DataFrame:
    """Supplier with the largest lifetime paid (> 0); ties by id. Top-1 is a
    TakeOrderedAndProject: each partition keeps one row, no global sort."""
    t = supplier_totals(c).filter(F.col("paid") > 0)
    return (t.orderBy(F.col("paid").desc(), F.col("id"))
            .select("id", "name", money("paid").alias("total_paid_lifetime")).limit(1))


def supplier_codes(c: Catalog) -> DataFrame:
    """``#SPL-0001``: zero-padded to four digits, longer ids never cut."""
    sid = F.col("id").cast("string")
    n = fx.SUPPLIER_CODE_DIGITS
    code = F.concat(F.lit(fx.SUPPLIER_CODE_PREFIX), F.when(F.length(sid) < n, F.lpad(sid, n, "0")).otherwise(sid))
    return c.erp_supplier.select("id", code.alias("code"))


def shipment_item_status(c: Catalog, shipment_id: int | None = None) -> DataFrame:
    """Item count per shipment and status."""
    it = c.item.filter(F.col("shipment_id").isNotNull())
    if shipment_id is not None:
        it = it.filter(F.col("shipment_id") == shipment_id)
    return it.groupBy("shipment_id", "status").agg(F.count(F.lit(1)).alias("count"))


def shipment_item_value(c: Catalog, shipment_id: int | None = None) -> DataFrame:
    """Purchase and sale totals of the items of each shipment."""
    it = c.item.filter(F.col("shipment_id").isNotNull())
    if shipment_id is not None:
        it = it.filter(F.col("shipment_id") == shipment_id)
    return it.groupBy("shipment_id").agg(
        money(zero_if_null(F.sum("purchase_value"))).alias("total_purchase"),
        money(zero_if_null(F.sum("sale_price"))).alias("total_sale"))


def supplier_history(c: Catalog, supplier_id: int | None = None) -> DataFrame:
    """Shipments and paid instalments of a supplier in one timeline."""
    sh = c.shipment
    if supplier_id is not None:
        sh = sh.filter(F.col("supplier_id") == supplier_id)
    ships = sh.select("supplier_id", "id", F.col("date_received").alias("date"),
                      F.lit("shipment").alias("type"), money("declared_value").alias("amount"), "notes")
    inst = c.shipment_installment.filter(F.col("is_paid") == 1)
    pays = (inst.join(sh.select(F.col("id").alias("shipment_id"), "supplier_id"), "shipment_id")
            .select("supplier_id", "id", F.col("paid_date").alias("date"), F.lit("payment").alias("type"),
                    money("amount").alias("amount"),
                    F.concat(F.lit(fx.SHIPMENT_HISTORY_NOTE), F.col("shipment_id").cast("string")).alias("notes")))
    return ships.unionByName(pays).orderBy("supplier_id", F.col("date").desc(), "type", "id")


def obligations_suppliers(c: Catalog, as_of) -> DataFrame:
    """Unpaid instalments with supplier and an overdue flag (due < as_of)."""
    si = c.shipment_installment.filter(F.col("is_paid") == 0)
    sh = c.shipment.select(F.col("id").alias("sh_id"), "supplier_id")
    s = c.erp_supplier.select(F.col("id").alias("s_id"), F.col("name").alias("supplier"))
    out = si.join(sh, si.shipment_id == sh.sh_id).join(s, F.col("supplier_id") == F.col("s_id"))
    return (out.select(F.col("id").alias("installment_id"), "shipment_id", "supplier",
                       money("amount").alias("amount"), "due_date",
                       F.when(F.col("due_date") < F.lit(as_of), 1).otherwise(0).alias("overdue"))
            .orderBy("due_date", "installment_id"))


def shipment_remainders(c: Catalog) -> DataFrame:
    """Per shipment its receipt date as a YYYYMMDD key and what remains of
    the declared value after the payments made."""
    return shipments_with_paid(c).select("id", date_key("date_received").alias("date_key"),
                                         money(remainder(F.col("declared_value"), F.col("paid"))).alias("remainder"))


def deletable_suppliers(c: Catalog) -> DataFrame:
    """Suppliers without shipments (the delete guard)."""
    s = c.erp_supplier
    return s.join(c.shipment, s.id == c.shipment.supplier_id, "left_anti").select("id", "name")


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("F", "DataFrame", "Catalog")]
