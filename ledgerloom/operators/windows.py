"""Running computations re-aimed as windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import money
from ledgerloom.functions.running import running_sum
from ledgerloom.sources.catalog import Catalog


def _payment_running(c: Catalog) -> DataFrame:
    """Order payments with exact running paid, ordered by (date, id)."""
    p = c.order_payment.select("id", "order_id", "payment_date", "amount")
    return running_sum(p, "order_id", "payment_date", ["id"], "amount", "running_paid")


def order_payment_running_total(c: Catalog) -> DataFrame:
    """After each payment: running paid, remaining, and whether this is the
    payment that first reaches the agreed price."""
    r = _payment_running(c)
    o = c.sales_order.select(F.col("id").alias("o_id"), "agreed_price")
    df = r.join(o, r.order_id == o.o_id)
    before = F.col("running_paid") - F.col("amount")
    completes = (F.col("running_paid") >= F.col("agreed_price")) & (before < F.col("agreed_price"))
    return df.select(F.col("id").alias("payment_id"), "order_id", "payment_date", money("amount").alias("amount"),
                     money("running_paid").alias("running_paid"),
                     money(F.col("agreed_price") - F.col("running_paid")).alias("remaining"),
                     completes.cast("int").alias("completes"))


def order_fulfilment_date(c: Catalog) -> DataFrame:
    """Per active order: the first payment (by date, id) whose running total
    reaches the agreed price. ``min_by`` is a partial aggregate."""
    r = _payment_running(c)
    o = c.sales_order.filter(F.col("status") == "active").select(F.col("id").alias("o_id"), "agreed_price")
    # spread by payment id so min_by per order combines map-side instead of
    # inheriting the join's order layout (a hot order would stay in one task)
    hit = (r.join(o, r.order_id == o.o_id).filter(F.col("running_paid") >= F.col("agreed_price"))
           .repartition("id"))
    first = hit.groupBy("order_id").agg(F.min_by(F.struct("payment_date", "id", "running_paid"),
                                                  F.struct("payment_date", "id")).alias("f"))
    return first.select("order_id", F.col("f.id").alias("payment_id"), F.col("f.payment_date").alias("fulfilled_on"),
                        money("f.running_paid").alias("paid_at_fulfilment"))


def payroll_outstanding_after(c: Catalog) -> DataFrame:
    """Owed to a person after each staff payment: earnings up to that date
    minus payments so far; same-day earnings count first."""
    earn = c.work_log.select(F.col("person_id"), F.col("log_date").alias("d"), F.lit(0).alias("kind"),
                             F.col("id"), F.col("amount_earned").alias("delta"))
    pay = c.person_payment.select(F.col("person_id"), F.col("payment_date").alias("d"), F.lit(1).alias("kind"),
                                  F.col("id"), (-F.col("amount")).alias("delta"))
    ev = running_sum(earn.unionByName(pay), "person_id", "d", ["kind", "id"], "delta", "balance")
    return ev.filter(F.col("kind") == 1).select(
        F.col("id").alias("payment_id"), "person_id", F.col("d").alias("payment_date"),
        money(-F.col("delta")).alias("amount"), money("balance").alias("outstanding_after"))


def current_item_location(c: Catalog) -> DataFrame:
    """Location after the latest transfer (by date, id), else the stored one."""
    last = (c.item_transfer.groupBy("item_id")
            .agg(F.max_by(F.struct("to_location_id", "id"), F.struct("transfer_date", "id")).alias("t")))
    i = c.item
    df = i.join(last, i.id == last.item_id, "left")
    return df.select(i.id.alias("item_id"), F.coalesce("t.to_location_id", i.location_id).alias("location_id"),
                     F.col("t.id").alias("last_transfer_id"))
