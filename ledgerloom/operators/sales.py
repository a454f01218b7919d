"""Orders, payments and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import like_contains, money, zero_if_null
from ledgerloom.sources.catalog import Catalog

ORDER_COLS = ("id", "customer_id", "item_id", "location_id", "agreed_price", "status", "is_backorder",
              "backorder_description", "expected_arrival", "order_date", "discount", "delivery_status")


def paid_by_order(c: Catalog) -> DataFrame:
    """order_id -> total_paid (pre-aggregated before any join: no fan-out)."""
    return c.order_payment.groupBy("order_id").agg(F.sum("amount").alias("total_paid"))


def _order_cols():
    return [F.col(f"o.{n}") if n not in ("agreed_price", "discount") else money(f"o.{n}").alias(n)
            for n in ORDER_COLS]


def orders_enriched(c: Catalog, with_balance: bool = True, with_phone: bool = False) -> DataFrame:
    """``o.*`` + customer and location names (inner joins, as the reference)
    and, optionally, paid and remaining balance (exact, then rounded)."""
    o = c.sales_order.alias("o")
    cu = c.erp_customer.select(F.col("id").alias("c_id"), F.col("name").alias("customer_name"),
                               F.col("phone").alias("customer_phone"))
    lo = c.location.select(F.col("id").alias("l_id"), F.col("name").alias("location_name"))
    df = o.join(cu, F.col("o.customer_id") == cu.c_id).join(lo, F.col("o.location_id") == lo.l_id)
    cols = _order_cols() + ["customer_name"] + (["customer_phone"] if with_phone else []) + ["location_name"]
    if with_balance:
        p = paid_by_order(c)
        df = df.join(p, F.col("o.id") == p.order_id, "left")
        paid = zero_if_null("total_paid")
        cols += [money(paid).alias("total_paid"), money(F.col("o.agreed_price") - paid).alias("remaining_balance")]
    return df.select(*cols)


def order_search(c: Catalog, q: str | None = None) -> DataFrame:
    """Orders with customer, location, paid and remaining; ``q`` matches the
    customer name or phone with SQLite LIKE semantics (Q2); newest first."""
    df = orders_enriched(c, with_phone=True)
    if q:
        df = df.filter(like_contains("customer_name", q) | like_contains("customer_phone", q))
    return df.orderBy(F.col("order_date").desc(), "id")


def order_detail(c: Catalog, order_id: int | None = None) -> DataFrame:
    """Orders with customer, location, paid and remaining (one order when ``order_id`` is given)."""
    df = orders_enriched(c)
    return df if order_id is None else df.filter(F.col("id") == order_id)


def customer_orders(c: Catalog, customer_id: int | None = None) -> DataFrame:
    """Orders of a customer (or of every customer) with balances, newest first."""
    df = orders_enriched(c)
    if customer_id is not None:
        df = df.filter(F.col("customer_id") == customer_id)
    return df.orderBy("customer_id", F.col("order_date").desc(), "id")


def sales_list_filter(c: Catalog, status: str = "all", query: str = "") -> DataFrame:
    """Client-side list filter: status tab, then a trimmed lower-case query
    contained in the lower-cased name, or (case-sensitively) in the phone.
    Plain ``contains``: no LIKE wildcards here."""
    df = orders_enriched(c, with_phone=True)
    if status != "all":
        df = df.filter(F.col("status") == status)
    qn = query.lower().strip()
    if qn:
        df = df.filter(F.coalesce(F.lower("customer_name").contains(qn), F.lit(False))
                       | F.coalesce(F.col("customer_phone").contains(qn), F.lit(False)))
    return df


def backorders(c: Catalog) -> DataFrame:
    """Open backorders by expected arrival (NULLs first), then order date."""
    df = orders_enriched(c, with_balance=False)
    df = df.filter((F.col("is_backorder") == 1) & (F.col("status") == "backorder"))
    return df.orderBy(F.col("expected_arrival").asc_nulls_first(), "order_date", "id")


def order_payments(c: Catalog, order_id: int | None = None) -> DataFrame:
    """Payments of an order (or of every order) by payment date."""
    p = c.order_payment
    if order_id is not None:
        p = p.filter(F.col("order_id") == order_id)
    return (p.select("id", "order_id", money("amount").alias("amount"), "payment_date", "method")
            .orderBy("order_id", "payment_date", "id"))


def customer_payments(c: Catalog, customer_id: int | None = None) -> DataFrame:
    """Payments with their order's date and customer, newest first."""
    o = c.sales_order.select(F.col("id").alias("o_id"), "customer_id", "order_date")
    if customer_id is not None:
        o = o.filter(F.col("customer_id") == customer_id)
    p = c.order_payment
    return (p.join(o, p.order_id == o.o_id)
            .select("customer_id", p.id, "order_id", money("amount").alias("amount"), "payment_date", "method",
                    "order_date")
            .orderBy("customer_id", F.col("payment_date").desc(), "id"))


def customer_list(c: Catalog) -> DataFrame:
    """Customers ordered by id."""
    return c.erp_customer.select("id", "name", "phone", "notes").orderBy("id")


def customer_remaining_total(c: Catalog) -> DataFrame:
    """Per customer: remaining balance over all its orders (no status
    exclusion) and the order count."""
    o = c.sales_order
    p = paid_by_order(c)
    lo = c.location.select(F.col("id").alias("l_id"))
    cu = c.erp_customer.select(F.col("id").alias("c_id"))
    df = (o.join(cu, o.customer_id == cu.c_id).join(lo, o.location_id == lo.l_id)
          .join(p, o.id == p.order_id, "left"))
    return df.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("order_count"),
        money(F.sum(F.col("agreed_price") - zero_if_null("total_paid"))).alias("remaining_total"))


def order_net_due(c: Catalog) -> DataFrame:
    """Agreed price minus everything paid minus discount (Q14)."""
    o = c.sales_order
    p = paid_by_order(c)
    paid = zero_if_null("total_paid")
    return (o.join(p, o.id == p.order_id, "left")
            .select("id", money("agreed_price").alias("agreed_price"), money(paid).alias("total_paid"),
                    money("discount").alias("discount"),
                    money(F.col("agreed_price") - paid - F.col("discount")).alias("net_due")))


def obligations_customers(c: Catalog) -> DataFrame:
    """Orders not cancelled with a positive balance; overdue is always 0 (Q16)."""
    o = c.sales_order.filter(F.col("status") != "cancelled")
    cu = c.erp_customer.select(F.col("id").alias("c_id"), F.col("name").alias("customer"))
    p = paid_by_order(c)
    out = (o.join(cu, o.customer_id == cu.c_id).join(p, o.id == p.order_id, "left")
           .withColumn("outstanding", F.col("agreed_price") - zero_if_null("total_paid"))
           .filter(F.col("outstanding") > 0))
    return (out.select(F.col("id").alias("order_id"), "customer", money("outstanding").alias("outstanding"),
                       F.lit(0).alias("overdue"))
            .orderBy(F.col("outstanding").desc(), "order_id"))


def deletable_customers(c: Catalog) -> DataFrame:
    """Customers without orders (the delete guard)."""
    cu = c.erp_customer
    return cu.join(c.sales_order, cu.id == c.sales_order.customer_id, "left_anti").select("id", "name")
