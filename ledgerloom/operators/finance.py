"""Ledger reports: daily and monthly cash, counterparties, gallery P&L,
obligations, dashboards, search and paging (SURVEY 2.2-2.5).

Every date-range report goes through :func:`ledger_range`, a plain range
predicate on ``transaction_date`` (pushed into the Parquet scan), plus a
``tx_month`` partition predicate when the ledger was written by
``sink_ledger`` so whole months are pruned.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom import fixed as fx
from ledgerloom.functions import conditional_sum, like_contains, money, union_all, zero_if_null
from ledgerloom.functions.graph import written
from ledgerloom.functions.keyfilter import key_filter, may_match
from ledgerloom.operators.people import staff_balances
from ledgerloom.operators.sales import paid_by_order
from ledgerloom.sources.catalog import Catalog

LEDGER_COLS = ("id", "transaction_date", "type", "direction", "amount", "location_id", "source_table",
               "source_id", "notes")
COST_TYPES = fx.LEDGER_TYPES


def _d(x):
    return x if isinstance(x, dt.date) else dt.date.fromisoformat(str(x))


def month_bounds(year: int, month: int) -> tuple[dt.date, dt.date]:
    """Q3: first..last day of the month (the reference's text range
    ``YYYY-MM-01``..``YYYY-MM-31`` selects exactly these dates)."""
    first = dt.date(year, month, 1)
    nxt = dt.date(year + (month == 12), month % 12 + 1, 1)
    return first, nxt - dt.timedelta(days=1)


def ledger_range(ledger: DataFrame, date_from=None, date_to=None) -> DataFrame:
    """Date-range filter on the ledger, plus the month-partition predicate when the ledger is stored."""
    if date_from is not None:
        ledger = ledger.filter(F.col("transaction_date") >= F.lit(_d(date_from)))
        if "tx_month" in ledger.columns:
            ledger = ledger.filter(F.col("tx_month") >= F.lit(_d(date_from).strftime("%Y-%m")))
    if date_to is not None:
        ledger = ledger.filter(F.col("transaction_date") <= F.lit(_d(date_to)))
        if "tx_month" in ledger.columns:
            ledger = ledger.filter(F.col("tx_month") <= F.lit(_d(date_to).strftime("%Y-%m")))
    return ledger


def _with_location_name(c: Catalog, ledger: DataFrame, how: str = "left") -> DataFrame:
    lo = c.location.select(F.col("id").alias("l_id"), F.col("name").alias("location_name"))
    return ledger.join(lo, ledger.location_id == lo.l_id, how).drop("l_id")


def _ledger_out(df: DataFrame, extra=()) -> DataFrame:
    return df.select(*[money(n).alias(n) if n == "amount" else F.col(n) for n in LEDGER_COLS], *extra)


# ---------------------------------------------------------------- parties

def _tagged(*tables: tuple[DataFrame, str, str]) -> DataFrame:
    """Several lookup tables as one: (tag, key, value) rows."""
    return union_all([t.select(F.lit(tag).alias("t_tag"), F.col("id").cast("bigint").alias("t_key"),
                               F.col(col).alias("t_value")) for t, tag, col in tables])


def _hop(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Follow ``_key`` one step; ``_tag`` tells which table it points to. Rows
    that point nowhere get a key of their own id (negative: it matches
    nothing), as NULL keys would all hash to one partition."""
    key = F.coalesce(F.when(F.col("_tag") != "", F.col("_key")), -F.col("id") - 1)
    rows = rows.withColumn("_key", key)
    return (rows.join(table, (rows["_tag"] == table.t_tag) & (rows["_key"] == table.t_key), "left")
            .withColumn("_key", F.col("t_value")).drop("t_tag", "t_key", "t_value"))


def _filtered_hop(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``_hop`` from few rows: only the table's rows that they may point to
    take part."""
    rows = written(rows, "party-rows")
    keys = key_filter(rows.filter("_tag <> '' AND _key IS NOT NULL"), ["_tag", "_key"])
    return _hop(rows, may_match(table, ["t_tag", "t_key"], keys))


def ledger_party(c: Catalog, ledger: DataFrame | None = None) -> DataFrame:
    """Counterparty of every ledger row through its polymorphic source (Q6):
    payment -> order -> customer, instalment -> shipment -> supplier, staff
    payment -> person, transfer -> transporter.

    The (possibly date-filtered) ledger is read once and makes three joins,
    whatever the kind of its rows: with the sources, with orders and
    shipments, and with the parties' names, each a union tagged by kind. Rows
    without a resolvable source keep a spread key of their own.

    With a filtered ``ledger``, the rows are written before each join and
    their keys filter the tables they look up (``keyfilter``), so a report of
    a day moves no more of the facts than the rows it is about. The whole
    ledger needs most of them, so it is joined as it is."""
    led = c.transaction_log if ledger is None else ledger
    hop = _hop if ledger is None else _filtered_hop
    source = F.when(F.col("source_id").isNotNull(), F.coalesce(
        F.when((F.col("type") == "customer") & (F.col("source_table") == fx.ORDER_PAYMENT), F.lit("C"))
        .when(F.col("type") == "supplier", F.lit("S"))
        .when((F.col("type") == "payroll") & (F.col("source_table") == fx.PERSON_PAYMENT), F.lit("P"))
        .when((F.col("type") == "transport") & (F.col("source_table") == fx.ITEM_TRANSFER), F.lit("T")), F.lit("")))
    rows = (led.withColumn("_tag", F.coalesce(source, F.lit(""))).withColumn("_key", F.col("source_id").cast("bigint")))
    rows = hop(rows, _tagged((c.order_payment, "C", "order_id"), (c.shipment_installment, "S", "shipment_id"),
                              (c.person_payment, "P", "person_id"), (c.item_transfer, "T", "transporter_id")))
    # people are reached already; their key passes through
    via = rows.withColumn("_person", F.when(F.col("_tag").isin("P", "T"), F.col("_key")))
    via = hop(via, _tagged((c.sales_order, "C", "customer_id"), (c.shipment, "S", "supplier_id")))
    via = (via.withColumn("_key", F.coalesce("_person", "_key")).drop("_person")
           .withColumn("_tag", F.when(F.col("_tag") == "T", "P").otherwise(F.col("_tag"))))
    named = hop(via, _tagged((c.erp_customer, "C", "name"), (c.erp_supplier, "S", "name"), (c.person, "P", "name")))
    # a payroll or customer row from elsewhere has no party; supplier rows always have one
    from_source = F.col("_tag") != ""
    fallback = (F.when(F.col("type") == "supplier", fx.UNKNOWN_SUPPLIER)
                .when(F.col("type") == "expense", F.when(F.coalesce(F.col("notes"), F.lit("")) != "", F.col("notes"))
                      .otherwise(F.lit(fx.EXPENSE_PARTY)))
                .when((F.col("type") == "customer") & (F.col("source_table") == fx.ORDER_PAYMENT), fx.UNKNOWN_CUSTOMER)
                .when((F.col("type") == "payroll") & (F.col("source_table") == fx.PERSON_PAYMENT), fx.UNKNOWN_PERSON)
                .when((F.col("type") == "transport") & (F.col("source_table") == fx.ITEM_TRANSFER), fx.TRANSPORT)
                .otherwise(F.lit("")))
    return named.withColumn("party", F.coalesce(F.when(from_source, F.col("_key")), fallback)).drop("_tag", "_key")


# ---------------------------------------------------------------- daily / monthly

def finance_daily(c: Catalog, date_from, date_to) -> DataFrame:
    """Range totals in one pass of conditional sums (Q4)."""
    led = ledger_range(c.transaction_log, date_from, date_to)
    inflow = F.col("direction") == "inflow"
    t_in = conditional_sum(F.col("amount"), inflow)
    t_out = conditional_sum(F.col("amount"), ~inflow | F.col("direction").isNull())
    sales = conditional_sum(F.col("amount"), inflow & (F.col("type") == "customer"))
    exp = conditional_sum(F.col("amount"), (~inflow | F.col("direction").isNull()) & (F.col("type") == "expense"))
    agg = led.agg(zero_if_null(t_in).alias("i"), zero_if_null(t_out).alias("o"),
                  zero_if_null(sales).alias("s"), zero_if_null(exp).alias("e"))
    return agg.select(F.lit(_d(date_from)).alias("date_from"), F.lit(_d(date_to)).alias("date_to"),
                      money("i").alias("total_in"), money("o").alias("total_out"), money("s").alias("total_sales"),
                      money("e").alias("daily_expenses"), money(F.col("s") - F.col("e")).alias("net_profit"),
                      money(F.col("i") - F.col("o")).alias("net"))


def finance_daily_entries(c: Catalog, date_from, date_to) -> DataFrame:
    """Ledger lines of the range with party and location name."""
    led = ledger_range(c.transaction_log, date_from, date_to)
    df = _with_location_name(c, ledger_party(c, led))
    return (df.select("id", "direction", "type", "party", money("amount").alias("amount"), "source_id",
                      F.col("location_name").alias("location"))
            .orderBy("id"))


def finance_monthly_totals(c: Catalog, year: int, month: int) -> DataFrame:
    """Month in, out (any direction but inflow, Q26) and net."""
    led = ledger_range(c.transaction_log, *month_bounds(year, month))
    inflow = F.coalesce(F.col("direction") == "inflow", F.lit(False))
    agg = led.agg(zero_if_null(conditional_sum(F.col("amount"), inflow)).alias("i"),
                  zero_if_null(conditional_sum(F.col("amount"), ~inflow)).alias("o"))
    return agg.select(F.lit(year).alias("year"), F.lit(month).alias("month"), money("i").alias("total_in"),
                      money("o").alias("total_out"), money(F.col("i") - F.col("o")).alias("net"))


def finance_monthly_revenue_by_location(c: Catalog, year: int, month: int) -> DataFrame:
    """Inflow per location; rows without a location vanish (inner join, Q5)."""
    led = ledger_range(c.transaction_log, *month_bounds(year, month)).filter(F.col("direction") == "inflow")
    agg = led.groupBy("location_id").agg(F.sum("amount").alias("amount"))
    df = _with_location_name(c, agg, "inner")
    return df.select("location_id", F.col("location_name").alias("location"), money("amount").alias("amount"))


def finance_monthly_costs_by_type(c: Catalog, year: int, month: int) -> DataFrame:
    """Outflow per ledger type in the month."""
    led = ledger_range(c.transaction_log, *month_bounds(year, month)).filter(F.col("direction") == "outflow")
    return led.groupBy("type").agg(money(F.sum("amount")).alias("amount"))


def finance_monthly_daily(c: Catalog, year: int, month: int) -> DataFrame:
    """In, out and net per day of the month."""
    led = ledger_range(c.transaction_log, *month_bounds(year, month))
    return daily_flows(led).orderBy("date")


def daily_flows(led: DataFrame) -> DataFrame:
    """In, out and net per day of the given ledger rows."""
    i = zero_if_null(conditional_sum(F.col("amount"), F.col("direction") == "inflow"))
    o = zero_if_null(conditional_sum(F.col("amount"), F.col("direction") == "outflow"))
    agg = led.groupBy(F.col("transaction_date").alias("date")).agg(i.alias("i"), o.alias("o"))
    return agg.select("date", money("i").alias("in"), money("o").alias("out"), money(F.col("i") - F.col("o")).alias("net"))


# ---------------------------------------------------------------- gallery, obligations, dashboard

def gallery_pnl(c: Catalog, date_from, date_to, location_id: int | None = None) -> DataFrame:
    """Per gallery and period: revenue, outflow per type (fixed pivot
    values), total cost, net and stock value at purchase price (Q13)."""
    lo = c.location.filter(F.col("type") == "gallery")
    if location_id is not None:
        lo = lo.filter(F.col("id") == location_id)
    led = ledger_range(c.transaction_log, date_from, date_to)
    if location_id is not None:
        led = led.filter(F.col("location_id") == location_id)
    out = F.col("direction") == "outflow"
    aggs = [conditional_sum(F.col("amount"), F.col("direction") == "inflow").alias("rev")]
    aggs += [conditional_sum(F.col("amount"), out & (F.col("type") == t)).alias(f"cost_{t}") for t in COST_TYPES]
    aggs.append(conditional_sum(F.col("amount"), out).alias("cost_total"))
    flows = led.groupBy(F.col("location_id").alias("f_loc")).agg(*aggs)
    it = c.item.filter(F.col("status") != "sold")
    if location_id is not None:
        it = it.filter(F.col("location_id") == location_id)
    stock = it.groupBy(F.col("location_id").alias("s_loc")).agg(F.sum("purchase_value").alias("stock"))
    df = lo.join(flows, lo.id == flows.f_loc, "left").join(stock, lo.id == stock.s_loc, "left")
    rev, tot = zero_if_null("rev"), zero_if_null("cost_total")
    return df.select(F.col("id").alias("location_id"), F.col("name").alias("location_name"),
                     F.lit(_d(date_from)).alias("date_from"), F.lit(_d(date_to)).alias("date_to"),
                     money(rev).alias("revenue"),
                     *[money(zero_if_null(f"cost_{t}")).alias(f"cost_{t}") for t in COST_TYPES],
                     money(tot).alias("costs_total"), money(rev - tot).alias("net"),
                     money(zero_if_null("stock")).alias("stock_value"))


def obligations_totals(c: Catalog, as_of=None) -> DataFrame:
    """Three totals in one row, each a global aggregate evaluated once as a
    scalar subquery."""
    si = c.shipment_installment.filter(F.col("is_paid") == 0)
    sh = c.shipment.select(F.col("id").alias("sh_id"), "supplier_id")
    su = c.erp_supplier.select(F.col("id").alias("s_id"))
    sup = (si.join(sh, F.col("shipment_id") == F.col("sh_id")).join(su, F.col("supplier_id") == F.col("s_id"))
           .agg(zero_if_null(F.sum("amount")).alias("s")))
    staff = staff_balances(c).filter(F.col("outstanding") > 0).agg(zero_if_null(F.sum("outstanding")).alias("p"))
    o = c.sales_order.filter(F.col("status") != "cancelled")
    cu = c.erp_customer.select(F.col("id").alias("c_id"))
    p = paid_by_order(c)
    cust = (o.join(cu, o.customer_id == cu.c_id).join(p, o.id == p.order_id, "left")
            .withColumn("out", F.col("agreed_price") - zero_if_null("total_paid")).filter(F.col("out") > 0)
            .agg(zero_if_null(F.sum("out")).alias("k")))
    return c.spark.range(1).select(
        money(sup.scalar()).alias("total_owed_to_suppliers"), money(staff.scalar()).alias("total_owed_to_staff"),
        money(cust.scalar()).alias("total_owed_by_customers"))


def dashboard_overview(c: Catalog) -> DataFrame:
    """All-time inflow, outflow and their difference."""
    led = c.transaction_log
    i = zero_if_null(conditional_sum(F.col("amount"), F.col("direction") == "inflow"))
    o = zero_if_null(conditional_sum(F.col("amount"), F.col("direction") == "outflow"))
    return led.agg(i.alias("i"), o.alias("o")).select(
        money("i").alias("total_in"), money("o").alias("total_out"), money(F.col("i") - F.col("o")).alias("net_profit"))


def dashboard_expenses(c: Catalog, date_to, date_from="1970-01-01") -> DataFrame:
    """Expense totals per category in the period, largest first."""
    e = c.expense.filter(F.col("expense_date").between(F.lit(_d(date_from)), F.lit(_d(date_to))))
    return (e.groupBy("category").agg(F.sum("amount").alias("t"))
            .select("category", money("t").alias("total")).orderBy(F.col("total").desc(), "category"))


def dashboard_month_inflow(c: Catalog, as_of, target: int = fx.DASHBOARD_TARGET) -> DataFrame:
    """Inflow since the first of ``as_of``'s month, no upper bound (Q24)."""
    start = _d(as_of).replace(day=1)
    led = ledger_range(c.transaction_log, start).filter(F.col("direction") == "inflow")
    return led.agg(money(zero_if_null(F.sum("amount"))).alias("current_month_inflow")).withColumn(
        "monthly_target", F.lit(target))


def dashboard_type_distribution(c: Catalog) -> DataFrame:
    """Ledger totals per type, inflows and outflows mixed (Q25)."""
    return (c.transaction_log.groupBy("type").agg(F.sum("amount").alias("t"))
            .select("type", money("t").alias("total")).orderBy(F.col("total").desc(), "type"))


def target_progress(c: Catalog, target: int, year: int, month: int) -> DataFrame:
    """Percent of the monthly target (rounded, capped at 100) and the amount
    left, from the month's total inflow."""
    m = finance_monthly_totals(c, year, month)
    pct = F.when(F.lit(target) == 0, F.lit(0)).otherwise(
        F.least(F.floor(F.col("total_in") / F.lit(float(target)) * 100 + 0.5), F.lit(100)))
    return m.select(F.lit(target).alias("target"), F.col("total_in").alias("achieved"),
                    pct.cast("bigint").alias("percent"), (F.lit(float(target)) - F.col("total_in")).alias("remaining"))


# ---------------------------------------------------------------- lists

def expense_list(c: Catalog, category=None, location_id=None, date_from=None, date_to=None) -> DataFrame:
    """Expenses with location name and the total of the filtered rows (a
    global aggregate attached as a scalar subquery)."""
    e = c.expense
    if category:
        e = e.filter(F.col("category") == category)
    if location_id is not None:
        e = e.filter(F.col("location_id") == location_id)
    if date_from is not None:
        e = e.filter(F.col("expense_date") >= F.lit(_d(date_from)))
    if date_to is not None:
        e = e.filter(F.col("expense_date") <= F.lit(_d(date_to)))
    total = e.agg(money(zero_if_null(F.sum("amount"))).alias("total"))
    lo = c.location.select(F.col("id").alias("l_id"), F.col("name").alias("location_name"))
    rows = e.join(lo, e.location_id == lo.l_id, "left").select(
        "id", "description", money("amount").alias("amount"), "expense_date", "category", "location_id",
        "paid_by_person_id", "location_name")
    return rows.withColumn("total", total.scalar()).orderBy(F.col("expense_date").desc(), "id")


def expense_categories(c: Catalog) -> DataFrame:
    """Distinct expense categories."""
    return c.expense.filter(F.col("category").isNotNull()).select("category").distinct()


def _search_filter(led, type_=None, direction=None, location_id=None, date_from=None, date_to=None, search=None):
    if type_:
        led = led.filter(F.col("type") == type_)
    if direction:
        led = led.filter(F.col("direction") == direction)
    if location_id is not None:
        led = led.filter(F.col("location_id") == location_id)
    led = ledger_range(led, date_from, date_to)
    if search:
        led = led.filter(like_contains("notes", search))
    return led


def transaction_search(c: Catalog, type_=None, direction=None, location_id=None, date_from=None, date_to=None,
                       search=None, page: int = 1, per_page: int = fx.PAGE_DEFAULT) -> DataFrame:
    """One page of the filtered ledger, newest first, with the total count.
    ``orderBy().offset().limit()`` plans as a top-k (each partition keeps
    offset+limit rows), so it is for small pages; deep pages should use
    :func:`transaction_page_keyset`."""
    per_page = min(int(per_page), fx.PAGE_CAP)
    led = _search_filter(c.transaction_log, type_, direction, location_id, date_from, date_to, search)
    count = led.agg(F.count(F.lit(1)).alias("total_count"))
    page_rows = (led.orderBy(F.col("transaction_date").desc(), F.col("id").desc())
                 .offset((max(int(page), 1) - 1) * per_page).limit(per_page))
    return _ledger_out(_with_location_name(c, page_rows), ["location_name"]).withColumn("total_count", count.scalar())


def transaction_page_keyset(c: Catalog, last_date, last_id: int, per_page: int = fx.PAGE_DEFAULT,
                            **filters) -> DataFrame:
    """The page after ``(last_date, last_id)`` in (date desc, id desc) order:
    a tuple predicate (pushed to the scan) + top-k, cost independent of depth."""
    led = _search_filter(c.transaction_log, **filters)
    d = F.lit(_d(last_date))
    led = led.filter((F.col("transaction_date") < d) | ((F.col("transaction_date") == d) & (F.col("id") < last_id)))
    page_rows = led.orderBy(F.col("transaction_date").desc(), F.col("id").desc()).limit(min(int(per_page), fx.PAGE_CAP))
    return _ledger_out(_with_location_name(c, page_rows), ["location_name"])


def recent_transactions(c: Catalog, n: int = fx.RECENT_ROWS) -> DataFrame:
    """Latest n ledger rows (TakeOrderedAndProject) with location name."""
    top = c.transaction_log.orderBy(F.col("transaction_date").desc(), F.col("id").desc()).limit(n)
    return _ledger_out(_with_location_name(c, top), ["location_name"])


def inflow_outflow_split(c: Catalog, n: int = fx.RECENT_ROWS) -> DataFrame:
    """The dashboard's recent rows split into the inflow and outflow lists."""
    r = recent_transactions(c, n)
    return r.filter(F.col("direction").isin("inflow", "outflow")).select(
        F.col("direction").alias("side"), "id", "transaction_date", "type", "amount", "location_name")
