"""The ledger as batch jobs: posting rules, manual rows,
reversals, expense sync, reconciliation and the partitioned sink.

Ledger ids come from the source key (``source_id * 8 + rule``), never from
a global row number, so a re-run produces the same ids on any cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom import fixed as fx
from ledgerloom.functions import missing, union_all
from ledgerloom.functions.skew import hot_split_left_join
from ledgerloom.sources.catalog import Catalog
from ledgerloom.sources.schemas import ERP_SCHEMAS
from ledgerloom.sources.versions import KeyedTable

LEDGER_COLS = ("id", "transaction_date", "type", "direction", "amount", "location_id", "source_table",
               "source_id", "notes")

def _row(id_, date, type_, direction, amount, loc, table, src, notes) -> list:
    return [id_.alias("id"), date.alias("transaction_date"), F.lit(type_).alias("type"),
            F.lit(direction).alias("direction"), amount.cast("decimal(18,2)").alias("amount"),
            loc.cast("bigint").alias("location_id"), F.lit(table).cast("string").alias("source_table"),
            src.cast("bigint").alias("source_id"), notes.cast("string").alias("notes")]


def shipment_location(c: Catalog) -> DataFrame:
    """shipment_id -> a deterministic location of one of its items
    (``min``; the reference's ``LIMIT 1`` has no order, Q28)."""
    return (c.item.filter(F.col("shipment_id").isNotNull())
            .groupBy(F.col("shipment_id").alias("loc_shipment_id")).agg(F.min("location_id").alias("loc")))


def post_ledger(c: Catalog, installments: DataFrame | None = None, manual: DataFrame | None = None) -> DataFrame:
    """Derive the ledger from its sources: customer inflow per order payment
    (the order's location, payment id as source: Q7 fixed), supplier outflow
    per paid instalment (Q8 fixed), payroll per staff payment, transport per
    transfer with cost > 0 (destination), expense per expense; plus manual
    rows if given. One ``unionByName`` of six narrow selects."""
    n = F.lit(None)
    op_ = c.order_payment
    o = c.sales_order.select(F.col("id").alias("o_id"), F.col("location_id").alias("o_loc"))
    cust = op_.join(o, op_.order_id == o.o_id).select(*_row(
        F.col("id") * 8, F.col("payment_date"), "customer", "inflow", F.col("amount"), F.col("o_loc"),
        fx.ORDER_PAYMENT, F.col("id"), n))
    si = (c.shipment_installment if installments is None else installments).filter(F.col("is_paid") == 1)
    sl = shipment_location(c)
    supp = hot_split_left_join(si, sl, "shipment_id", "loc_shipment_id").select(*_row(
        F.col("id") * 8 + 1, F.col("paid_date"), "supplier", "outflow", F.col("amount"), F.col("loc"),
        fx.SHIPMENT_INSTALLMENT, F.col("id"),
        F.concat(F.lit(fx.SHIPMENT_PAYMENT_NOTE), F.col("shipment_id").cast("string"))))
    pay = c.person_payment.select(*_row(
        F.col("id") * 8 + 2, F.col("payment_date"), "payroll", "outflow", F.col("amount"), n,
        fx.PERSON_PAYMENT, F.col("id"), F.col("notes")))
    trn = c.item_transfer.filter(F.col("transport_cost") > 0).select(*_row(
        F.col("id") * 8 + 3, F.col("transfer_date"), "transport", "outflow", F.col("transport_cost"),
        F.col("to_location_id"), fx.ITEM_TRANSFER, F.col("id"), F.col("notes")))
    exp = c.expense.select(*_row(
        F.col("id") * 8 + 4, F.col("expense_date"), "expense", "outflow", F.col("amount"), F.col("location_id"),
        fx.EXPENSE, F.col("id"), F.col("description")))
    parts = [cust, supp, pay, trn, exp]
    if manual is not None:
        parts.append(manual.select(*LEDGER_COLS))
    return union_all(parts)


def manual_transactions(batch: DataFrame, as_of) -> DataFrame:
    """Accepted manual entries as ledger rows: amount, direction, type and
    party are required (JavaScript truthiness); notes become
    ``[party] notes``; the date defaults to ``as_of``; location 0 is none; a
    ``source_id`` is kept, without a source table."""
    ok = ~(missing("amount") | blank_or_empty("direction") | blank_or_empty("type") | blank_or_empty("party"))
    acc = batch.filter(ok)
    notes = F.concat(F.lit("["), F.col("party"), F.lit("] "), F.coalesce(F.col("notes"), F.lit("")))
    loc = F.when(F.col("location_id") == 0, F.lit(None)).otherwise(F.col("location_id"))
    return acc.select(
        (F.col("id") * 8 + 5).alias("id"), F.coalesce(F.col("transaction_date"), F.lit(as_of)).alias("transaction_date"),
        "type", "direction", F.col("amount").cast("decimal(18,2)").alias("amount"), loc.cast("bigint").alias("location_id"),
        F.lit(None).cast("string").alias("source_table"),
        (F.col("source_id") if "source_id" in batch.columns else F.lit(None)).cast("bigint").alias("source_id"),
        notes.alias("notes"))


def blank_or_empty(col: str):
    """NULL or the empty string (JavaScript falsiness of a text field)."""
    return F.col(col).isNull() | (F.col(col) == "")


def ledger_reversals(ledger: DataFrame, installments: DataFrame, expenses: DataFrame) -> DataFrame:
    """Drop ledger rows whose instalment is unpaid again (or gone) and rows
    of deleted expenses. One ledger scan, one left join with the sources
    that are still live; rows of other sources carry a key of their own id
    (negative, so it matches nothing and no NULL key is hot)."""
    live = (installments.filter(F.col("is_paid") == 1).select(F.lit(fx.SHIPMENT_INSTALLMENT).alias("l_table"),
                                                              F.col("id").alias("l_id"))
            .unionByName(expenses.select(F.lit(fx.EXPENSE).alias("l_table"), F.col("id").alias("l_id"))))
    bound = F.coalesce(F.col("source_table").isin(fx.SHIPMENT_INSTALLMENT, fx.EXPENSE), F.lit(False))
    key = F.when(bound & F.col("source_id").isNotNull(), F.col("source_id")).otherwise(-F.col("id") - 1)
    led = ledger.withColumn("_key", key).withColumn("_table", F.coalesce("source_table", F.lit("")))
    j = led.join(live, (led["_table"] == live.l_table) & (led["_key"] == live.l_id), "left")
    return j.filter(~bound | F.col("l_id").isNotNull()).select(*LEDGER_COLS)


def ledger_expense_sync(ledger: DataFrame, expenses: DataFrame) -> DataFrame:
    """Carry expense edits (amount, date, description, location) into their
    ledger rows; other rows pass through unchanged."""
    e = expenses.select(F.col("id").alias("e_id"), F.col("amount").alias("e_amount"),
                        F.col("expense_date").alias("e_date"), F.col("description").alias("e_desc"),
                        F.col("location_id").alias("e_loc"))
    j = ledger.join(e, (ledger.source_table == fx.EXPENSE) & (ledger.source_id == e.e_id), "left")
    hit = F.col("e_id").isNotNull()
    return j.select(
        "id", F.when(hit, F.col("e_date")).otherwise(F.col("transaction_date")).alias("transaction_date"),
        "type", "direction",
        F.when(hit, F.col("e_amount")).otherwise(F.col("amount")).cast("decimal(18,2)").alias("amount"),
        F.when(hit, F.col("e_loc")).otherwise(F.col("location_id")).alias("location_id"),
        "source_table", "source_id",
        F.when(hit, F.col("e_desc")).otherwise(F.col("notes")).alias("notes"))


def ledger_reconcile(expected: DataFrame, ledger: DataFrame, months: list[str] | None = None) -> DataFrame:
    """Sources without a ledger row (missing), ledger rows without a source
    (orphan), several rows for one source (duplicate, Q9) and amount
    mismatches. Both sides are one table tagged by side and make one aggregate
    per source, combined in every task before the one shuffle, so a source
    repeated a million times is a few rows there. With ``months`` (yyyy-MM)
    only postings of these months are compared, as after a merge of a batch."""
    def side(rows: DataFrame, is_ledger: bool) -> DataFrame:
        rows = rows.filter(F.col("source_table").isNotNull())
        if months is not None:
            rows = rows.filter(F.date_format("transaction_date", "yyyy-MM").isin(months))
        return rows.select("source_table", F.col("source_id").cast("bigint").alias("source_id"), F.lit(is_ledger).alias("posted"),
                           F.col("amount").cast("decimal(28,2)").alias("amount"))

    posted, due = F.col("posted"), ~F.col("posted")
    both = side(expected, False).unionByName(side(ledger, True)).groupBy("source_table", "source_id").agg(
        F.count(F.when(posted, 1)).alias("ledger_rows"), F.count(F.when(due, 1)).alias("expected_rows"),
        F.min(F.when(posted, F.col("amount"))).alias("low"), F.max(F.when(posted, F.col("amount"))).alias("high"),
        F.max(F.when(due, F.col("amount"))).alias("expected_amount"))
    issue = (F.when(F.col("ledger_rows") == 0, "missing")
             .when(F.col("expected_rows") == 0, "orphan")
             .when(F.col("ledger_rows") > 1, "duplicate")
             .when((F.col("low") != F.col("expected_amount")) | (F.col("high") != F.col("expected_amount")), "amount_mismatch"))
    return (both.select("source_table", "source_id", issue.alias("issue"), "ledger_rows",
                        F.col("expected_amount").cast("double").alias("expected_amount"),
                        F.col("high").cast("double").alias("ledger_amount"))
            .filter(F.col("issue").isNotNull()))


def ledger_table(spark: SparkSession, path: str) -> KeyedTable:
    """The stored ledger: keyed by ``id``, in partitions of ``tx_month``
    (yyyy-MM), files clustered by date. Every report filters by date, so
    whole months are pruned (``finance.ledger_range`` adds the predicate)."""
    schema = T.StructType.fromDDL(ERP_SCHEMAS["transaction_log"])
    return KeyedTable(spark, path, schema, ["id"], "tx_month", F.date_format("transaction_date", "yyyy-MM"),
                      ["transaction_date", "id"])


def sink_ledger(ledger: DataFrame | None, path: str, mode: str = "merge", deletes: DataFrame | None = None,
                order: list[str] | None = None, may_move: bool = True, spark: SparkSession | None = None) -> int:
    """Adds postings to the stored ledger and returns its new version.

    ``merge``: a row replaces the stored one of its id or joins the ledger;
    ids in ``deletes`` go (a reversed payment). A batch written twice
    changes nothing, a row whose date was corrected leaves its old month, and
    of several rows of one id the last by ``order`` holds. ``may_move=False``
    (dates are never corrected) spares the look at the ids of other months.
    ``append``: as ``merge``, but a stored row stays as it is.
    ``replace``: the months present in ``ledger`` are replaced whole, as
    when a month is posted anew from its sources.

    A failure leaves the version before it; readers of a version keep it."""
    spark = spark or (ledger if ledger is not None else deletes).sparkSession
    table = ledger_table(spark, path)
    if ledger is not None:
        extra = [c for c in order or [] if c not in LEDGER_COLS]
        ledger = ledger.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in table.schema.fields], *extra)
    if mode == "replace":
        return table.replace(ledger)
    if mode not in ("merge", "append"):
        raise ValueError(f"unknown mode {mode!r}")
    return table.merge(ledger, deletes, order, may_move, keep_stored=mode == "append")


def read_ledger(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version (default: the newest) of a ledger that ``sink_ledger``
    wrote, with the partition column ``tx_month``."""
    return ledger_table(spark, path).read(version)
