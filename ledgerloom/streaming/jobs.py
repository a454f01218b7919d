"""Structured Streaming forms of the reference's event handlers.

All of them are built-in stateful operators whose state holds one small row
per key and no watermark, so a posting counts however late it arrives:

* :func:`ledger_daily_totals` - daily in/out of an arriving ledger (one
  state row per calendar day), kept by a compacting sink;
* :func:`ledger_dedup_stream` - one posting per (source_table, source_id)
  for all time (fixes Q9; one state row per source); manual rows have no
  source and bypass it. :func:`not_stored_yet` drops the sources that a
  stored ledger has already, so a new stream can go on where an old one,
  whose postings were merged, has ended;
* :func:`order_states` and :func:`fulfilments` - payments and changes of orders
  as one stream of events; the state of an order is its paid sum and its last
  status and price, and a micro-batch emits the orders it touched that are due.
  A second stream passes each order once. Payments made before an order is
  active count, and so does a change of status without a payment.

A micro-batch that is run again after a failure overwrites its own folder, so
results are exactly-once. State lives in the checkpoint folder, so a lost
executor or a restarted driver resumes from the last committed batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import money
from ledgerloom.functions.graph import written
from ledgerloom.functions.keyfilter import key_filter, may_match, split_by_keys

LEDGER_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("transaction_date", T.DateType()),
    T.StructField("type", T.StringType()), T.StructField("direction", T.StringType()),
    T.StructField("amount", T.DecimalType(18, 2)), T.StructField("location_id", T.LongType()),
    T.StructField("source_table", T.StringType()), T.StructField("source_id", T.LongType()),
    T.StructField("notes", T.StringType()),
])

PAYMENT_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("order_id", T.LongType()),
    T.StructField("amount", T.DecimalType(18, 2)), T.StructField("payment_date", T.DateType()),
    T.StructField("method", T.StringType()),
])


def read_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


def ledger_daily_totals(ledger: DataFrame) -> DataFrame:
    """Per day: inflow and outflow so far (update mode)."""
    zero = F.lit(0).cast("decimal(18,2)")
    i = F.sum(F.when(F.col("direction") == "inflow", F.col("amount")).otherwise(zero))
    o = F.sum(F.when(F.col("direction") == "outflow", F.col("amount")).otherwise(zero))
    return ledger.groupBy(F.col("transaction_date").alias("date")).agg(i.alias("i"), o.alias("o"))


def daily_flows_of(totals: DataFrame) -> DataFrame:
    return totals.select("date", money("i").alias("in"), money("o").alias("out"),
                         money(F.col("i") - F.col("o")).alias("net"))


def ledger_dedup_stream(ledger: DataFrame) -> DataFrame:
    """Keep one posting per source, however far apart repeats arrive; rows
    without a source pass through."""
    sourced = ledger.filter(F.col("source_table").isNotNull()).dropDuplicates(["source_table", "source_id"])
    return sourced.unionByName(ledger.filter(F.col("source_table").isNull()))


def not_stored_yet(stored: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Drops postings whose source the stored ledger has. The ledger's
    sources become a bitmap once; rows that are surely new pass it at once,
    and only the others are looked up in the ledger itself, by their keys. The
    rows of a micro-batch are written before that, as each use of them would
    read and commit its state again."""
    keys = written(stored.filter(F.col("source_table").isNotNull()).select(
        "source_table", F.col("source_id").cast("bigint").alias("source_id")), "stored-sources")
    known = key_filter(keys, ["source_table", "source_id"])

    def new(rows: DataFrame) -> DataFrame:
        rows = written(rows, "arrived")
        manual = rows.filter(F.col("source_table").isNull())
        maybe, fresh = split_by_keys(rows.filter(F.col("source_table").isNotNull()),
                                     ["source_table", F.col("source_id").cast("bigint")], known)
        if not maybe.isEmpty():
            asked = key_filter(maybe.select("source_table", F.col("source_id").cast("bigint").alias("source_id")),
                               ["source_table", "source_id"])
            there = may_match(keys, ["source_table", "source_id"], asked).select(
                F.col("source_table").alias("_table"), F.col("source_id").alias("_id"))
            fresh = fresh.unionByName(maybe.join(there, (maybe["source_table"] == there["_table"])
                                                 & maybe["source_id"].eqNullSafe(there["_id"]), "left_anti"))
        return fresh.unionByName(manual)

    return new


# ---------------------------------------------------------------- fulfilment of orders

ORDER_SCHEMA = T.StructType([
    T.StructField("order_id", T.LongType()), T.StructField("status", T.StringType()),
    T.StructField("agreed_price", T.DecimalType(18, 2)), T.StructField("seq", T.LongType()),
])


def order_events(payments: DataFrame, orders: DataFrame) -> DataFrame:
    """Payments, and orders as they were changed (``seq`` rises), as one stream."""
    paid = payments.select("order_id", "amount", F.lit(None).cast("string").alias("status"),
                           F.lit(None).cast("decimal(18,2)").alias("agreed_price"), F.lit(None).cast("bigint").alias("seq"))
    return paid.unionByName(orders.select("order_id", F.lit(None).cast("decimal(18,2)").alias("amount"), "status",
                                          "agreed_price", "seq"))


def order_states(events: DataFrame) -> DataFrame:
    """Per order: the sum paid so far, and its last status and price (update
    mode). A hot order is summed in every task before its state."""
    return (events.groupBy("order_id")
            .agg(F.sum("amount").alias("paid"), F.max_by(F.struct("status", "agreed_price"), "seq").alias("o"))
            .select("order_id", "paid", "o.status", "o.agreed_price"))


EMITTED_SCHEMA = T.StructType([
    T.StructField("order_id", T.LongType()), T.StructField("paid", T.DecimalType(28, 2)),
    T.StructField("agreed_price", T.DecimalType(18, 2))])


def due(states: DataFrame) -> DataFrame:
    """Of the orders that a micro-batch touched, those active and paid in full."""
    return states.filter((F.col("status") == "active") & (F.col("paid") >= F.col("agreed_price"))).select(
        "order_id", F.col("paid").cast("decimal(28,2)").alias("paid"), "agreed_price")


def fulfilments(due_orders: DataFrame) -> DataFrame:
    """Each order once, when it was first due (one state row per order)."""
    return due_orders.dropDuplicates(["order_id"])


def run_available(df: DataFrame, checkpoint: str, path: str | None = None, sink: Callable | None = None,
                  timeout_s: int | None = None, mode: str = "update") -> None:
    """Process everything that has arrived, then stop (``availableNow``). The
    file sink (``path``, append) commits each batch through its metadata
    log; ``sink`` is a batch function of a query in ``mode``. It ends when
    the backlog is done; ``timeout_s`` is a caller's own limit."""
    w = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = (w.outputMode(mode).foreachBatch(sink).start() if sink is not None
         else w.outputMode("append").format("parquet").option("path", path).start())
    if timeout_s is None:
        q.awaitTermination()
    elif not q.awaitTermination(timeout_s):
        q.stop()
        raise TimeoutError(f"streaming query did not finish within {timeout_s}s")
    if q.exception() is not None:
        raise q.exception()
