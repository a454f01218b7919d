"""Feed fixture tables to the streaming jobs as arriving files and run each
arrival with ``availableNow`` on one checkpoint (FIXTURES.md section 5).

Rows arrive by ``id % ARRIVALS``, so every arrival holds dates of the whole
range and late postings are the rule. Everything is written under the
session's ``spark.checkpoint.dir`` (the shared folder on a cluster), one
fresh folder per run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.graph import written
from ledgerloom.session import scratch_path
from ledgerloom.streaming import jobs
from ledgerloom.streaming.sinks import CompactingSink, batch_folders

ARRIVALS = 3
DAILY = T.StructType([T.StructField("date", T.DateType()), T.StructField("i", T.DecimalType(28, 2)),
                      T.StructField("o", T.DecimalType(28, 2))])


def _typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def arrivals_of(df: DataFrame, schema: T.StructType) -> list[DataFrame]:
    """The rows of each arrival; the table is derived once for all of them."""
    typed = written(_typed(df, schema), "arriving")
    at = F.coalesce(F.pmod("id", F.lit(ARRIVALS)), F.lit(0))
    return [typed.filter(at == k) for k in range(ARRIVALS)]


def _replay(spark, arrivals: list[DataFrame], base: str, schema: T.StructType,
            run: Callable[[DataFrame, int], None]) -> None:
    for k, part in enumerate(arrivals):
        part.write.mode("append").parquet(f"{base}/in")
        run(jobs.read_stream(spark, f"{base}/in", schema), k)


def stream_ledger_daily(c, ledger: DataFrame | None = None, arrivals: list[DataFrame] | None = None, every: int = 8
                        ) -> DataFrame:
    """Days of an arriving ledger; ``arrivals`` fixes the files by hand."""
    spark, base = c.spark, scratch_path(c.spark, "stream-daily")
    led = c.transaction_log if ledger is None else ledger
    arrivals = [_typed(a, jobs.LEDGER_SCHEMA) for a in arrivals] if arrivals else arrivals_of(led, jobs.LEDGER_SCHEMA)
    sink = CompactingSink(spark, f"{base}/totals", ["date"], DAILY, every)
    _replay(spark, arrivals, base, jobs.LEDGER_SCHEMA, lambda stream, _: jobs.run_available(
        jobs.ledger_daily_totals(stream), f"{base}/ck", sink=sink))
    return jobs.daily_flows_of(sink.read())


def stream_ledger_dedup(c, ledger: DataFrame | None = None, arrivals: list[DataFrame] | None = None,
                        stored: DataFrame | None = None) -> DataFrame:
    """Postings that are the first of their source, in the stream and, if
    given, in the ``stored`` ledger."""
    spark, base = c.spark, scratch_path(c.spark, "stream-dedup")
    led = c.ledger_dirty if ledger is None else ledger
    arrivals = [_typed(a, jobs.LEDGER_SCHEMA) for a in arrivals] if arrivals else arrivals_of(led, jobs.LEDGER_SCHEMA)
    sink = batch_folders(f"{base}/out", jobs.not_stored_yet(stored)) if stored is not None else None
    _replay(spark, arrivals, base, jobs.LEDGER_SCHEMA, lambda stream, _: jobs.run_available(
        jobs.ledger_dedup_stream(stream), f"{base}/ck", sink=sink, path=f"{base}/out", mode="append"))
    return spark.read.schema(jobs.LEDGER_SCHEMA).parquet(f"{base}/out").select(
        "source_table", "source_id", F.when(F.col("source_table").isNull(), F.col("id")).cast("bigint").alias("manual_id"))


def stream_order_fulfilment(c, payments: DataFrame | None = None,
                            orders_at: Callable[[int], DataFrame] | None = None,
                            arrivals: list[DataFrame] | None = None) -> DataFrame:
    """Payments arrive in files, and before each the orders changed since the
    last (``orders_at(arrival)`` is the table by then; default the orders
    table, unchanged); the orders that are active and paid are emitted, each
    once."""
    spark, base = c.spark, scratch_path(c.spark, "stream-fulfil")
    p = c.order_payment if payments is None else payments
    cols = [F.col("id").alias("order_id"), "status", F.col("agreed_price").cast("decimal(18,2)").alias("agreed_price")]

    def run(paid: DataFrame, k: int) -> None:
        if orders_at is None:
            changed = c.sales_order.select(*cols) if k == 0 else None
        else:
            changed = orders_at(k).select(*cols)
            changed = changed.exceptAll(orders_at(k - 1).select(*cols)) if k else changed
        if changed is not None:
            changed.withColumn("seq", F.lit(k).cast("bigint")).write.mode("append").parquet(f"{base}/orders")
        orders = jobs.read_stream(spark, f"{base}/orders", jobs.ORDER_SCHEMA)
        jobs.run_available(jobs.order_states(jobs.order_events(paid, orders)), f"{base}/ck-states",
                           sink=batch_folders(f"{base}/due", jobs.due))
        jobs.run_available(jobs.fulfilments(jobs.read_stream(spark, f"{base}/due", jobs.EMITTED_SCHEMA)),
                           f"{base}/ck-emitted", path=f"{base}/emitted")

    arrivals = [_typed(a, jobs.PAYMENT_SCHEMA) for a in arrivals] if arrivals else arrivals_of(p, jobs.PAYMENT_SCHEMA)
    _replay(spark, arrivals, base, jobs.PAYMENT_SCHEMA, run)
    return spark.read.schema(jobs.EMITTED_SCHEMA).parquet(f"{base}/emitted").select(
        "order_id", F.col("agreed_price").cast("double").alias("agreed_price"))
