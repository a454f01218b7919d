"""Skew probe: running totals when one key holds a third of the rows.

Derives a skewed copy of ``order_payment`` from the given tables (every third
payment is moved to order 1, keeping its real date), runs the running paid
total as a plain ``Window.partitionBy(order_id)`` and as
``functions.running.running_sum``, and reads per-task shuffle records and
run times from Spark's event log in a fresh scratch folder.

    python tools/skew_probe.py [sf_dir]
"""

from __future__ import annotations

import collections
import glob
import io
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _lines(path):
    if path.endswith(".zstd"):
        import zstandard
        with open(path, "rb") as fh:
            yield from io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(fh), encoding="utf-8")
    elif "events_" in os.path.basename(path):
        yield from open(path)


def task_stats(event_dir: str) -> dict:
    stage_group, tasks = {}, collections.defaultdict(list)
    for f in sorted(glob.glob(f"{event_dir}/*/*")):
        for line in _lines(f):
            e = json.loads(line)
            if e["Event"] == "SparkListenerJobStart":
                g = (e.get("Properties") or {}).get("spark.jobGroup.id")
                for sid in e["Stage IDs"]:
                    stage_group[sid] = g
            elif e["Event"] == "SparkListenerTaskEnd":
                m = e.get("Task Metrics") or {}
                tasks[e["Stage ID"]].append((m.get("Executor Run Time", 0),
                                             (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)))
    out: dict = {}
    for sid, ts in tasks.items():
        g = stage_group.get(sid)
        if g:
            o = out.setdefault(g, {"max_task_records": 0, "max_task_ms": 0})
            o["max_task_records"] = max(o["max_task_records"], max(r for _, r in ts))
            o["max_task_ms"] = max(o["max_task_ms"], max(t for t, _ in ts))
    return out


def main(sf_dir: str) -> None:
    from pyspark.sql import SparkSession, Window
    from pyspark.sql import functions as F

    from ledgerloom.functions.running import running_sum
    from ledgerloom.sources.catalog import load_catalog

    run = tempfile.mkdtemp(prefix="ledgerloom-skew-")
    os.makedirs(f"{run}/events")
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", f"file://{run}/events")
             .config("spark.sql.shuffle.partitions", "64")
             .config("spark.sql.adaptive.coalescePartitions.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    p = load_catalog(spark, sf_dir).order_payment.select("id", "order_id", "payment_date", "amount")
    hot = p.withColumn("order_id", F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("order_id")))
    hot.write.mode("overwrite").parquet(f"{run}/hot")
    h = spark.read.parquet(f"{run}/hot")
    rows, hot_rows = h.count(), h.filter("order_id = 1").count()
    w = Window.partitionBy("order_id").orderBy("payment_date", "id").rowsBetween(Window.unboundedPreceding, 0)
    wall = {}
    # worst case for day buckets: the hot order's payments all on one day
    h1 = h.withColumn("payment_date", F.when(F.col("order_id") == 1, F.lit("1998-03-02").cast("date"))
                      .otherwise(F.col("payment_date")))
    # as at scale: the per-day stats are too big to broadcast
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    for name, df in (("plain_window", h.withColumn("run", F.sum("amount").over(w))),
                     ("running_sum", running_sum(h, "order_id", "payment_date", ["id"], "amount", "run")),
                     ("running_sum_one_hot_day", running_sum(h1, "order_id", "payment_date", ["id"], "amount", "run"))):
        spark.sparkContext.setJobGroup(name, name)
        t = time.time()
        df.write.format("noop").mode("overwrite").save()
        wall[name] = round(time.time() - t, 2)
    # Joins on a hot key rely on AQE's skew join; lower its thresholds so the
    # split shows at this size (at scale the defaults, 256 MB and 5x the
    # median partition, apply).
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "256k")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    # Window job on the real operator: a third of the payments go to one
    # active order (probe-only: the order id is fetched to build the case).
    from ledgerloom.operators import rules, windows
    from ledgerloom.sources.catalog import Catalog
    cat = load_catalog(spark, sf_dir)
    active = cat.sales_order.filter(F.col("status") == "active").agg(F.min("id")).first()[0]
    hot_pay = p.withColumn("order_id", F.when(F.col("id") % 3 == 0, F.lit(active)).otherwise(F.col("order_id")))
    hot_cat = Catalog(spark, sf_dir, frames={"order_payment": hot_pay})
    spark.sparkContext.setJobGroup("order_fulfilment_date_hot_order", "order_fulfilment_date_hot_order")
    t = time.time()
    windows.order_fulfilment_date(hot_cat).write.format("noop").mode("overwrite").save()
    wall["order_fulfilment_date_hot_order"] = round(time.time() - t, 2)
    # Ledger posting with a hot shipment: a third of the instalments on one
    # shipment (instalments joined to the per-shipment location).
    from ledgerloom.operators import ledger
    si = cat.shipment_installment
    hot_sid = si.agg(F.min("shipment_id")).first()[0]
    hot_si = si.withColumn("shipment_id", F.when(F.col("id") % 3 == 0, F.lit(hot_sid))
                           .otherwise(F.col("shipment_id"))).withColumn("is_paid", F.lit(1))
    spark.sparkContext.setJobGroup("post_ledger_hot_shipment", "post_ledger_hot_shipment")
    t = time.time()
    ledger.post_ledger(cat, installments=hot_si).write.format("noop").mode("overwrite").save()
    wall["post_ledger_hot_shipment"] = round(time.time() - t, 2)
    # Rule job with a hot key: a third of the backorder claims go to one item.
    claims = cat.sales_order.select(F.col("id").alias("order_id"),
                                    F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 2000 + 1)
                                    .alias("item_id"))
    spark.sparkContext.setJobGroup("backorder_assign_hot_item", "backorder_assign_hot_item")
    t = time.time()
    rules.backorder_assign(cat, claims).write.format("noop").mode("overwrite").save()
    wall["backorder_assign_hot_item"] = round(time.time() - t, 2)
    # Join with a hot key, as at scale: both sides too big to broadcast, so a
    # shuffle join; AQE's skew join splits the hot partition (thresholds are
    # lowered so the split shows at this size).
    orders = load_catalog(spark, sf_dir).sales_order.select(F.col("id").alias("o_id"), "location_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "256k")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    for skew in ("false", "true"):
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", skew)
        name = f"join_skewjoin_{skew}"
        spark.sparkContext.setJobGroup(name, name)
        t = time.time()
        h.join(orders, h.order_id == orders.o_id, "left").write.format("noop").mode("overwrite").save()
        wall[name] = round(time.time() - t, 2)
    spark.stop()
    stats = task_stats(f"{run}/events")
    print(json.dumps({"rows": rows, "hot_rows": hot_rows, "wall_sec": wall, "tasks": stats}))


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1")
