"""The compacting sink over many arrivals; a stream on a stored ledger; orders
that change without a payment."""

from decimal import Decimal as D

import pytest
from pyspark.sql import types as T

from ledgerloom.operators import ledger
from ledgerloom.sources import files
from ledgerloom.sources.versions import Versions
from ledgerloom.streaming import jobs, replay
from ledgerloom.streaming.sinks import CompactingSink
from test_streaming import ledger_rows

SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.IntegerType())])


def test_fifty_arrivals(spark, tmp_path):
    """What a reader scans, and what is kept, don't grow with the batches."""
    sink, want, scanned = CompactingSink(spark, str(tmp_path / "s"), ["k"], SCHEMA, every=4), {}, []
    for n in range(50):
        rows = [(f"k{(n + i) % 7}", n * 10 + i) for i in range(3)] + [(None, n)]
        want |= dict(rows)
        sink(spark.createDataFrame(rows, SCHEMA).coalesce(1), n)
        scanned.append(len(sink._deltas(sink.versions.manifest())))
    assert {r.k: r.v for r in sink.read().collect()} == want
    assert max(scanned) < 4
    assert len(files.names(spark, f"{sink.path}/delta")) < 12 and len(files.names(spark, f"{sink.path}/snapshot")) == 2


def test_a_batch_run_again_and_a_crash_before_the_switch(spark, tmp_path, monkeypatch):
    make = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    sink = CompactingSink(spark, str(tmp_path / "s"), ["k"], SCHEMA, every=2)
    sink(make(("a", 1), ("b", 1)), 0)
    commit = Versions.commit
    monkeypatch.setattr(Versions, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost the driver")))
    with pytest.raises(RuntimeError):
        sink(make(("a", 2)), 1)
    monkeypatch.setattr(Versions, "commit", commit)
    want = {"a": 2, "b": 1}
    assert {r.k: r.v for r in sink.read().collect()} == want
    sink(make(("a", 2)), 1)  # the batch is run again
    assert {r.k: r.v for r in sink.read().collect()} == want and sink.versions.manifest()["upto"] == 1
    sink(make(("a", 2)), 1)  # and once more, after its snapshot
    assert {r.k: r.v for r in sink.read().collect()} == want
    assert CompactingSink(spark, str(tmp_path / "none"), ["k"], SCHEMA).read().collect() == []


def test_daily_stream_compacts(spark, small_catalog):
    files_ = [ledger_rows(spark, [(i, f"2024-01-{i % 3 + 1:02d}", "10.00", "X", i)]) for i in range(7)]
    daily = {str(r.date): r["in"] for r in replay.stream_ledger_daily(small_catalog, arrivals=files_, every=2).collect()}
    assert daily == {"2024-01-01": 30.0, "2024-01-02": 20.0, "2024-01-03": 20.0}


def test_a_stream_on_a_stored_ledger_repeats_nothing(spark, small_catalog, tmp_path):
    path = str(tmp_path / "ledger")
    row = lambda i, t, s: (i, "2024-01-01", "5.00", t, s)
    ledger.sink_ledger(ledger_rows(spark, [row(i, "EXPENSE", i) for i in range(0, 400, 2)] + [row(1000, "PAY", None)]), path)
    first = [ledger_rows(spark, [row(i, "EXPENSE", i) for i in range(100)] + [row(2000, None, None), row(2001, "PAY", None)]),
             ledger_rows(spark, [row(5000 + i, "EXPENSE", i) for i in range(50, 200)] + [row(7, "OTHER", 4)])]
    got = replay.stream_ledger_dedup(small_catalog, arrivals=first, stored=ledger.read_ledger(spark, path)).collect()
    posted = sorted((r.source_table or "", r.source_id or 0) for r in got)
    assert posted == sorted([("EXPENSE", i) for i in range(1, 200, 2)] + [("", 0), ("OTHER", 4)])
    # its postings merged, a new stream goes on where it ended
    done = ledger_rows(spark, [row(9000 + i, "EXPENSE", i) for i in range(1, 200, 2)])
    ledger.sink_ledger(done, path)
    again = replay.stream_ledger_dedup(small_catalog, arrivals=[ledger_rows(spark, [row(i, "EXPENSE", i) for i in range(210)])],
                                       stored=ledger.read_ledger(spark, path)).collect()
    assert sorted(r.source_id for r in again) == [201, 203, 205, 207, 209]


def test_an_order_that_changes_without_a_payment(spark, small_catalog):
    """Paid early; the status, then the price, makes it due later; once due it is not emitted again."""
    pay = lambda *r: spark.createDataFrame([(i, o, D(a), None, "cash") for i, o, a in r], jobs.PAYMENT_SCHEMA)
    arrivals = [pay((1, 1, "100"), (2, 2, "80"), (3, 3, "5")), pay((4, 9, "1")), pay((5, 9, "1")), pay((6, 1, "1"))]
    tables = [{1: ("backorder", 100), 2: ("active", 100), 3: ("active", 5)}, {1: ("active", 100), 2: ("active", 100), 3: ("active", 5)},
              {1: ("active", 100), 2: ("active", 70), 3: ("cancelled", 5)}, {1: ("active", 100), 2: ("active", 70), 3: ("active", 5)}]

    def orders_at(k):
        return spark.createDataFrame([(i, s, D(p)) for i, (s, p) in tables[k].items()],
                                     "id bigint, status string, agreed_price decimal(18,2)")

    got = replay.stream_order_fulfilment(small_catalog, orders_at=orders_at, arrivals=arrivals).collect()
    assert sorted((r.order_id, r.agreed_price) for r in got) == [(1, 100.0), (2, 70.0), (3, 5.0)]
