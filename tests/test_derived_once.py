"""Jobs that read a table more than once derive it once."""

import datetime as dt
from decimal import Decimal as D

import pytest

from conftest import SMALL
from ledgerloom.operators import ledger
from ledgerloom.plans.registry import entries
from ledgerloom.sources import catalog as cat
from ledgerloom.sources.versions import KeyedTable
from ledgerloom.streaming import jobs, replay

SOURCES = [(1, "EXPENSE", 1), (2, "EXPENSE", 2), (3, "PAY", 1), (4, None, None), (5, "EXPENSE", 3), (6, "PAY", None)]


def counted(spark, rows):
    """Ledger rows, and a counter of how often one was computed."""
    seen = spark.sparkContext.accumulator(0)

    def row(r):
        seen.add(1)
        return (r[0], dt.date(2024, 1, r[0] % 28 + 1), "customer", "inflow", D("1.00"), 1, r[1], r[2], None)

    return spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(row), jobs.LEDGER_SCHEMA), seen


def test_a_micro_batch_is_computed_once(spark):
    stored, _ = counted(spark, SOURCES[:2])
    new = jobs.not_stored_yet(stored)
    rows, seen = counted(spark, SOURCES)
    assert sorted(r.id for r in new(rows).collect()) == [3, 4, 5, 6]
    assert seen.value == len(SOURCES)


def test_arrivals_are_derived_once(spark):
    rows, seen = counted(spark, SOURCES)
    arrivals = [sorted(r.id for r in a.collect()) for a in replay.arrivals_of(rows, jobs.LEDGER_SCHEMA)]
    assert arrivals == [[3, 6], [1, 4], [2, 5]] and seen.value == len(SOURCES)


def test_only_a_batch_that_repeats_keys_is_grouped(spark, tmp_path, monkeypatch):
    calls, group = [], KeyedTable._one_per_key
    monkeypatch.setattr(KeyedTable, "_one_per_key", lambda *a: calls.append(1) or group(*a))
    path, rows = str(tmp_path / "ledger"), lambda *ids: counted(spark, [(i, "PAY", i) for i in ids])
    once, seen = rows(1, 2, 3)
    ledger.sink_ledger(once, path)
    assert not calls and seen.value == 3
    ledger.sink_ledger(rows(3, 4, 4)[0], path)
    assert calls == [1]
    assert sorted(r.id for r in ledger.read_ledger(spark, path).collect()) == [1, 2, 3, 4]


@pytest.fixture
def held(monkeypatch):
    names, write = [], cat.written
    monkeypatch.setattr(cat, "written", lambda df, name: names.append(name) or write(df, name))
    return names


@pytest.mark.parametrize("key", ["ledger_reconcile", "finance_daily_entries", "sink_ledger", "sink_ledger_corrections"])
def test_order_lines_are_derived_once(spark, held, key):
    entries()[key][0](cat.load_catalog(spark, SMALL))
    assert held.count("line") == 1


def test_held_tables_have_the_same_rows(spark, small_catalog):
    held = small_catalog.holding("line", "transaction_log")
    got, want = held.ledger_dirty, small_catalog.ledger_dirty
    assert got.dtypes == want.dtypes
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert "lineitem" not in got._jdf.queryExecution().executedPlan().toString()
    given = cat.Catalog.from_frames(spark, {"line": small_catalog.line.limit(0), "expense": small_catalog.expense})
    assert given.holding("line", "expense").line.count() == 0
