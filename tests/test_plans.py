"""Plan shape: what the physical plans must (not) contain at any scale."""

import os
import tempfile

import pytest

from conftest import SMALL

import __spark_entry__ as entry_mod
from ledgerloom.operators import finance, ledger, supply
from ledgerloom.plans.registry import entries
from ledgerloom.sources.catalog import materialize_catalog

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")
# some queries (README, "What runs when a query is built") do part of their work when they are built
BATCH_KEYS = sorted(k for k in entries() if not k.startswith(("stream_", "sink_ledger")))


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", BATCH_KEYS)
def test_no_cross_products_or_python_in_batch_plans(spark, key):
    plan = _plan(entry_mod.queries()[key](spark, SMALL))
    assert not [f for f in FORBIDDEN if f in plan], plan


@pytest.fixture(scope="module")
def stored(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="ledgerloom-plan-"), "catalog")
    return materialize_catalog(spark, SMALL, out)


def test_month_report_prunes_ledger_partitions(spark, stored):
    df = finance.finance_monthly_totals(stored, 1998, 3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "tx_month" in plan and "PartitionFilters" in _formatted(df)
    assert "transaction_date" in _formatted(df).split("PushedFilters")[1].split("\n")[0]


def test_scan_reads_only_needed_columns(spark, stored):
    df = finance.dashboard_type_distribution(stored)
    schema_line = [ln for ln in _formatted(df).splitlines() if ln.startswith("ReadSchema")][0]
    assert "notes" not in schema_line and "source_table" not in schema_line


@pytest.fixture
def no_broadcast(spark):
    """Plans as they are when no side is small."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def _count(plan: str, what: str) -> int:
    return sum(what in line for line in plan.splitlines())


def test_monthly_report_over_a_stored_catalog_makes_one_scan(spark, stored, no_broadcast):
    plan = _plan(finance.finance_monthly_totals(stored, 1998, 3))
    assert _count(plan, "FileScan") == 1 and _count(plan, "hashpartitioning") == 0


def test_ledger_party_reads_the_ledger_once(spark, stored, no_broadcast):
    plan = _plan(finance.ledger_party(stored))
    assert _count(plan, "transaction_log") == 1 and _count(plan, "SortMergeJoin") == 3


def test_reversals_read_the_ledger_once(spark, stored, no_broadcast):
    plan = _plan(ledger.ledger_reversals(stored.transaction_log, stored.shipment_installment, stored.expense))
    assert _count(plan, "transaction_log") == 1 and _count(plan, "SortMergeJoin") == 1


def test_supplier_totals_read_shipments_once(spark, stored, no_broadcast):
    plan = _plan(supply.supplier_totals(stored))
    assert _count(plan, "/shipment/") == 1 and _count(plan, "FileScan") == 3


def test_registered_queries_use_a_named_catalog(spark, stored):
    spark.conf.set("spark.ledgerloom.catalog", stored.materialized)
    try:
        plan = _plan(entry_mod.queries()["finance_monthly_totals"](spark, SMALL))
    finally:
        spark.conf.unset("spark.ledgerloom.catalog")
    assert _count(plan, "FileScan") == 1 and "PartitionFilters: [isnotnull(tx_month" in plan


def _formatted(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
