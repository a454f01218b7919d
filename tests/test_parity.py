"""Every registered query against its DuckDB oracle (the driver's check),
at the small scale factor so the suite stays quick."""

import pytest

from conftest import SMALL
from parity import compare, duck_connection

import __spark_entry__ as entry_mod
from ledgerloom.plans.registry import entries

QUERIES = {k: q for k, q in entry_mod.queries().items() if k in entries()}
ORACLE = entry_mod.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return duck_connection(SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(entries()) <= set(ORACLE)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, key):
    r = compare(spark, SMALL, key, QUERIES[key], ORACLE[key], duck)
    assert r["ok"], r


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["id", "name", "phone", "status", "outstanding_balance", "total_paid_lifetime"]
