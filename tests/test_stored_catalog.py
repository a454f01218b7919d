"""The benchmark runs over a stored catalog (Parquet, ledger partitioned by
month, facts clustered by date). Every query must give the same rows there
as over the catalog derived on the fly."""

import os
import tempfile

import pytest

from conftest import SMALL
from ledgerloom.plans.registry import entries
from ledgerloom.sources.catalog import load_catalog, materialize_catalog

ENTRIES = entries()
KEYS = sorted(k for k in ENTRIES if not k.startswith("stream_"))


@pytest.fixture(scope="module")
def catalogs(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="ledgerloom-stored-"), "catalog")
    return load_catalog(spark, SMALL), materialize_catalog(spark, SMALL, out)


@pytest.mark.parametrize("key", KEYS)
def test_stored_catalog_gives_same_rows(catalogs, key):
    derived, stored = catalogs
    a, b = ENTRIES[key][0](derived), ENTRIES[key][0](stored)
    assert a.columns == b.columns
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_erp_schemas_match_the_derivations(catalogs):
    from ledgerloom.sources.catalog import BUSINESS_TABLES
    from ledgerloom.sources.schemas import ERP_SCHEMAS
    derived, stored = catalogs
    for t in BUSINESS_TABLES:
        ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in derived[t].schema.fields)
        assert ddl == ERP_SCHEMAS[t], t
        assert [f.name for f in stored[t].schema.fields if f.name != "tx_month"] == derived[t].columns
