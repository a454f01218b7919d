import os
import sys

import pytest
from pyspark.sql import types as T

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = os.environ.get("LEDGERLOOM_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from ledgerloom.session import local_session

    s = local_session(cores="*", shuffle_partitions=8, app="ledgerloom-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small_catalog(spark):
    from ledgerloom.sources.catalog import load_catalog

    return load_catalog(spark, SMALL)


@pytest.fixture(scope="session")
def frames(spark, small_catalog):
    """Build literal ERP tables with the same schemas as the derived views."""
    def make(name, rows):
        # trailing columns that a test doesn't name are NULL
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in small_catalog[name].schema])
        return spark.createDataFrame([(*r, *[None] * (len(schema) - len(r))) for r in rows], schema)
    return make
