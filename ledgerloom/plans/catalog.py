"""``load_catalog``: scan each of the 18 ERP tables once (row count per
table), the smoke test of the fixed-schema catalog."""

from pyspark.sql import functions as F

from ledgerloom.functions import union_all
from ledgerloom.sources.catalog import BUSINESS_TABLES


def _counts(c):
    return union_all([c[t].agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(t).alias("table_name"), "row_count")
                      for t in BUSINESS_TABLES])


ENTRIES = {
    "load_catalog": (
        _counts,
        " UNION ALL ".join(f"SELECT '{t}' AS table_name, COUNT(*) AS row_count FROM {t}" for t in BUSINESS_TABLES)),
}
