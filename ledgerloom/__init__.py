"""ledgerloom: retail-operations analytics (sales, supply, stock, payroll,
ledger) as Spark DataFrame jobs.

Every operator is a pure function ``Catalog -> DataFrame`` built from
``pyspark.sql.functions``; Catalyst plans it, nothing runs on the driver.
"""

from ledgerloom.sources.catalog import Catalog, load_catalog

__all__ = ["Catalog", "load_catalog"]
