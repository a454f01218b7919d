"""``load_catalog``: the 18 ERP tables (plus fixture batches) as DataFrames.

Two backings:

* ``sf_dir`` of driver tables: each ERP table is derived lazily with
  ``spark.sql(view_text, **frames)`` (no global temp views, so several
  catalogs can live in one session).
* a snapshot of a directory written by :func:`materialize_catalog`: Parquet
  scans with explicit schemas; the ledger is partitioned by ``tx_month``, so
  date-range reports prune files. A catalog keeps to the snapshot it opened;
  :func:`refresh_catalog` writes only the partitions that changed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.graph import written
from ledgerloom.sources import files
from ledgerloom.sources.raw import RAW_SCHEMAS, read_raw
from ledgerloom.sources.schemas import ERP_SCHEMAS
from ledgerloom.sources.versions import KeyedTable, Versions
from ledgerloom.sources.views import RAW_TABLES, VIEWS, dependencies

# Tables of the ERP schema; the rest of VIEWS are helpers or
# dirty change batches.
BUSINESS_TABLES = (
    "location", "erp_supplier", "shipment", "shipment_installment", "item", "item_part",
    "item_image", "item_transfer", "erp_customer", "sales_order", "order_payment", "person",
    "person_location", "work_log", "person_payment", "expense", "transaction_log", "inventory",
)


# Partition column of the stored tables but the ledger; catalogs drop it.
STORED_PART = "stored_part"

# Fact tables and the (date, id) order their files are written in.
CLUSTER_BY = {
    "sales_order": ("order_date", "id"),
    "order_payment": ("payment_date", "id"),
    "shipment": ("date_received", "id"),
    "shipment_installment": ("due_date", "id"),
    "item_transfer": ("transfer_date", "id"),
    "work_log": ("log_date", "id"),
    "person_payment": ("payment_date", "id"),
    "expense": ("expense_date", "id"),
}


class Catalog:
    """Lazy name -> DataFrame map. Attribute and item access both work."""

    def __init__(self, spark: SparkSession, sf_dir: str, materialized: str | None = None,
                 frames: dict[str, DataFrame] | None = None, version: int | None = None):
        self.spark = spark
        self.sf_dir = sf_dir
        self.materialized = materialized
        self._pinned: dict[str, int] | None = None
        self._version = version
        self._given = dict(frames or {})
        self._frames: dict[str, DataFrame] = dict(self._given)

    @classmethod
    def from_frames(cls, spark: SparkSession, frames: dict[str, DataFrame]) -> "Catalog":
        """A catalog over given DataFrames (small literal fixtures in tests);
        names not given are derived as usual from those that are."""
        return cls(spark, "", frames=frames)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self._build(name)
        return self._frames[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        try:
            return self[name]
        except KeyError as exc:  # pragma: no cover - programming error
            raise AttributeError(name) from exc

    def holding(self, *names: str) -> "Catalog":
        """This catalog for a job that reads the named tables, or tables
        derived from them, more than once: each is derived once, in the order
        given, and written to the run's folder. A stored catalog has scans
        already and is its own; tables that were given stay as they are."""
        if self.materialized:
            return self
        held = Catalog(self.spark, self.sf_dir, frames=self._given)
        for name in names:
            if name not in self._given:
                held._frames[name] = written(held[name], name.replace("_", "-"))
        return held

    def snapshot(self) -> dict[str, int]:
        """Versions of the stored tables that this catalog reads."""
        if self._pinned is None:
            manifest = Versions(self.spark, self.materialized).manifest(self._version)
            if not manifest:
                raise FileNotFoundError(f"no stored catalog under {self.materialized}")
            self._pinned = manifest["tables"]
        return self._pinned

    def _build(self, name: str) -> DataFrame:
        if name in RAW_TABLES:
            return read_raw(self.spark, self.sf_dir, name)
        if self.materialized and name in BUSINESS_TABLES:
            rows = stored_table(self.spark, self.materialized, name).read(self.snapshot()[name])
            return rows.drop(STORED_PART)
        if name not in VIEWS:
            raise KeyError(name)
        frames = {dep: self[dep] for dep in dependencies(name)}
        return self.spark.sql(VIEWS[name], **frames)


# ---------------------------------------------------------------- stored catalogs

def stored_table(spark: SparkSession, out_dir: str, name: str) -> KeyedTable:
    """The keyed table behind a stored ERP table: the ledger in months, the
    other facts in years, the rest in one partition."""
    if name == "transaction_log":
        from ledgerloom.operators.ledger import ledger_table

        return ledger_table(spark, f"{out_dir.rstrip('/')}/{name}")
    cluster = CLUSTER_BY.get(name, ("id",))
    part = F.date_format(cluster[0], "yyyy") if name in CLUSTER_BY else F.lit("all")
    return KeyedTable(spark, f"{out_dir.rstrip('/')}/{name}", T.StructType.fromDDL(ERP_SCHEMAS[name]), ["id"],
                      STORED_PART, part, list(cluster))


def _derived(spark: SparkSession, sf_dir: str, out_dir: str, write) -> dict[str, int]:
    """Derives the tables in order, each from those written before it;
    ``write(name, rows)`` stores one and gives its version. The order lines
    that four of them share are kept aside until the end."""
    src, aside = Catalog(spark, sf_dir), f"{out_dir.rstrip('/')}/_aside/{uuid.uuid4().hex[:16]}"
    src["line"].write.parquet(aside)
    src._frames["line"] = spark.read.schema(src["line"].schema).parquet(aside)
    versions = {}
    try:
        for name in BUSINESS_TABLES:
            versions[name] = write(name, src[name])
            src._frames[name] = stored_table(spark, out_dir, name).read(versions[name]).select(*src[name].columns)
    finally:
        files.remove(spark, aside)
    return versions


def materialize_catalog(spark: SparkSession, sf_dir: str, out_dir: str) -> Catalog:
    """Derives the 18 ERP tables and stores them under ``out_dir``, each as a
    new version, files clustered on (date, id); the catalog's own version
    names them all and is committed last, so a failure leaves the snapshot
    before it. Returns a catalog that scans the new snapshot."""
    catalog = Versions(spark, out_dir)
    base = catalog.latest()
    versions = _derived(spark, sf_dir, out_dir,
                        lambda name, rows: stored_table(spark, out_dir, name).replace(rows, whole=True))
    return Catalog(spark, sf_dir, out_dir, version=catalog.commit({"tables": versions}, base))


def _prints(rows: DataFrame, table: KeyedTable) -> dict:
    """Rows and sum of row hashes of every partition (an exact sum, so that
    order and task boundaries don't matter)."""
    found = (rows.select(table.part.alias("p"), F.xxhash64(*table.schema.names).cast("decimal(38,0)").alias("h"))
             .groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("h")).collect())
    return {r.p: (r.n, r.h) for r in found}  # partitions, not rows


def refresh_catalog(spark: SparkSession, sf_dir: str, out_dir: str) -> Catalog:
    """Brings a stored catalog up to date with its sources: every table is
    derived and compared with its pinned version by partition (years of the
    facts, months of the ledger), and only partitions that differ are
    written. A snapshot without change keeps its version."""
    catalog = Versions(spark, out_dir)
    base = catalog.latest()
    if not base:
        return materialize_catalog(spark, sf_dir, out_dir)
    pinned = catalog.manifest(base)["tables"]

    def write(name: str, rows: DataFrame) -> int:
        table = stored_table(spark, out_dir, name)
        new, old = _prints(rows, table), _prints(table.read(pinned[name]), table)
        changed, gone = [p for p, v in new.items() if old.get(p) != v], set(old) - set(new)
        if not changed and not gone:
            return pinned[name]
        if table.versions.latest() != pinned[name]:  # merged into since: start from the sources
            return table.replace(rows, whole=True)
        hit = table.part.isin([p for p in changed if p is not None])
        return table.replace(rows.filter(hit | table.part.isNull() if None in changed else hit), drop=gone)

    versions = _derived(spark, sf_dir, out_dir, write)
    return Catalog(spark, sf_dir, out_dir,
                   version=base if versions == pinned else catalog.commit({"tables": versions}, base))


def pin(spark: SparkSession, out_dir: str, versions: dict[str, int]) -> int:
    """A new snapshot with these versions of some tables (for example the
    ledger's after ``sink_ledger`` into ``<out_dir>/transaction_log``)."""
    catalog = Versions(spark, out_dir)
    base = catalog.latest()
    return catalog.commit({"tables": catalog.manifest(base)["tables"] | versions}, base)


def vacuum_catalog(spark: SparkSession, out_dir: str, keep: int = 2) -> None:
    """Removes all snapshots but the last ``keep``, with what only they name."""
    catalog = Versions(spark, out_dir)
    numbers = catalog.all()
    stay = numbers[-keep:]
    manifests = [catalog.manifest(n)["tables"] for n in stay]
    for name in BUSINESS_TABLES:
        stored_table(spark, out_dir, name).vacuum(1, {m[name] for m in manifests})
    for n in numbers:
        if n not in stay:
            files.remove(spark, catalog._file(n))


def load_catalog(spark: SparkSession, sf_dir: str, materialized: str | None = None, version: int | None = None) -> Catalog:
    """Fixed-schema scan of the ERP tables (op ``load_catalog``): derived
    from the driver tables, or a snapshot (default: the newest) of a stored
    catalog, to which the catalog then keeps."""
    return Catalog(spark, sf_dir, materialized, version=version)


__all__ = ["Catalog", "load_catalog", "materialize_catalog", "pin", "refresh_catalog", "vacuum_catalog", "BUSINESS_TABLES", "RAW_SCHEMAS"]
