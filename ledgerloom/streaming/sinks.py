"""Sinks of update-mode streams.

``CompactingSink`` keeps the last version of every key: each micro-batch
writes the rows it changed to a folder of its own (written again if the batch
is run again), and every ``every`` batches they are merged with the snapshot
before into a new one, which a manifest puts in force. A reader takes the
snapshot and the few batches after it, whatever the age of the stream; a
micro-batch costs what it changes, and the merge is shared by ``every`` of
them. A failure between writing and manifest leaves the snapshot before it,
with its batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.sources import files
from ledgerloom.sources.versions import Versions


class CompactingSink:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: T.StructType, every: int = 8):
        self.spark, self.path, self.keys, self.schema, self.every = spark, path.rstrip("/"), keys, schema, every
        self.versions = Versions(spark, path)

    def __call__(self, changed: DataFrame, batch: int) -> None:
        """The batch function of ``foreachBatch``."""
        changed.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/delta/batch={batch}")
        if len(self._deltas(self.versions.manifest())) >= self.every:
            self.compact()

    def _deltas(self, manifest: dict) -> list[int]:
        """Numbers of the batches after the snapshot."""
        found = [int(n[6:]) for n in files.names(self.spark, f"{self.path}/delta") if n.startswith("batch=")]
        return sorted(n for n in found if n > manifest.get("upto", -1))

    def _rows(self, manifest: dict) -> DataFrame:
        """All versions after and with the snapshot's, each with its batch."""
        schema = T.StructType([*self.schema.fields, T.StructField("batch", T.LongType())])
        rows, deltas = self.spark.createDataFrame([], schema), self._deltas(manifest)
        if deltas:
            rows = (self.spark.read.schema(schema).option("basePath", f"{self.path}/delta")
                    .parquet(*[f"{self.path}/delta/batch={n}" for n in deltas]))
        if "snapshot" in manifest:
            old = self.spark.read.schema(self.schema).parquet(f"{self.path}/snapshot/{manifest['snapshot']}")
            rows = old.withColumn("batch", F.lit(manifest["upto"]).cast("long")).unionByName(rows)
        return rows

    def _last(self, manifest: dict) -> DataFrame:
        values = [n for n in self.schema.names if n not in self.keys]
        return (self._rows(manifest).groupBy(*self.keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
                .select(*self.keys, *[F.col(f"v.{v}").alias(v) for v in values]))

    def read(self) -> DataFrame:
        """The last version of every key."""
        return self._last(self.versions.manifest())

    def compact(self) -> None:
        """Merges the batches so far into a new snapshot. What the snapshot
        before it made superfluous goes now, so a reader of the last
        manifest has until the next merge."""
        base = self.versions.latest()
        manifest = self.versions.manifest(base)
        deltas = self._deltas(manifest)
        if not deltas:
            return
        name = uuid.uuid4().hex[:16]
        self._last(manifest).write.parquet(f"{self.path}/snapshot/{name}")
        self.versions.commit({"snapshot": name, "upto": deltas[-1]}, base)
        keep = {name, manifest.get("snapshot")}
        for old in files.names(self.spark, f"{self.path}/snapshot"):
            if old not in keep:
                files.remove(self.spark, f"{self.path}/snapshot/{old}")
        for old in files.names(self.spark, f"{self.path}/delta"):
            if old.startswith("batch=") and int(old[6:]) <= manifest.get("upto", -1):
                files.remove(self.spark, f"{self.path}/delta/{old}")


def batch_folders(path: str, of: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> Callable[[DataFrame, int], None]:
    """A batch function that writes ``of(rows)`` under ``batch=<id>``, again
    if the batch is run again."""
    def write(rows: DataFrame, batch: int) -> None:
        of(rows).write.mode("overwrite").parquet(f"{path}/batch={batch}")
    return write
