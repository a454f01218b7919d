"""Versioned tables: numbered manifests over immutable Parquet folders.

``Versions`` keeps a folder's manifests (``_versions/<number>.json``). A new
version exists from the moment its manifest does, which is written whole or
not at all; a writer that finds the number taken has lost to another one.
Readers hold on to the version they opened.

``KeyedTable`` is a table with a key, in partitions (the ledger: by month).
A manifest names, for each partition, the folder that holds it (and how many
partitions were written to a folder, so that one that is live as a whole is
scanned as one path), so a merge writes the partitions it touches and nothing
else:

1. the batch is written aside, and if it repeats keys (a narrow count shows
   that), once more with one row for each key;
2. the touched partitions are those of its rows, those that hold older
   versions of its rows (unless ``may_move=False`` says that keys never change
   partition), and those of keys to delete;
3. their rows, less those of the batch's keys, are written with the batch to a
   new folder;
4. the new manifest is committed.

A failure before 4 leaves the old version as it was (``vacuum`` removes what
no version names); a batch merged twice changes nothing. The manifest has one
line for each partition, the driver reads no rows.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import union_all
from ledgerloom.sources import files


class ConcurrentWrite(RuntimeError):
    """Another writer committed a version in the meantime."""


class Versions:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, number: int) -> str:
        return f"{self.path}/_versions/{number:010d}.json"

    def all(self) -> list[int]:
        return [int(n[:-5]) for n in files.names(self.spark, f"{self.path}/_versions")
                if n.endswith(".json") and n[:-5].isdigit()]

    def latest(self) -> int:
        """The newest version, 0 if there is none."""
        return max(self.all(), default=0)

    def manifest(self, number: int | None = None) -> dict:
        number = self.latest() if number is None else number
        return json.loads(files.read_text(self.spark, self._file(number))) if number else {}

    def commit(self, content: dict, base: int) -> int:
        """The version after ``base``; fails if there is one already."""
        if not files.write_new(self.spark, self._file(base + 1), json.dumps(content, sort_keys=True)):
            raise ConcurrentWrite(f"{self.path}: version {base + 1} exists")
        return base + 1


class KeyedTable:
    """``schema`` without the partition column; ``part`` computes it (text)."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: list[str], part_name: str, part: Column,
                 cluster: list[str] | None = None):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.key, self.part_name, self.part = key, part_name, part
        self.cluster = cluster or key
        self.versions = Versions(spark, path)
        stored = T.StructType([*schema.fields, T.StructField(part_name, T.StringType())])
        self.stored = stored

    # ------------------------------------------------------------ reading

    def _scan(self, manifest: dict, only: set[str] | None = None) -> DataFrame:
        """Partitions (by folder name) as one scan that still prunes them."""
        by_folder: dict[str, list[str]] = {}
        for part, folder in sorted(manifest.get("parts", {}).items()):
            if only is None or part in only:
                by_folder.setdefault(folder, []).append(part)
        if not by_folder:
            return self.spark.createDataFrame([], self.stored)
        paths = []
        for folder, parts in by_folder.items():
            here = f"{self.path}/data/_folder={folder}"
            paths += [here] if len(parts) == manifest["written"][folder] else [f"{here}/{p}" for p in parts]
        with_folder = T.StructType([*self.stored.fields, T.StructField("_folder", T.StringType())])
        return (self.spark.read.schema(with_folder).option("basePath", f"{self.path}/data").parquet(*paths)
                .drop("_folder"))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the newest by default), with the partition column."""
        return self._scan(self.versions.manifest(version))

    # ------------------------------------------------------------ writing

    def _one_per_key(self, batch: DataFrame, order: list[str]) -> DataFrame:
        """The last row of each key by ``order`` (then by all columns)."""
        rest = [c for c in self.schema.names if c not in self.key]
        if not order and not rest:
            return batch.select(*self.key).distinct()
        ranked = F.struct(*[F.col(c).alias(f"_by_{n}") for n, c in enumerate(order)], *rest)
        last = batch.groupBy(*self.key).agg(F.max(ranked).alias("_row"))
        return last.select(*[F.col(c) if c in self.key else F.col(f"_row.{c}").alias(c) for c in self.schema.names])

    def _put(self, rows: DataFrame, path: str) -> DataFrame:
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """Rows to a new folder, as {partition: folder}. Range partitioning
        splits a hot partition over tasks and keeps its files few."""
        folder = uuid.uuid4().hex[:16]
        to = f"{self.path}/data/_folder={folder}"
        (rows.repartitionByRange(*self.cluster).sortWithinPartitions(*self.cluster)
         .write.partitionBy(self.part_name).parquet(to))
        return {n: folder for n in files.names(self.spark, to) if n.startswith(f"{self.part_name}=")}

    def _commit(self, manifest: dict, base: int, gone: set[str], written: dict[str, str]) -> int:
        parts = {p: f for p, f in manifest.get("parts", {}).items() if p not in gone} | written
        sizes = dict(manifest.get("written", {}))
        sizes |= {f: len(written) for f in written.values()}
        live = set(parts.values())
        return self.versions.commit({"parts": parts, "written": {f: n for f, n in sizes.items() if f in live}}, base)

    def _folder_of(self, value: str | None) -> str:
        utils = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        return f"{self.part_name}=" + ("__HIVE_DEFAULT_PARTITION__" if value is None or value == ""
                                       else utils.escapePathName(value))

    def _parts_of(self, rows: DataFrame) -> set[str]:
        return {self._folder_of(r[0]) for r in rows.select(self.part_name).distinct().collect()}  # partitions, not rows

    def merge(self, batch: DataFrame | None = None, deletes: DataFrame | None = None, order: list[str] | None = None,
              may_move: bool = True, keep_stored: bool = False, attempts: int = 3) -> int:
        """Rows of ``batch`` replace or join those stored (of repeats in the
        batch, the last by ``order``; with ``keep_stored``, a stored row
        stays); keys of ``deletes`` go. Returns the version. Null keys are
        one key."""
        aside = f"{self.path}/_aside/{uuid.uuid4().hex[:16]}"
        parts = []
        try:
            if batch is not None:
                extra = [c for c in order or [] if c not in self.schema.names]
                rows = self._put(batch.select(*self.schema.names, *extra), f"{aside}/given")
                if not rows.groupBy(*self.key).count().filter("count > 1").isEmpty():
                    rows = self._put(self._one_per_key(rows, order or []), f"{aside}/last")
                parts.append(rows.select(*self.schema.names).withColumn(self.part_name, self.part)
                             .withColumn("_gone", F.lit(False)))
            if deletes is not None:
                blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.stored.fields if f.name not in self.key]
                keys = self._put(deletes.select(*self.key).distinct(), f"{aside}/deletes")
                parts.append(keys.select(*self.key, *blank, F.lit(True).alias("_gone")).select(*self.stored.names, "_gone"))
            change = union_all(parts)
            for attempt in range(attempts):
                try:
                    return self._merge_once(change, deletes is not None, may_move, keep_stored)
                except ConcurrentWrite:
                    if attempt == attempts - 1:
                        raise
        finally:
            files.remove(self.spark, aside)

    def _merge_once(self, change: DataFrame, deletes: bool, may_move: bool, keep_stored: bool) -> int:
        base = self.versions.latest()
        held = self.versions.manifest(base)
        fresh = change.filter(~F.col("_gone")).drop("_gone")
        keys = change.select(*[F.col(k).alias(f"_k_{k}") for k in self.key])
        same = lambda rows: [rows[k].eqNullSafe(keys[f"_k_{k}"]) for k in self.key]
        touched = self._parts_of(fresh)
        if held.get("parts") and (may_move or deletes):
            whole = self._scan(held).select(*self.key, self.part_name)
            touched |= self._parts_of(whole.join(keys, same(whole), "left_semi"))
        if not touched:
            return base
        if not touched & set(held.get("parts", {})):  # nothing stored there yet
            return self._commit(held, base, touched, self._write(fresh))
        old = self._scan(held, touched)
        if keep_stored:
            stays = old.select(*[F.col(k).alias(f"_k_{k}") for k in self.key])
            fresh = fresh.join(stays, [fresh[k].eqNullSafe(stays[f"_k_{k}"]) for k in self.key], "left_anti")
            gone = change.filter("_gone").select(*[F.col(k).alias(f"_k_{k}") for k in self.key])
            kept = old.join(gone, [old[k].eqNullSafe(gone[f"_k_{k}"]) for k in self.key], "left_anti") if deletes else old
        else:
            kept = old.join(keys, same(old), "left_anti")
        return self._commit(held, base, touched, self._write(kept.unionByName(fresh)))

    def replace(self, rows: DataFrame, drop: set[str] | None = None, whole: bool = False, attempts: int = 3) -> int:
        """The partitions present in ``rows`` are replaced whole (one row per
        key is the caller's duty) and those of ``drop`` go; the others stay,
        unless ``whole``: then the rows are all there is."""
        written = self._write(rows.select(*self.schema.names).withColumn(self.part_name, self.part))
        for attempt in range(attempts):
            base = self.versions.latest()
            held = self.versions.manifest(base)
            gone = set(held.get("parts", {})) if whole else {self._folder_of(v) for v in drop or ()}
            try:
                return self._commit(held, base, gone, written)
            except ConcurrentWrite:
                if attempt == attempts - 1:
                    raise

    def vacuum(self, keep: int = 2, pinned: set[int] | None = None) -> None:
        """Removes versions but the last ``keep`` and those ``pinned``, and
        folders that none of them names. Not to be run beside a writer or a
        reader of an older version."""
        numbers = self.versions.all()
        stay = (set(numbers[-keep:]) if keep else set()) | (pinned or set())
        used = {f for n in stay for f in self.versions.manifest(n).get("parts", {}).values()}
        for n in numbers:
            if n not in stay:
                files.remove(self.spark, self.versions._file(n))
        for name in files.names(self.spark, f"{self.path}/data"):
            if name.startswith("_folder=") and name.split("=", 1)[1] not in used:
                files.remove(self.spark, f"{self.path}/data/{name}")
        files.remove(self.spark, f"{self.path}/_aside")
