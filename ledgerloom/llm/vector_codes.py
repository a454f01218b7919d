"""Compression of vectors to short codes, with norm-of-sum bounds.

Components become integers ``floor(scale * x)``; a vector is cut into
``parts`` equal pieces, each piece is named by the nearest entry of its part's
codebook, and the codebooks are refined over ``rounds``. All distances are
exact integers, so the result doesn't depend on partitioning.

Most distances are never computed. The entries of a codebook lie in GROUPS
groups, and a row keeps one lower bound for each group (the distance to the
nearest entry that isn't its own) with the round it was measured in. The
codebooks of all rounds are kept, so in a later round the bound is lowered by
the net way an entry has come since that round, ``|sum of its steps|``, which
is at most the sum of the lengths of the steps. A group is scanned
again only where its lowered bound doesn't exceed the exact distance to the
row's own entry.

The rows carry their bounds from round to round in a stored table (the round
before is then removed), a round reads it once to assign and once for the sums
of the entries, which every task adds up before the shuffle. The driver holds
the codebooks alone: ``parts * entries`` short vectors for each round.

Defined results: rows whose vector is null or empty, holds null or
non-finite components, or has another length than most (ties: the shorter)
take no part; a length that doesn't divide is read as if zeros followed;
components beyond ``limit(length)`` (2^27 for 64, that is 131,072 before
scaling) count as that limit, so that every error fits a long; repeated rows
and rows with a null id count each, null ids come last in the first
codebook, ties there go to the smaller vector; fewer rows than entries make
shorter codebooks; an empty table gives an empty result; a sum of errors
beyond a long is null; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import discard, scratch_path, stored

PARTS, ENTRIES, ROUNDS, SCALE, GROUPS = 4, 256, 4, 1024, 16


def limit(length: int) -> int:
    """Largest component size for which the error of a vector fits a long."""
    return isqrt(2 ** 62 // max(1, length)) // 2


def finite(vector: Column) -> Column:
    return (F.size(vector) > 0) & F.forall(
        vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))


@dataclass
class Codebooks:
    """The codebooks of every round, first to last: (part, entry, component)."""
    history: list[np.ndarray]
    length: int

    @property
    def last(self) -> np.ndarray:
        return self.history[-1]

    def sha256(self) -> str:
        """Digest of the last entries' components in decimal, comma-joined."""
        parts, entries, width = self.last.shape
        flat = [str(v) for p in range(parts) for e in range(entries)
                for v in self.last[p, e, :max(0, min(width, self.length - p * width))]]
        return hashlib.sha256(",".join(flat).encode()).hexdigest()

    def decode(self, code: str) -> list[int]:
        """The vector of integers that a code stands for."""
        at = [int(code[2 * p:2 * p + 2], 16) for p in range(len(self.last))]
        return [int(v) for p, e in enumerate(at) for v in self.last[p, e]][:self.length]

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(p, e, [int(v) for v in self.last[p, e]]) for p in range(self.last.shape[0])
                                      for e in range(self.last.shape[1])], "part int, entry int, vector array<long>")


def split_entries(book: np.ndarray, groups: int) -> list[np.ndarray]:
    """Entries of a codebook in groups of near ones: halved again and again
    along the component that varies most."""
    todo = [np.arange(len(book))]
    while len(todo) < groups and max(map(len, todo)) > 1:
        todo.sort(key=len)
        rows = todo.pop()
        y = book[rows]
        order = rows[np.argsort(y[:, y.var(axis=0).argmax()] if y.shape[1] else rows, kind="stable")]
        todo += [order[:len(order) // 2], order[len(order) // 2:]]
    return sorted((np.sort(g) for g in todo), key=lambda g: g[0])


def net_drift(history: list[np.ndarray], groups: list[list[np.ndarray]]) -> np.ndarray:
    """(part, round, group): how far an entry of the group has come at most,
    straight from its place in that round to its place now."""
    now = history[-1].astype(np.float64)
    way = np.stack([np.sqrt(((now - then) ** 2).sum(axis=-1)) for then in history])  # round, part, entry
    return np.array([[[way[t, p, g].max() for g in groups[p]] for t in range(len(history))]
                     for p in range(len(now))]) * (1 + 1e-9)


def _squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances: by a product of floats where every sum fits
    53 bits, by integers elsewhere (the same numbers)."""
    if x.shape[1] == 0:
        return np.zeros((len(x), len(book)), dtype=np.int64)
    top = int(max(np.abs(x).max(), np.abs(book).max()))
    if 4 * x.shape[1] * top * top < 2 ** 53:
        a, b = x.astype(np.float64), book.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    out = np.empty((len(x), len(book)), dtype=np.int64)
    for at in range(0, len(x), 1024):
        out[at:at + 1024] = ((x[at:at + 1024, None, :] - book[None, :, :]) ** 2).sum(axis=-1)
    return out


HUGE = np.iinfo(np.int64).max


def assign_part(x: np.ndarray, book: np.ndarray, groups: list[np.ndarray], drift: np.ndarray, now: int,
                code: np.ndarray, bound: np.ndarray, stamp: np.ndarray):
    """The nearest entry (ties: lower index) of each row and its squared
    distance, with the bounds of all groups brought up to date (in place).
    Also the number of (row, group) scans."""
    n, rows = len(x), np.arange(len(x))
    fresh = code[0] < 0
    own = np.full(n, HUGE) if fresh else ((x - book[code]) ** 2).sum(axis=1)
    low = bound - drift[stamp, np.arange(len(groups))]
    near = np.ones(low.shape, dtype=bool) if fresh else low <= (np.sqrt(own) * (1 + 1e-9))[:, None]
    first = np.full(low.shape, HUGE)
    second = np.full(low.shape, HUGE)
    at = np.full(low.shape, HUGE)
    for g, members in enumerate(groups):
        scan = np.flatnonzero(near[:, g])
        if not len(scan):
            continue
        d, line = _squares(x[scan], book[members]), np.arange(len(scan))
        best = d.argmin(axis=1)  # members ascend, so ties give the lower index
        first[scan, g], at[scan, g] = d[line, best], members[best]
        if len(members) > 1:
            d[line, best] = HUGE
            second[scan, g] = d.min(axis=1)
    found = first.min(axis=1)
    index = np.where(first == found[:, None], at, HUGE).min(axis=1)
    stays = ~fresh & ((own < found) | ((own == found) & (code <= index)))
    chosen = np.where(stays, code, index)
    error = np.where(stays, own, found)
    if not fresh:
        # the entry left behind bounds its group, if that wasn't scanned
        group_of = np.empty(len(book), dtype=np.int64)
        for g, members in enumerate(groups):
            group_of[members] = g
        old = group_of[code]
        left = (chosen != code) & ~near[rows, old]
        bound[rows[left], old[left]] = np.minimum(low[rows[left], old[left]], np.sqrt(own[left]) * (1 - 1e-9))
        stamp[rows[left], old[left]] = now
    rest = np.where(at == chosen[:, None], second, first)
    tight = np.where(rest == HUGE, np.inf, np.sqrt(rest.astype(np.float64)) * (1 - 1e-6))  # below it as a float, too
    bound[near], stamp[near] = tight[near], now
    return chosen, error, int(near.sum())


def _blobs(values: np.ndarray) -> pa.Array:
    """A row of numbers as one binary value: what only task code reads needs
    no conversion on its way through Spark."""
    n = len(values)
    raw = np.ascontiguousarray(values)
    at = np.arange(n + 1, dtype=np.int32) * (raw.itemsize * raw.shape[1])
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(at), pa.py_buffer(raw)])


def _matrix(batch: pa.RecordBatch, name: str, dtype) -> np.ndarray:
    """The rows of such a column, or of an array column."""
    column = batch.column(name)
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(batch.num_rows, -1)
    at = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset:column.offset + batch.num_rows + 1]
    raw = np.frombuffer(column.buffers()[2], dtype=np.uint8)[at[0]:at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw.view(dtype).reshape(batch.num_rows, -1)


STATE = "ints binary, codes binary, bounds binary, stamps binary, scanned float"


def _assigner(history: list[np.ndarray], groups: list[list[np.ndarray]], last: bool, keys: list[str]):
    """The task code of one round: rows with their state in, the new state
    out (or, in the last round, code and error)."""
    book, now = history[-1], len(history) - 1
    drift = net_drift(history, groups)
    n_groups = [len(g) for g in groups]
    starts = np.concatenate([[0], np.cumsum(n_groups)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            ints = _matrix(b, "ints", np.int32)
            x = ints.astype(np.int64).reshape(n, len(book), -1)
            if now:
                codes, bounds = _matrix(b, "codes", np.uint8).astype(np.int64), _matrix(b, "bounds", np.float32).astype(np.float64)
                stamps = _matrix(b, "stamps", np.uint8).astype(np.int64)
            else:
                codes = np.full((n, len(book)), -1)
                bounds, stamps = np.zeros((n, starts[-1])), np.zeros((n, starts[-1]), dtype=np.int64)
            error, scans = np.zeros(n, dtype=np.int64), 0
            for p in range(len(book)):
                at = slice(starts[p], starts[p + 1])
                codes[:, p], e, s = assign_part(x[:, p], book[p], groups[p], drift[p], now,
                                                codes[:, p].copy(), bounds[:, at], stamps[:, at])
                error += e
                scans += s
            kept = [b.column(k) for k in keys]
            if last:
                text = [bytes(row).hex() for row in codes.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(text), pa.array(error)], [*keys, "code", "error"])
            else:
                share = pa.array(np.full(n, scans / (n * starts[-1])), pa.float32())
                yield pa.RecordBatch.from_arrays(
                    [*kept, _blobs(ints), _blobs(codes.astype(np.uint8)), _blobs(bounds.astype(np.float32)),
                     _blobs(stamps.astype(np.uint8)), share],
                    [*keys, "ints", "codes", "bounds", "stamps", "scanned"])

    return run


def _totals(shape: tuple[int, ...]):
    """Task code: the sums (at >= 0) and counts (at = -1) of the entries."""
    parts, entries, width = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width + 1), dtype=np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b, "ints", np.int32).astype(np.int64).reshape(b.num_rows, parts, width)
            codes = _matrix(b, "codes", np.uint8)
            for p in range(parts):
                order = np.argsort(codes[:, p], kind="stable")
                used, start = np.unique(codes[order, p], return_index=True)
                total[p, used, 1:] += np.add.reduceat(x[order, p], start, axis=0)
                total[p, used, 0] += np.diff(np.append(start, len(order)))
        p, e = np.nonzero(total[:, :, 0])
        if len(p):
            rows = total[p, e]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(p, width + 1), pa.int32()), pa.array(np.repeat(e, width + 1), pa.int32()),
                 pa.array(np.tile(np.arange(-1, width), len(p)), pa.int32()), pa.array(rows.ravel(), pa.int64())],
                ["part", "entry", "at", "total"])

    return run


def _moved(book: np.ndarray, state: DataFrame) -> np.ndarray:
    """The codebook with every used entry at the floor of its parts' mean."""
    summed = (state.select("ints", "codes").mapInArrow(_totals(book.shape), "part int, entry int, at int, total long")
              .groupBy("part", "entry", "at").agg(F.sum("total").alias("total")).collect())  # parts*entries*(width+1)
    sums, counts = np.zeros(book.shape, dtype=np.int64), np.zeros(book.shape[:2], dtype=np.int64)
    for r in summed:
        if r["at"] < 0:
            counts[r.part, r.entry] = r.total
        else:
            sums[r.part, r.entry, r["at"]] = r.total
    new = book.copy()
    used = counts > 0
    new[used] = sums[used] // counts[used][:, None]
    return new


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
             groups: int = GROUPS, scanned: list | None = None) -> tuple[DataFrame, Codebooks | None]:
    """(vec_id, label, code, error) of every row that takes part, and the
    codebooks (None for an empty table). ``scanned``, if given, receives for
    each round the share of (row, group) pairs that were scanned."""
    spark = df.sparkSession
    if not 1 <= entries <= 256:
        raise ValueError("a code is two hex digits: 1 to 256 entries")
    read = (df.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
            .filter(F.col("v").isNotNull() & finite(F.col("v"))))
    kind = {f.name: f.dataType.simpleString() for f in read.schema}
    keys = f"vec_id {kind['vec_id']}, label {kind['label']}"
    length = read.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if length is None:
        return spark.createDataFrame([], f"{keys}, code string, error long"), None
    length = length["d"]
    width, top = -(-length // parts), limit(length)
    ints = F.transform("v", lambda c: F.least(F.greatest(F.floor(c.cast("double") * scale), F.lit(-top)), F.lit(top))
                       .cast("int"))
    pad = F.array_repeat(F.lit(0), parts * width - length)
    here = scratch_path(spark, "codes-rows")
    (read.filter(F.size("v") == length).select("vec_id", "label", F.concat(ints, pad).alias("ints"))
     .write.option("compression", "zstd").parquet(here))
    state = spark.read.schema(f"{keys}, ints array<int>").parquet(here)
    first = state.select("vec_id", "ints").orderBy(F.asc_nulls_last("vec_id"), "ints").limit(entries).collect()
    book = np.array([r.ints for r in first], dtype=np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    history = [np.ascontiguousarray(book)]
    members = [split_entries(b, groups) for b in history[0]]
    for _ in range(rounds):
        there = scratch_path(spark, "codes-state")
        schema = f"{keys}, {STATE}"
        (state.mapInArrow(_assigner(history, members, False, ["vec_id", "label"]), schema)
         .write.option("compression", "zstd").parquet(there))
        state = spark.read.schema(schema).parquet(there)
        discard(spark, here)
        here = there
        if scanned is not None:
            scanned.append(state.agg(F.avg("scanned")).first()[0])
        history.append(_moved(history[-1], state))
    coded = stored(state.mapInArrow(_assigner(history, members, True, ["vec_id", "label"]),
                                    f"{keys}, code string, error long"), "codes")
    discard(spark, here)
    return coded, Codebooks(history, length)


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds ``label_error``: the error of all rows of the same label, nulls
    together. The totals (added up before the shuffle) are stored, so the
    join is between two fresh tables and a hot label is split."""
    totals = stored(coded.groupBy(F.col("label").alias("_of")).agg(
        F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error")), "label-errors")
    return coded.join(totals, coded["label"].eqNullSafe(totals["_of"]), "left").drop("_of")
