"""Running values of ordered events, safe for hot keys: a prefix scan over
range partitions.

A plain window over a key sends all its rows to one task. Here the rows are
range-partitioned once by (key, order) and written down with the number of
their part, so a key with a third of all rows is a third of the parts, and
the numbers stay the same whatever task is run again. Then

1. each part tells its first and last key, and the value that its last key's
   rows come to (a few rows per part, so the driver holds as many rows as
   there are parts);
2. from them follows, part by part, what the rows before a part hand on to
   its first key: the only key that began in an earlier part;
3. the value inside (part, key) is an ordinary window, whose groups are no
   larger than a part, and what was handed on is joined as a small table.

The fact is read once and shuffled twice, narrow rows only (Spark samples it
for the range bounds). The order must be total within a key; null keys are
one key, nulls sort first.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.session import scratch_path


def _in_parts(df: DataFrame, key: str, order: list[str], parts: int | None) -> DataFrame:
    """``df`` written in range partitions by (key, order), with their number."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "ordered")
    by = [key, *order]
    spread = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
    numbered = spread.withColumn("_part", F.spark_partition_id())
    numbered.write.parquet(path)
    return spark.read.schema(numbered.schema).parquet(path)


def _handed_on(rows: DataFrame, key: str, carry: Column, kind: T.DataType, combine: Callable) -> DataFrame:
    """(part, key, value): what the parts before a part hand on to its first key."""
    spark = rows.sparkSession
    k = F.struct(key)
    edges = rows.groupBy("_part").agg(F.min(k).alias("first"), F.max(k).alias("last"))
    last = edges.select(F.col("_part").alias("_p"), F.col("last").alias("_last"))  # one row for each part
    of_last = (rows.join(F.broadcast(last), (rows["_part"] == F.col("_p")) & rows[key].eqNullSafe(F.col(f"_last.{key}")))
               .groupBy("_part").agg(carry.alias("carry")))
    found, held, before = [], None, None  # the key that may go on, and its value so far
    for r in edges.join(of_last, "_part").orderBy("_part").collect():
        first, last_ = r["first"], r["last"]
        goes_on = before is not None and before == first
        if goes_on and held is not None:
            found.append((r["_part"], first[key], held))
        held = combine(held, r["carry"]) if goes_on and first == last_ else r["carry"]
        before = last_
    return spark.createDataFrame(found, T.StructType([
        T.StructField("_to", T.IntegerType()), T.StructField("_first_key", rows.schema[key].dataType),
        T.StructField("_carry", kind)]))


def _scan(df: DataFrame, key: str, order: list[str], carry: Column, inside: Callable, finish: Callable, out: str,
          combine: Callable, parts: int | None) -> DataFrame:
    rows = _in_parts(df, key, order, parts)
    kind = rows.agg(carry.alias("c")).schema["c"].dataType
    first = _handed_on(rows, key, carry, kind, combine)  # at most one row for each part
    window = Window.partitionBy("_part", key).orderBy(*order)
    d = rows.withColumn("_in", inside(window))
    d = d.join(F.broadcast(first), (d["_part"] == first["_to"]) & d[key].eqNullSafe(first["_first_key"]), "left")
    return d.withColumn(out, finish(F.col("_carry"), F.col("_in"), kind)).drop("_part", "_in", "_to", "_first_key", "_carry")


def running_sum(df: DataFrame, key: str, day: str, tiebreak: list[str], value: str, out: str,
                parts: int | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the key up to this
    one, by (day, tiebreak); exact for decimals."""
    def inside(w):
        return F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))

    def finish(carry, within, kind):
        zero = F.lit(Decimal(0) if isinstance(kind, T.DecimalType) else 0).cast(kind)
        return F.coalesce(carry, zero) + F.coalesce(within, zero)

    return _scan(df, key, [day, *tiebreak], F.sum(value), inside, finish, out,
                 lambda a, b: b if a is None else a if b is None else a + b, parts)


def last_before(df: DataFrame, key: str, order: list[str], value: str, out: str, parts: int | None = None) -> DataFrame:
    """Adds ``out``: the last value that isn't null among the rows of the key
    before this one."""
    def inside(w):
        return F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))

    latest = F.max_by(F.when(F.col(value).isNotNull(), F.struct(value)), F.when(F.col(value).isNotNull(), F.struct(*order)))
    return _scan(df, key, order, latest[value], inside, lambda carry, within, _: F.coalesce(within, carry), out,
                 lambda a, b: a if b is None else b, parts)
