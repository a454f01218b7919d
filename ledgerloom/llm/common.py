"""Helpers shared by the operators: stored intermediates and row numbering."""

from __future__ import annotations

from contextlib import contextmanager
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.session import scratch_path

#: Rows are numbered in at least this many parts.
LEAST_PARTS = 32
_PRIME = 2_147_483_647
_FACTOR = 1_103_515_245


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage,
    survives lost executors, is computed once, and gives the planner its
    real size (a later join broadcasts it only below the session's
    threshold; beyond it, both sides are plain shuffles, which adaptive
    execution splits when a key is hot)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Removes written intermediates that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def arrow_rows(spark: SparkSession, n: int, key: str = "spark.sql.execution.arrow.maxRecordsPerBatch"):
    """Rows with several long texts go to Python in batches of at most n."""
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(n, int(before)) if int(before) > 0 else n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def few_large_rows(spark: SparkSession):
    """Rows of megabytes are read from Parquet a few at a time."""
    return arrow_rows(spark, 4, "spark.sql.parquet.columnarReaderBatchSize")


def mixed(id_col: str | Column) -> Column:
    """A fixed scatter of an id over 0 .. 2^31-2 by arithmetic alone (so SQL
    can repeat it); a null id counts as -1."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.pmod(F.coalesce(c.cast("long"), F.lit(-1)), F.lit(_PRIME)) * F.lit(_FACTOR) + F.lit(12_345),
                  F.lit(_PRIME))


def numbered(df: DataFrame, id_col: str, order: list[str], out: str, by: list[str] | None = None) -> DataFrame:
    """Adds ``out``: gapless row numbers from 0 within each group ``by``, in
    the order (mixed(id), id, order...).

    Rows are range-partitioned once in that order and written down with the
    number of their part; they are numbered inside (group, part) and shifted by
    the counts of the parts before. A salt, last in the order, parts rows that
    are equal in all of it, so no task holds a whole group or all rows of one
    id, and the numbers depend on the rows alone (of rows equal in all of the
    order, any may come first).
    """
    by, spark = by or [], df.sparkSession
    salted = (df.withColumn("_mix", mixed(id_col))
              .withColumn("_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 16)).cast("int")))
    line = ["_mix", id_col, *order, "_salt"]
    parts = max(LEAST_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    d = stored(salted.repartitionByRange(parts, *by, *line).withColumn("_part", F.spark_partition_id()), "numbered")
    counts = d.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # a group has at most as many rows here as there are parts
    offsets = stored(counts.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_part").alias("_of_part"),
                                   F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")), "offsets")
    inside = Window.partitionBy(*by, "_part").orderBy(*line)
    same = d["_part"] == offsets["_of_part"]
    for c in by:
        same = same & d[c].eqNullSafe(offsets[f"_by_{c}"])
    return (d.withColumn("_in", F.row_number().over(inside)).join(offsets, same)
            .withColumn(out, F.col("_offset") + F.col("_in") - 1)
            .drop("_mix", "_salt", "_part", "_in", "_offset", "_of_part", *[f"_by_{c}" for c in by]))


#: A filter of ids is a bitmap of 16 to 32 bits an id, in words of 64, but of
#: no more than MOST_BITS: the words it is broadcast as never exceed
#: MOST_BITS / 64 rows. Beyond 8 million ids it lets more pass, never less.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27


class IdFilter(NamedTuple):
    words: DataFrame
    bits: int


def id_filter(ids: DataFrame, col: str) -> IdFilter:
    """The bitmap (word, bits) of hashed ids, combined before the shuffle."""
    bits = min(MOST_BITS, max(LEAST_BITS, 16 << ids.count().bit_length()))
    at = F.pmod(F.xxhash64(col), F.lit(bits))
    return IdFilter(stored(ids.select(F.shiftright(at, 6).alias("word"), F.expr(
        f"shiftleft(1L, cast(pmod(xxhash64(`{col}`), {bits}) % 64 AS int))").alias("bit"))
        .groupBy("word").agg(F.bit_or("bit").alias("bits")), "id-filter"), bits)


def split_by_filter(df: DataFrame, col: str, ids: IdFilter) -> tuple[DataFrame, DataFrame]:
    """Rows whose id may be among the ids of the filter, and rows whose id
    is surely not. Only the former need a join with them, so the others'
    texts are never shuffled."""
    at = F.pmod(F.xxhash64(col), F.lit(ids.bits))
    w = ids.words.select(F.col("word").alias("_word"), F.col("bits").alias("_bits"))
    d = df.join(F.broadcast(w), F.shiftright(at, 6) == F.col("_word"), "left")
    hit = F.coalesce(F.expr(f"shiftrightunsigned(_bits, cast(pmod(xxhash64(`{col}`), {ids.bits}) % 64 AS int)) & 1 = 1"),
                     F.lit(False))
    return d.filter(hit).drop("_word", "_bits"), d.filter(~hit).drop("_word", "_bits")


def components(links: DataFrame) -> DataFrame:
    """(node, label): for every node of the links (a, b) the smallest node it
    reaches. Each round hooks every label to its smallest neighbour, follows
    the hooks to their roots by pointer jumping, and contracts the links to
    the labels; rounds are logarithmic and only narrow rows move."""
    edges = stored(links.select("a", "b").filter("a <> b")
                   .select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
                           .alias("e")).select("e.*").distinct(), "links")
    labels = stored(edges.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct(), "labels")
    while not edges.isEmpty():
        up = stored(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"))
                    .select("node", F.least("node", "b").alias("up")), "hooks")
        while True:
            over = up.select(F.col("node").alias("mid"), F.col("up").alias("top"))
            jumped = stored(up.join(over, up["up"] == over["mid"])
                            .select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")),
                            "hooks")
            up = jumped.select("node", "up")
            if jumped.filter("moved").isEmpty():
                break
        hook = up.select(F.col("node").alias("label"), "up")
        labels = stored(labels.join(hook, "label", "left")
                        .select("node", F.coalesce("up", "label").alias("label")), "labels")
        edges = stored(edges.join(up.select(F.col("node").alias("a"), F.col("up").alias("ua")), "a")
                       .join(up.select(F.col("node").alias("b"), F.col("up").alias("ub")), "b")
                       .filter("ua <> ub").select(F.col("ua").alias("a"), F.col("ub").alias("b")).distinct(), "links")
    return labels
