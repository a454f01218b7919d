"""Filters of keys known only at run time, pushed into the tables they look up.

The keys of a selective side become a bitmap of 16 to 32 bits a key, at most
MOST_BITS, and so at most MOST_BITS / 64 rows of two longs when broadcast: a
bound that holds whatever the number of keys. The table on the other side is
filtered where it is scanned; what passes (the keys, and about one row in
twenty of the others) is all that a join after it has to move. A full bitmap
lets more pass, never less.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.graph import written

LEAST_BITS, MOST_BITS = 1 << 16, 1 << 24


class KeyFilter(NamedTuple):
    words: DataFrame
    bits: int


def _at(cols: list[Column | str], bits: int) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(bits))


def key_filter(keys: DataFrame, cols: list[Column | str], bits: int | None = None) -> KeyFilter:
    """The bitmap of ``cols`` over ``keys`` (read twice, to count and to
    mark, so a written table); the types must be those of the other side."""
    bits = bits or min(MOST_BITS, max(LEAST_BITS, 16 << keys.count().bit_length()))
    marked = keys.select(_at(cols, bits).alias("at"))
    words = (marked.select(F.shiftright("at", 6).alias("kf_word"), F.expr("shiftleft(1L, cast(at % 64 AS int))").alias("bit"))
             .groupBy("kf_word").agg(F.bit_or("bit").alias("kf_bits")))
    return KeyFilter(written(words, "key-filter"), bits)


def split_by_keys(df: DataFrame, cols: list[Column | str], keys: KeyFilter) -> tuple[DataFrame, DataFrame]:
    """Rows whose key may be among the keys, and rows whose key surely isn't."""
    d = df.withColumn("kf_at", _at(cols, keys.bits))
    d = d.join(F.broadcast(keys.words), F.shiftright("kf_at", 6) == F.col("kf_word"), "left")
    hit = F.coalesce(F.expr("shiftrightunsigned(kf_bits, cast(kf_at % 64 AS int)) & 1 = 1"), F.lit(False))
    gone = ("kf_at", "kf_word", "kf_bits")
    return d.filter(hit).drop(*gone), d.filter(~hit).drop(*gone)


def may_match(df: DataFrame, cols: list[Column | str], keys: KeyFilter) -> DataFrame:
    """Rows whose key may be among the keys."""
    return split_by_keys(df, cols, keys)[0]
