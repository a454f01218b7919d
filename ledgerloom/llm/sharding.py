"""Sharding: a keyed Feistel permutation over global row numbers.

1. Rows get gapless numbers 0 .. n-1 (``common.numbered``: by id, in range
   partitions, so no task holds the table or all rows of an id).
2. A Feistel network on the smallest power of four that holds n, with cycle
   walking (apply again until the value is below n), permutes the numbers.
   It is a bijection of 0 .. n-1, fixed by (n, seed).
3. shard = position mod shards, slot = position div shards: row counts of
   shards differ by one at most, slots have no gaps, and ``locate`` finds
   the row number behind any (shard, slot) without the table.

Defined results: a null text has size 1 and the checksum of no bytes; a null
id is numbered as id -1; rows with the same id are ordered by size and
checksum (wholly equal rows are interchangeable); an empty table gives an
empty result; other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import numbered, stored

ROUNDS = 6
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _round(x: np.ndarray, key: int, mask: np.uint64) -> np.ndarray:
    x = x + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return (x ^ (x >> np.uint64(31))) & mask


def _keys(seed: int) -> list[int]:
    return [(seed * 0x9E3779B97F4A7C15 + i * 0xD1B54A32D192ED03) % 2**64 for i in range(1, ROUNDS + 1)]


def _half_bits(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _feistel(x: np.ndarray, half: int, keys: list[int], back: bool) -> np.ndarray:
    mask, bits = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> bits, x & mask
    if back:
        for k in reversed(keys):
            left, right = right ^ _round(left, k, mask), left
    else:
        for k in keys:
            left, right = right, left ^ _round(right, k, mask)
    return (left << bits) | right


def permute(numbers: np.ndarray, n: int, seed: int, back: bool = False) -> np.ndarray:
    """Positions of row numbers among 0 .. n-1 (``back``: the inverse)."""
    half, keys = _half_bits(n), _keys(seed)
    with np.errstate(over="ignore"):
        x = _feistel(np.asarray(numbers, dtype=np.uint64), half, keys, back)
        outside = np.flatnonzero(x >= n)
        while len(outside):  # cycle walking: about one value in two on average, never endless
            x[outside] = _feistel(x[outside], half, keys, back)
            outside = outside[x[outside] >= n]
    return x.astype(np.int64)


def locate(shard: int, slot: int, n: int, shards: int, seed: int) -> int:
    """The row number that lies in this slot of this shard."""
    return int(permute(np.array([slot * shards + shard]), n, seed, back=True)[0])


def shard_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16,
               seed: int = 20_240) -> DataFrame:
    """One row per row of ``df``: id, size (UTF-8 bytes of the text plus 1),
    text_crc32, row_number, shard, slot."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = stored(df.select(F.col(id_col), (F.octet_length(text) + 1).cast("long").alias("size"),
                              F.crc32(text.cast("binary")).alias("text_crc32")), "sizes")  # texts are read once
    total = narrow.count()

    @F.pandas_udf("long")
    def position(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), total, seed) if len(numbers) else [], dtype="int64")

    return (numbered(narrow, id_col, ["size", "text_crc32"], "row_number")
            .withColumn("_at", position("row_number"))
            .select(id_col, "size", "text_crc32", "row_number",
                    F.pmod("_at", F.lit(shards)).cast("int").alias("shard"),
                    F.floor(F.col("_at") / shards).cast("long").alias("slot")))
