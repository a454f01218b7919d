"""Packing: optimal length buckets and token-budget batches.

1. A global histogram of lengths (a partial aggregate). Lengths up to 255
   have a cell each; above that a power of two is cut into 128 cells, so a
   histogram has less than 8,000 rows whatever the data (the proven bound of
   what the driver reads) and a boundary is within 0.8 % of any length.
2. Dynamic programming over the histogram picks at most ``buckets``
   boundaries with the least total padding.
3. Every row gets its bucket; rows are numbered inside it without holding a
   bucket in one task (``common.numbered``), and each run of
   ``max(1, budget // boundary)`` rows is a batch.

A token here is a white-space word unless ``length`` gives another count:
``n_tokens`` and the budget of the registered queries are in words, so a text
without ASCII spaces counts as 1, and a full batch can exceed the budget in a
tokenizer's tokens. With ``token_counts.count_tokens(df)`` for ``df`` and its
column as ``length``, buckets and batches keep to real tokens.

Defined results: a null or empty text has length 0 and takes a slot like any
other; a row longer than the budget is not cut, it is a batch of its own
with ``over_budget`` true; rows with the same id are interchangeable when
their lengths are equal, else ordered by length; an empty table gives an
empty result; other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import numbered, stored

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def length_cell(length: str) -> Column:
    """The upper edge of a length's histogram cell."""
    return F.expr(f"shiftleft(shiftright({length} + shiftleft(1L, greatest(length(bin({length})) - 8, 0)) - 1, "
                  f"greatest(length(bin({length})) - 8, 0)), greatest(length(bin({length})) - 8, 0))")


def best_boundaries(cells: list[tuple[int, int, int]], buckets: int) -> list[int]:
    """``cells``: (count, sum of lengths, largest length), by rising length.
    The boundaries (largest length of each bucket) with the least padding;
    ties go to fewer buckets, then to the earlier start of the last bucket."""
    if not cells:
        return []
    counts, _, tops = (np.array(x, dtype=np.int64) for x in zip(*cells, strict=True))
    upto = np.concatenate([[0], np.cumsum(counts)])
    n = len(cells)
    # slots * boundary summed over buckets; padding is that less the fixed sum of lengths
    cost = upto[1:] * tops
    starts = [np.zeros(n, dtype=np.int64)]
    best, layers = [cost], 1
    while layers < min(buckets, n):
        last, cost, start = best[-1], np.empty(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        cost[:layers], start[:layers] = last[:layers], starts[-1][:layers]
        for j in range(layers, n):
            options = last[:j] + (upto[j + 1] - upto[1:j + 1]) * tops[j]
            i = int(options.argmin())
            cost[j], start[j] = options[i], i + 1
        best.append(cost)
        starts.append(start)
        layers += 1
    at = min(range(layers), key=lambda k: (best[k][n - 1], k))
    ends, j = [], n - 1
    while True:
        ends.append(int(tops[j]))
        if at == 0 or starts[at][j] == 0:
            return ends[::-1]
        j, at = int(starts[at][j]) - 1, at - 1


def pack(df: DataFrame, id_col: str = "doc_id", length: Column | None = None, text_col: str = "text",
         buckets: int = 16, budget: int = 65_536) -> DataFrame:
    """One row per row of ``df``: id, n_tokens, bucket, boundary, batch (its
    number in the bucket), slot, padding, over_budget."""
    narrow = stored(df.select(F.col(id_col), (word_count(text_col) if length is None else length).alias("n_tokens")),
                    "lengths")  # texts are read once
    hist = (narrow.groupBy(length_cell("n_tokens").alias("cell"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("s"), F.max("n_tokens").alias("top"))
            .orderBy("cell").collect())  # under 8,000 rows, see above
    bounds = best_boundaries([(r.n, r.s, r.top) for r in hist], buckets)
    bucket, boundary = F.lit(0), F.lit(0).cast("long")
    for i, b in enumerate(bounds):
        bucket = F.when(F.col("n_tokens") <= b, bucket).otherwise(F.lit(i + 1))
    if bounds:
        boundary = F.element_at(F.array(*[F.lit(b).cast("long") for b in bounds]), F.col("bucket") + 1)
    placed = narrow.withColumn("bucket", bucket.cast("int")).withColumn("boundary", boundary)
    size = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("boundary"), F.lit(1)))).cast("long")
    return (numbered(placed, id_col, ["n_tokens"], "_number", by=["bucket"])
            .select(id_col, "n_tokens", "bucket", "boundary", F.floor(F.col("_number") / size).alias("batch"),
                    F.pmod(F.col("_number"), size).alias("slot"),
                    (F.col("boundary") - F.col("n_tokens")).alias("padding"),
                    (F.col("n_tokens") > budget).alias("over_budget")))
