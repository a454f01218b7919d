"""Host-level quality rules: failures by domain, shrunk by a beta prior.

1. Every whole text gets its counts (``rule_counts``) and four rules: too
   few words, repeated 5-word windows, symbols, repeated lines. The first two
   are the base rules that reject a document by themselves.
2. Per host, failures of each rule are summed (a partial aggregate). Each
   rule's rates over all hosts give a beta prior by the method of moments,
   and a host's rate is shrunk to it: (failures + mean * strength) /
   (documents + strength). A small host so keeps close to the mean.
3. A host is rejected when the shrunk rate of any rule exceeds
   ``host_limit``; the verdict is joined back to the documents.

Defined results: a null text has no words and fails; a null host is a host
of its own; repeated rows count each; an empty table gives an empty result;
other columns are kept as they are (``keep_documents``) or not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import stored

MIN_WORDS, REPEAT_PCT, SYMBOL_PCT, DUP_LINE_PCT, WINDOW = 10, 20, 10, 30, 5
SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
RULES = ("short", "repeats", "symbols", "dup_lines")


def repeat_words(words: list) -> int:
    """Words that lie in a window of WINDOW words found twice or more."""
    n = len(words)
    if n <= WINDOW:
        return 0
    seen: dict = {}
    one = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=n)
    if len(seen) == n:
        return 0
    gram = one
    for k in range(1, WINDOW):  # exact ids of the (k + 1)-word windows
        distinct, ids, times = np.unique(gram[:-1] * len(seen) + one[k:], return_inverse=True, return_counts=True)
        if len(distinct) == len(ids):
            return 0
        gram = ids
    edge = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(times[gram] > 1)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def counts_of(text: str | None) -> tuple[int, int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()  # splits on exactly the six ASCII spaces
    chars = len(text) - sum(map(text.count, SPACES)) if words else 0
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (len(words), chars, sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)),
            repeat_words(words))


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def rule_counts(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        yield pd.DataFrame([counts_of(t) for t in batch], columns=list(COUNTS), dtype="int64")


def _rules(c: Column) -> list[Column]:
    return [c["n_words"] < MIN_WORDS, 100 * c["n_repeat_words"] > REPEAT_PCT * c["n_words"],
            100 * c["n_symbols"] > SYMBOL_PCT * c["n_words"], 100 * c["n_dup_lines"] > DUP_LINE_PCT * c["n_lines"]]


def base_failed(c: Column) -> Column:
    short, repeats, *_ = _rules(c)
    return short | repeats


def rejected_hosts(measured: DataFrame, host_col: str, host_limit: float) -> DataFrame:
    """The hosts whose shrunk rate of some rule exceeds the limit."""
    per = stored(measured.groupBy(F.col(host_col).alias("host")).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        *[F.sum(r.cast("double")).alias(name) for r, name in zip(_rules(F.col("_rules")), RULES, strict=True)]), "hosts")
    # one row each: the sums over all hosts, then the moments about the means
    sums = per.agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("n"), F.count(F.lit(1)).alias("hosts"),
                   *[F.sum(name).alias(name) for name in RULES]).first()
    if not sums["n"]:
        return per.select("host")
    mean = {name: sums[name] / sums["n"] for name in RULES}
    spread = per.agg(*[(F.sum(F.col("n") * F.pow(F.col(name) / F.col("n") - mean[name], F.lit(2.0)))
                        / sums["n"]).alias(name) for name in RULES]).first()
    rejected = F.lit(False)
    for name in RULES:
        noise = mean[name] * (1 - mean[name])
        between = spread[name] - noise * (sums["hosts"] - 1) / sums["n"]
        strength = 1e6 if between <= 0 else min(1e6, max(1.0, noise / between - 1))
        rejected = rejected | ((F.col(name) + mean[name] * strength) / (F.col("n") + strength) > host_limit)
    return per.filter(rejected).select("host")


def measure(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the struct ``_rules`` of its text's counts."""
    return df.withColumn("_rules", rule_counts(F.col(text_col).cast("string")))


def judge(measured: DataFrame, host_col: str = "source", host_limit: float = 0.5) -> DataFrame:
    """A measured table with the booleans ``_base_failed`` and ``_kept``. It
    is read twice, for the hosts and for the documents."""
    bad = stored(rejected_hosts(measured, host_col, host_limit)
                 .select(F.col("host").alias("_bad_host"), F.lit(True).alias("_bad")), "bad-hosts")
    # few hosts are rejected: the planner broadcasts them below its threshold, else both sides are shuffled
    return (measured.join(bad, F.col(host_col).eqNullSafe(F.col("_bad_host")), "left")
            .withColumn("_base_failed", base_failed(F.col("_rules")))
            .withColumn("_kept", ~F.col("_base_failed") & F.col("_bad").isNull())
            .drop("_bad", "_bad_host"))


def keep_documents(df: DataFrame, text_col: str = "text", host_col: str = "source", host_limit: float = 0.5
                   ) -> DataFrame:
    """The rows of ``df`` that pass, with the columns of ``df``. Texts are
    measured once: the counts are stored with the rows that may stay (of
    those that fail by themselves only the counts, for their host)."""
    counts = rule_counts(F.col(text_col).cast("string"))
    measured = df.select(F.struct("*").alias("row"), F.col(host_col).alias("host"), counts.alias("_rules"))
    measured = stored(measured.withColumn("row", F.when(~base_failed(F.col("_rules")), F.col("row"))), "measured")
    return judge(measured, "host", host_limit).filter("_kept").select("row.*")
