"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades: 0 toxic, 1 poor, 2 good. (Toxic is the end of the scale as each toxic
word adds evidence without bound; signs of poor text are shares.) One weight
vector over hashed text features, each free to speak for or against a text,
and ordered thresholds t1 < t2 model

    P(grade <= k) = sigmoid(t_k - score)

A document's expected grade is P(>= 1) + P(>= 2); its tail probability
P(>= 2) decides selection.

Features (64-bit hashes of strings): every distinct word of the whole text,
its first four and five letters, and shares of upper-case, shouted, symbol,
piped, repeated and rare-word text (the usual heuristics of text quality),
coded as the levels they pass.

Fitting uses at most ``max_labelled`` ratings (those of smallest scattered id)
and one text for each rated id (where documents share an id, the text that
sorts first), so at most as many rows, a documented bound like
``max_features``: feature counts by grade are summed in Spark, the features
that tell a lower grade or the best one from the rest (G statistic and log odds
ratio; words that merely come with long texts don't reach it) are kept, and
proximal gradient steps run over the sparse rows they leave. Scoring covers
all documents.

Defined results: a null text has no features; ratings without a quality are
not used, a null toxic counts as 0; repeated ratings count each; without any
usable rating nothing is rejected (tail probability 1, expected grade 2); an
empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import mixed, stored

GRADES = 3
EDGE = ".,;:!?\"'()[]{}«»¿¡"
LEVELS = (0.01, 0.03, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
MEMO = 200_000


def _hash(feature: str) -> int:
    return xxhash.xxh64_intdigest(feature.encode("utf-8", "surrogatepass")) >> 1  # fits a signed long


def word_features(word: str) -> list[int]:
    w = word.strip(EDGE)
    return [_hash(x) for x in ([f"w {w}"] if w else []) + [f"{k} {w[:k]}" for k in (4, 5) if len(w) >= k]]


def share_features(text: str, words: list[str], distinct: int) -> list[int]:
    n = len(words)
    if not n:
        return []
    shares = {"upper": sum(map(str.isupper, words)) / n, "shout": text.count("!!") / n,
              "symbol": sum(map(text.count, "#$%&*<>")) / n, "pipe": text.count("|") / n,
              "repeat": sum(map(eq, words, words[1:])) / n, "same": (1 - distinct / n) if n >= 20 else 0}
    return [_hash(f"{name} {level}") for name, share in shares.items() for level in LEVELS if share >= level]


def _split(text: str) -> tuple[list[str], set[str]]:
    words = text.split()
    return words, set(text.lower().split())


@dataclass
class OrdinalModel:
    weights: dict[int, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = (-math.inf, -math.inf)

    def scorer(self):
        memo: dict[str, float] = {}
        get = self.weights.get

        def score(text: str | None) -> float:
            if not text:
                return 0.0
            words, distinct = _split(text)
            if len(memo) > MEMO:
                memo.clear()
            total = 0.0
            for w in distinct:
                v = memo.get(w)
                if v is None:
                    v = memo[w] = math.fsum(get(h, 0.0) for h in word_features(w))
                if v:
                    total += v
            return total + math.fsum(get(h, 0.0) for h in share_features(text, words, len(distinct)))

        return score

    def tails(self, score: np.ndarray) -> list[np.ndarray]:
        """P(grade >= 1), P(grade >= 2)."""
        return [1 / (1 + np.exp(np.clip(t - score, -500, 500))) if math.isfinite(t) else np.ones_like(score)
                for t in self.thresholds]


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        ids = []
        for text in b["text"]:
            words, distinct = _split(text) if text else ([], set())
            ids.append([h for w in distinct for h in word_features(w)]
                       + share_features(text or "", words, len(distinct)))
        yield pd.DataFrame({"row": b["row"], "grade": b["grade"], "features": ids})


def likelihood(w: np.ndarray, theta: np.ndarray, at: np.ndarray, which: np.ndarray, grades: np.ndarray
               ) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood of the cumulative logits over sparse rows
    (row ``at[i]`` has feature ``which[i]``), and its gradients."""
    n, rows = len(grades), np.arange(len(grades))
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    score = np.bincount(at, weights=w[which], minlength=n)
    s = sig(np.vstack([np.full(n, -np.inf), theta[0] - score, theta[1] - score, np.full(n, np.inf)]))
    low, high = s[grades, rows], s[grades + 1, rows]
    p = np.maximum(high - low, 1e-9)
    d_w = np.bincount(which, weights=((1 - high - low) / n)[at], minlength=len(w))
    d_theta = np.array([((grades == k + 1) * s[k + 1] * (1 - s[k + 1]) / p
                         - (grades == k) * s[k + 1] * (1 - s[k + 1]) / p).sum() / n for k in range(2)])
    return float(-np.log(p).mean()), d_w, d_theta


def _fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, n_features: int, steps: int, l1: float, l2: float
                 ) -> tuple[np.ndarray, np.ndarray]:
    """Proximal gradient with per-coordinate steps on the cumulative logits."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    which = np.concatenate(rows).astype(np.int64) if len(at) else np.zeros(0, dtype=np.int64)
    upto = np.clip(np.cumsum(np.bincount(grades, minlength=GRADES))[:-1] / len(rows), 1e-3, 1 - 1e-3)
    theta = np.log(upto / (1 - upto))
    theta[1] = max(theta[1], theta[0] + 1e-2)
    w, g2 = np.zeros(n_features), np.full(n_features, 1e-8)
    t2 = np.full(2, 1e-8)
    for _ in range(steps):
        _, grad, d_theta = likelihood(w, theta, at, which, grades)
        grad = grad + l2 * w
        g2 += grad * grad
        t2 += d_theta * d_theta
        rate = 0.3 / np.sqrt(g2)
        w = w - rate * grad
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
        theta = theta - 0.3 / np.sqrt(t2) * d_theta
        theta[1] = max(theta[1], theta[0] + 1e-3)
    return w, theta


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id",
        max_labelled: int = 16_384, max_features: int = 8_192, min_rows: int = 3,
        min_log_odds: float = 1.5, steps: int = 800, l1: float = 1e-4, l2: float = 1e-6) -> OrdinalModel:
    grade = F.when(F.coalesce(F.col("toxic"), F.lit(0)) > 0, 0).when(F.col("quality") < 1, 1).otherwise(GRADES - 1)
    rated = (labels.filter(F.col("quality").isNotNull() & F.col(label_id_col).isNotNull())
             .select(F.col(label_id_col).alias("_rated"), grade.alias("grade"))
             .orderBy(mixed(label_id_col), "_rated", "grade").limit(max_labelled))
    rated = stored(rated, "rated")  # at most max_labelled narrow rows
    asked = rated.select("_rated").distinct()
    # a null text sorts before all others
    first = F.min(F.struct(F.col(text_col).cast("string").alias("text"))).alias("t")
    texts = (docs.join(asked, docs[id_col] == asked["_rated"]).groupBy("_rated").agg(first)
             .select("_rated", F.col("t.text").alias("text")))
    found = stored(texts.join(rated, "_rated")
                   .select(F.xxhash64("_rated", "grade").alias("row"), "grade", "text")
                   .mapInPandas(_features, "row long, grade int, features array<long>"), "rated-features")
    totals = {r.grade: r.n for r in found.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals:
        return OrdinalModel()
    n = sum(totals.values())

    def g_statistic(count: Column, by_grade: list[Column]) -> Column:
        """2 * sum(observed * ln(observed / expected)) over has/has not and grade."""
        total = F.lit(0.0)
        for g, c in enumerate(by_grade):
            share = totals.get(g, 0) / n
            for seen, all_seen in ((c, count), (F.lit(totals.get(g, 0)) - c, F.lit(n) - count)):
                expected = all_seen * share
                total = total + F.when((seen > 0) & (expected > 0), seen * F.log(seen / expected)).otherwise(0.0)
        return 2 * total

    def log_odds(count: Column, by_grade: list[Column]) -> list[Column]:
        """How much likelier the feature is in each grade than elsewhere."""
        ratios = []
        for g, c in enumerate(by_grade):
            of, rest = totals.get(g, 0), n - totals.get(g, 0)
            other = count - c
            ratios.append(F.log((c + 0.5) * (F.lit(rest) - other + 0.5) / ((F.lit(of) - c + 0.5) * (other + 0.5))))
        return ratios

    each = found.select("grade", F.explode(F.array_distinct("features")).alias("feature"))
    counts = each.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum((F.col("grade") == g).cast("long")).alias(f"n{g}") for g in range(GRADES)])
    by_grade = [F.col(f"n{k}") for k in range(GRADES)]
    # good texts are the most, so more must speak for a feature of theirs
    *lower, best = log_odds(F.col("n"), by_grade)
    best = [r.feature for r in counts.filter(F.col("n") >= min_rows)
            .withColumn("g", g_statistic(F.col("n"), by_grade))
            .filter(((F.col("g") > 12) & (F.greatest(*lower) >= min_log_odds)) | ((F.col("g") > 20) & (best >= min_log_odds)))
            .orderBy(F.desc("g"), "feature").limit(max_features).select("feature").collect()]
    place = {f: i for i, f in enumerate(best)}

    def keep_best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            kept = [np.array([place[f] for f in row if f in place], dtype=np.int32).tobytes()
                    for row in b["features"]]
            yield pd.DataFrame({"row": b["row"], "grade": b["grade"], "places": kept})

    # at most max_labelled rows
    rows = found.mapInPandas(keep_best, "row long, grade int, places binary").orderBy("row", "grade", "places").toPandas()
    w, theta = _fit_ordinal([np.frombuffer(p, dtype=np.int32) for p in rows["places"]],
                            rows["grade"].to_numpy(dtype=np.int64), len(best), steps, l1, l2)
    return OrdinalModel({f: float(x) for f, x in zip(best, w, strict=True) if x}, tuple(map(float, theta)))


def rating(text: Column, model: OrdinalModel, min_tail: float = 0.5) -> Column:
    """Struct of a text: score, expected_grade, tail_probability, kept."""
    kinds = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("expected_grade", T.DoubleType()),
                          T.StructField("tail_probability", T.DoubleType()), T.StructField("kept", T.BooleanType())])

    @F.pandas_udf(kinds)
    def rate(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        of = model.scorer()
        for batch in texts:
            s = np.array([of(t) for t in batch], dtype=float)
            one, two = model.tails(s)
            yield pd.DataFrame({"score": s, "expected_grade": one + two, "tail_probability": two,
                                "kept": two >= min_tail})

    return rate(text.cast("string"))


def keep_documents(docs: DataFrame, labels: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that the classifier selects, with its columns."""
    model = fit(docs, labels, text_col=text_col, **options)
    return (docs.select(F.struct("*").alias("row"), rating(F.col(text_col), model).alias("rated"))
            .filter("rated.kept").select("row.*"))
