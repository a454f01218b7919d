"""Approximate nearest neighbours by learned partitions.

Fitting, on at most ``sample`` vectors (those of smallest scattered id, a
documented bound): their k-nearest-neighbour graph is partitioned into parts
of nearly equal size (principal-axis halving, then label propagation that
keeps a size limit), and a small softmax classifier learns, for a vector,
the share of its neighbours in each part.

Index: every vector belongs to its most probable part. Search: a query opens
its most probable parts until their probabilities add up to the router's
``mass``, the least with which the sample's queries meet ``coverage`` of their
neighbours (a sure query so opens few parts, an unsure one many), and at
least as many as hold ``k`` other vectors; it is reranked there by exact
double-precision distances. A part of any size is cut into blocks of rows, and
the queries that ask it into blocks of queries; each pair of blocks gives its
nearest rows, and the best of all are the result: no cap on candidates, a part
with a third of all rows is many tasks, and a part is copied only for blocks
of queries that ask it. ``coverage=1`` opens all parts: exact search.

Vectors are scaled by a power of two before squares are taken, so any finite
size takes part; the distances returned are those of the vectors as given.

Defined results: null, zero or non-finite vectors, vectors with null
components, null ids, and vectors whose length is not that of most vectors
take no part; ties go to the smaller id; a row is no candidate for a query
of its own id; repeated rows are candidates each; rows of one id that ask
are one query, whose distance to a candidate is the smallest over their
vectors; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import mixed, stored

BLOCK, QUERY_BLOCK, TILE = 16_384, 65_536, 128
ROWS_PER_PART, MIN_PARTS, MAX_PARTS = 400, 4, 256


def _nearest(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest other rows of each row."""
    k = min(k, len(x) - 1)
    norm = (x * x).sum(axis=1)
    out = np.empty((len(x), k), dtype=np.int64)
    for a in range(0, len(x), 512):
        d = norm[None, :] - 2 * (x[a:a + 512] @ x.T)
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        out[a:a + len(d)] = np.argpartition(d, k - 1, axis=1)[:, :k] if k else 0
    return out


def _halves(x: np.ndarray, rows: np.ndarray, parts: int, first: int, out: np.ndarray) -> None:
    """Equal parts by cutting along the principal axis, again and again."""
    if parts == 1:
        out[rows] = first
        return
    left = parts // 2
    y = x[rows] - x[rows].mean(axis=0)
    axis = np.linalg.eigh(y.T @ y)[1][:, -1]
    order = rows[np.argsort(y @ axis, kind="stable")]
    cut = len(rows) * left // parts
    _halves(x, order[:cut], left, first, out)
    _halves(x, order[cut:], parts - left, first + left, out)


def partition_graph(x: np.ndarray, near: np.ndarray, parts: int, sweeps: int = 12, slack: float = 1.1) -> np.ndarray:
    """A part for each row: neighbours together, sizes within ``slack``."""
    label = np.zeros(len(x), dtype=np.int64)
    _halves(x, np.arange(len(x)), parts, 0, label)
    limit = max(1, int(np.ceil(len(x) / parts * slack)))
    size = np.bincount(label, minlength=parts)
    n, k = near.shape
    # the graph both ways
    ends = np.concatenate([np.repeat(np.arange(n), k), near.ravel()])
    other = np.concatenate([near.ravel(), np.repeat(np.arange(n), k)])
    for _ in range(sweeps):
        votes = np.zeros((n, parts), dtype=np.int32)
        np.add.at(votes, (ends, label[other]), 1)
        wish = votes.argmax(axis=1)
        gain = votes[np.arange(n), wish] - votes[np.arange(n), label]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[wish[i]] < limit:
                size[label[i]] -= 1
                size[wish[i]] += 1
                label[i] = wish[i]
                moved += 1
        if not moved:
            break
    return label


@dataclass
class Router:
    """Softmax classifier of parts, and how much probability a query opens."""
    center: np.ndarray
    scale: float
    weights: np.ndarray
    bias: np.ndarray
    mass: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.center) / self.scale) @ self.weights + self.bias

    def ranked(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts from the most probable on, and the mass of those before each."""
        y = self.logits(x)
        order = np.argsort(-y, axis=1, kind="stable")
        p = np.exp(np.take_along_axis(y, order, axis=1) - y.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return order, np.cumsum(p, axis=1) - p


def fit_router(x: np.ndarray, parts: int, neighbours: int = 10, coverage: float = 0.97, steps: int = 150) -> Router:
    x = x.astype(np.float64)
    center, n, d = x.mean(axis=0), len(x), x.shape[1]
    scale = float(np.sqrt(((x - center) ** 2).mean())) or 1.0
    near = _nearest(x, neighbours)
    label = partition_graph(x, near, parts) if near.shape[1] else np.zeros(n, dtype=np.int64)
    target = np.zeros((n, parts))
    target[np.arange(n), label] = 1
    np.add.at(target, (np.repeat(np.arange(n), near.shape[1]), label[near].ravel()), 1)
    target /= target.sum(axis=1, keepdims=True)
    z = (x - center) / scale
    w, b = np.zeros((d, parts)), np.zeros(parts)
    m = [np.zeros_like(w), np.zeros_like(b)]
    v = [np.zeros_like(w), np.zeros_like(b)]
    for step in range(1, steps + 1):  # Adam on the cross entropy
        y = z @ w + b
        p = np.exp(y - y.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = (p - target) / n
        for i, (param, grad) in enumerate(((w, z.T @ g + 1e-5 * w), (b, g.sum(axis=0)))):
            m[i] = 0.9 * m[i] + 0.1 * grad
            v[i] = 0.999 * v[i] + 0.001 * grad * grad
            param -= 0.1 * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-9)
    router = Router(center, scale, w, b, np.inf)
    if near.shape[1] and coverage < 1:
        # the mass before the part that each neighbour was given
        own, (order, before) = router.logits(x).argmax(axis=1), router.ranked(x)
        rank = np.argsort(order, axis=1)
        needed = np.sort(np.take_along_axis(before, np.take_along_axis(rank, own[near], axis=1), axis=1).ravel())
        router.mass = float(np.nextafter(needed[min(len(needed), int(np.ceil(coverage * len(needed)))) - 1], np.inf))
    return router


def usable(vector: Column) -> Column:
    return (F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
            & F.exists(vector, lambda v: v != 0))


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances; scaled where plain squares leave a double's range."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore", divide="ignore"):
        d = x - q
        plain = np.sqrt((d * d).sum(axis=1))
        odd = ~(np.isfinite(plain) & (plain > 1e-150))
        if odd.any():
            top = np.abs(d[odd]).max(axis=1)
            rest = np.sqrt(((d[odd] / top[:, None]) ** 2).sum(axis=1))
            plain[odd] = np.where(top == 0, 0.0, np.where(np.isfinite(top), top * rest, np.inf))
    return plain


def _block_search(rows: pd.DataFrame, queries: pd.DataFrame, k: int, shift: int) -> pd.DataFrame:
    """The k nearest rows of a block for each query routed to it, over all
    vectors of the query."""
    if rows.empty or queries.empty:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    x, ids = np.vstack(rows["vector"].to_numpy()).astype(np.float64), rows["vec_id"].to_numpy()
    q, asked = np.vstack(queries["vector"].to_numpy()).astype(np.float64), queries["query_id"].to_numpy()
    xs, qs = np.ldexp(x, shift), np.ldexp(q, shift)
    norm, found = (xs * xs).sum(axis=1), []
    for a in range(0, len(q), TILE):
        tile, own = qs[a:a + TILE], asked[a:a + TILE]
        size = (tile * tile).sum(axis=1)
        d = norm[None, :] + size[:, None] - 2 * (tile @ xs.T)
        other = own[:, None] != ids[None, :]
        d[~other] = np.inf
        far = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
        # the product's rounding is far below this margin; distances proper decide
        near = other & (d <= (far + 1e-9 * (size + norm.max()))[:, None])
        for i in range(len(tile)):
            at = np.flatnonzero(near[i])
            score = distances(x[at], q[a + i])
            best = np.lexsort((ids[at], score))[:k]
            found.append((np.full(len(best), own[i]), ids[at][best], score[best], at[best]))
    if not found:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    out = pd.DataFrame(dict(zip(("query_id", "vec_id", "score", "row"), map(np.concatenate, zip(*found)), strict=True)))
    if len(np.unique(asked)) < len(asked):
        # a row counts once for a query, at its smallest distance
        out = (out.sort_values(["query_id", "score", "vec_id", "row"]).drop_duplicates(["query_id", "row"])
               .groupby("query_id").head(k))
    return out.drop(columns="row")


def search(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10,
           sample: int = 8_192, coverage: float = 0.95, parts: int | None = None, stats: dict | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query row of ``df``
    its k nearest other rows found. ``stats``, if given, receives the number
    of parts and the share of all rows that a query opens."""
    spark = df.sparkSession
    result = "query_id long, rank int, vec_id long, score double"
    read = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"),
                     is_query.alias("asks")).filter(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    top = F.array_max(F.transform("vector", lambda v: F.abs(v.cast("double"))))
    sizes = (read.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("count"), F.max(top).alias("top"))
             .orderBy(F.desc("count"), "d").first())
    if sizes is None:
        return spark.createDataFrame([], result)
    read, shift = read.filter(F.size("vector") == sizes["d"]), -int(np.frexp(sizes["top"])[1])
    seen = read.select("vec_id", "vector").orderBy(mixed("vec_id"), "vec_id", "vector").limit(sample).collect()  # bounded
    parts = parts or min(MAX_PARTS, max(MIN_PARTS, sizes["count"] // ROWS_PER_PART))
    parts = min(parts, len(seen))
    router = fit_router(np.ldexp(np.array([r.vector for r in seen], dtype=np.float64), shift), parts, k, coverage)

    @F.pandas_udf("int")
    def part_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield (pd.Series(router.logits(np.ldexp(np.vstack(batch.to_numpy()).astype(np.float64), shift)).argmax(axis=1))
                   if len(batch) else pd.Series([], dtype="int32"))

    indexed = stored(read.withColumn("part", part_of("vector")), "ann-index")
    held = {r.part: r["count"] for r in indexed.groupBy("part").count().collect()}  # at most `parts` rows
    counts = np.array([held.get(p, 0) for p in range(parts)])

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def route(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            if not len(batch):
                yield pd.Series([], dtype=object)
                continue
            order, before = router.ranked(np.ldexp(np.vstack(batch.to_numpy()).astype(np.float64), shift))
            enough = (np.cumsum(counts[order], axis=1) > k).argmax(axis=1) + 1
            enough[counts.sum() <= k] = parts
            opened = np.maximum((before < router.mass).sum(axis=1), enough)
            yield pd.Series([[int(p) for p in o[:n] if counts[p]] for o, n in zip(order, opened, strict=True)], dtype=object)

    routed = stored(indexed.filter("asks").select(F.col("vec_id").alias("query_id"), "vector").distinct()
                    .select("query_id", "vector", route("vector").alias("to")), "ann-queries")
    asked = {r.part: r["count"] for r in routed.select(F.explode("to").alias("part")).groupBy("part").count().collect()}
    if stats is not None:
        opened = sum(int(counts[p]) * n for p, n in asked.items())
        stats |= {"parts": parts, "opened": opened / max(1, int(counts.sum()) * routed.count())}
    # a part's rows and the queries that ask it, each in blocks
    per_part = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("part") + 1)
    row_blocks = per_part(np.maximum(1, -(-counts // BLOCK)))
    query_blocks = per_part([-(-asked.get(p, 0) // QUERY_BLOCK) for p in range(parts)])
    rows = (indexed.withColumn("block", F.pmod(mixed("vec_id"), row_blocks).cast("int"))
            .withColumn("asked", query_blocks).filter("asked > 0")
            .withColumn("asked", F.explode(F.sequence(F.lit(0), F.col("asked") - 1)))
            .select("part", "block", "asked", "vec_id", "vector"))
    queries = (routed.select("query_id", "vector", F.explode("to").alias("part"))
               .withColumn("asked", F.pmod(mixed("query_id"), query_blocks).cast("int"))
               .withColumn("block", F.explode(F.sequence(F.lit(0), row_blocks - 1)))
               .select("part", "block", "asked", "query_id", "vector"))
    keys = ("part", "block", "asked")

    def run(key, left, right):
        return _block_search(left, right, k, shift)

    found = (rows.groupBy(*keys).cogroup(queries.groupBy(*keys))
             .applyInPandas(run, "query_id long, vec_id long, score double"))
    # a query has at most k rows from each of its blocks
    best = (found.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "vec_id"))), 1, k)
                                          .alias("best"))
            .select("query_id", F.posexplode("best").alias("at", "b")))
    return best.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"),
                       F.col("b.score").alias("score"))


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact neighbours that were found (both results of ``search``)."""
    wanted = exact.select("query_id", "vec_id", F.lit(1).alias("w"))
    met = wanted.join(found.select("query_id", "vec_id", F.lit(1).alias("f")), ["query_id", "vec_id"], "left")
    return met.agg(F.count("f") / F.count("w")).first()[0]
