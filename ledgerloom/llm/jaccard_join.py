"""N-gram Jaccard join by a token-group matrix.

Documents are sets of word shingles; two link when their Jaccard similarity
reaches ``percent``. The result is one row per document with the smallest
document it reaches, complete for all pairs, without writing pairs of copies.

1. Sets. A task hashes the shingles of whole texts. Equal sets are one class.
   Shingles are looked up by rising hash, but the ``HOT`` most frequent in
   the corpus come last: those of the lower half of the hashes are counted
   over all documents, the others where two sets of a batch share them. The
   order changes cost, not results.
2. Groups. Classes that agree in a pair of minimum hashes are compared with
   one of them, and linked if they reach the similarity; what links so, at
   linear cost, is a group. Most documents are groups of one.
3. Matrix. Rows (shingle, group) hold each group's union, cut to what a
   qualifying partner must share: of a set of n, the n - ceil(0.75 n) + 1
   first shingles in the common order, a frequent one only where enough
   follows it to be the first in common. The groups of a shingle look only at
   those of a size that fits; a long run of them is dealt out in blocks. A pair of groups that shares c of
   these has at most c + (what is left of the larger) in common; pairs below
   the needed overlap are not opened. Sets that are frequent shingles for the
   most part meet only where such a shingle can be their first in common.
4. Qualifying groups are opened: first one document of each against the
   other (enough where groups are single), then, for groups still apart, the
   documents of the smaller ask the other's, dealt out in blocks. Texts are
   compared exactly by their sets.

Shingles are 64-bit hashes: two of one pair of documents collide with a
chance below 1e-12 at a million shingles.

Defined results: a null or empty text, or one without words, has an empty
set and links with nothing; fewer words than a shingle make one shingle of
all; rows of one id are one document; a null id is a document by its text
and its component is the smallest id it reaches, null if it reaches none;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import arrow_rows, components, id_filter, split_by_filter, stored

SHINGLE, PERCENT = 5, 75
KEYS, HOT, HOT_MIN = 6, 262_144, 16
SLICE = 4 << 20
#: Frequencies are counted for buckets of shingles (their first 44 bits), of all shingles below LOW: the first
#: quarter of a set by hash lies there unless more than half of it is frequent.
BUCKET, LOW = np.uint64(20), np.uint64(1 << 63)
BLOCK, ASKING = 256, 512
NULL_ID = 1 << 62
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93,
                               0xA0761D6478BD642F)]


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    coded = lists.flatten().dictionary_encode()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    words = coded.dictionary.to_pylist()
    which = coded.indices.to_numpy(zero_copy_only=False)
    hashes = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], dtype=np.uint64)
    real = np.array([w != "" for w in words], dtype=bool)[which] if len(words) else np.zeros(0, dtype=bool)
    upto = np.concatenate([[0], np.cumsum(real)])
    offsets, w = upto[offsets], hashes[which[real]] if len(words) else np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        n = max(0, len(w) - SHINGLE + 1)
        grams = np.full(n, _MIX[0], dtype=np.uint64)
        for k in range(SHINGLE):  # the order of words counts
            grams = grams * _MIX[3] + w[k:n + k]
        grams = _scramble(grams)
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            if b - a >= SHINGLE:
                yield np.unique(grams[a:b - SHINGLE + 1])
            elif b > a:
                whole = np.full(1, _MIX[4] + np.uint64(b - a), dtype=np.uint64)
                for x in w[a:b]:
                    whole = _scramble(whole * _MIX[3] + x)
                yield whole
            else:
                yield w[:0]


def slices(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text: what a task holds at once
    doesn't depend on the size of a batch."""
    upto = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    begin = 0
    while begin < len(upto):
        past = upto[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(upto, past + limit, side="right")))
        yield begin, end
        begin = end


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


_SIGNS = T.StructType([T.StructField("node", T.LongType()), T.StructField("class", T.BinaryType()),
                       T.StructField("n", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())),
                       T.StructField("often", T.LongType()), T.StructField("times", T.LongType())])


def _signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document its class, set size and minimum hashes; per batch also
    the shingles from LOW on that two or more of its sets hold (``often``,
    ``times``)."""
    names = ["node", "class", "n", "keys", "often", "times"]
    none = pa.nulls
    seeds = [np.uint64((i * 0x9E3779B97F4A7C15 + 0x1234566) % 2**64 | 1) for i in range(1, 2 * KEYS + 1)]
    for batch in batches:
        met = []
        for begin, end in slices(batch.column("text")):
            sets = list(shingle_sets(batch.column("text").slice(begin, end - begin)))
            sizes = np.array([len(x) for x in sets], dtype=np.int64)
            n, full = len(sets), np.flatnonzero(sizes)
            flat = np.concatenate(sets) if n else np.zeros(0, dtype=np.uint64)
            keys: list = [[]] * n
            if len(full) and KEYS:
                first = np.concatenate([[0], np.cumsum(sizes[full])])[:-1]
                with np.errstate(over="ignore"):
                    least = np.array([np.minimum.reduceat(flat * seed, first) for seed in seeds])
                    pairs = _scramble(least[0::2] * _MIX[3] + least[1::2]).view(np.int64).T.tolist()
                for i, k in zip(full, pairs, strict=True):
                    keys[i] = k
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").slice(begin, n),
                 pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()), pa.array(sizes),
                 pa.array(keys, pa.list_(pa.int64())), none(n, pa.int64()), none(n, pa.int64())], names=names)
            met.append(flat[flat >= LOW])
        if met:
            seen, times = np.unique(np.concatenate(met) >> BUCKET, return_counts=True)
            seen, times = seen[times > 1], times[times > 1]
            m = len(seen)
            yield pa.RecordBatch.from_arrays(
                [none(m, pa.int64()), none(m, pa.binary()), none(m, pa.int64()), none(m, pa.list_(pa.int64())),
                 pa.array(seen.view(np.int64)), pa.array(times.astype(np.int64))], names=names)


_ROW = ("shingle", "label", "node", "n", "rest", "hots")
ALL = 1 << 40


def _low_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many sets hold shingles of a bucket, for those below LOW."""
    for batch in batches:
        for begin, end in slices(batch.column("text")):
            low = [s[:np.searchsorted(s, LOW)] for s in shingle_sets(batch.column("text").slice(begin, end - begin))]
            seen, times = np.unique(np.concatenate(low) >> BUCKET, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64)), pa.array(times.astype(np.int64))],
                                             names=["often", "times"])


def _matrix_rows(hot: np.ndarray):
    """Rows of the matrix: the first shingles of each set in the common
    order, by hash, the hot ones (by rising count) last. ``rest``: how many
    shingles of the set follow a hot one, itself included (ALL for others);
    ``hots``: how many of the first ones are hot."""
    by_value = np.argsort(hot)
    values = hot[by_value]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, node = batch.column("label").to_numpy(), batch.column("node").to_numpy()
            for begin, end in slices(batch.column("text")):
                found, at, sizes, hots, rests = [], [], [], [], []
                for i, s in enumerate(shingle_sets(batch.column("text").slice(begin, end - begin)), begin):
                    n = len(s)
                    if not n:
                        continue
                    first, plain = n - -(-PERCENT * n // 100) + 1, n
                    if len(values):
                        bucket = s >> BUCKET
                        place = np.minimum(np.searchsorted(values, bucket), len(values) - 1)
                        is_hot = values[place] == bucket
                        if is_hot.any():
                            late = np.argsort(by_value[place[is_hot]], kind="stable")
                            s = np.concatenate([s[~is_hot], s[is_hot][late]])
                            plain -= len(late)
                    rest = np.full(first, ALL, dtype=np.int64)
                    rest[plain:] = np.arange(n, n - first, -1)[plain:]
                    # a hot one behind which too little is left for any partner leads to no pair
                    can = rest >= shared_least(n, -(-PERCENT * n // 100))
                    if not can.any():
                        continue
                    found.append(s[:first][can])
                    rests.append(rest[can])
                    at.append(i)
                    sizes.append(n)
                    hots.append(max(0, first - plain))
                if found:
                    firsts = [len(f) for f in found]
                    at = np.repeat(at, firsts)
                    each = lambda x: pa.array(np.repeat(np.array(x, dtype=np.int64), firsts))  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(found).view(np.int64)), pa.array(group[at]), pa.array(node[at]),
                         each(sizes), pa.array(np.concatenate(rests)), each(hots)], names=list(_ROW))
    return run


_PAIR = ("a", "b", "shared", "hots", "node_a", "node_b", "low_a", "low_b", "high")
_LONG = ("shingle", "label", "node", "low", "high", "follow", "hots")
_FLUSH = 500_000
#: A run of a shingle with more rows, or more pairs to look at, is dealt out in cells of about 2 * RUN_BLOCK rows.
RUN_ROWS, RUN_PAIRS, RUN_BLOCK = 65_536, 1 << 24, 8_192


def shared_least(n, m):
    """How much sets of these sizes must share to link."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


class _Pairs:
    """Pairs of groups of a run, and how much they share; counted before they
    leave.

    ``shared`` counts the shingles that aren't hot. A hot one makes a pair only
    if it can be the first that the two have in common, that is, if what
    follows it in both sets suffices; ``hots`` bounds how many hot ones they
    can share."""

    def __init__(self) -> None:
        self.made: list[np.ndarray] = []  # rows of _PAIR

    def counted(self) -> pa.RecordBatch:
        p = np.concatenate(self.made, axis=1)
        self.made.clear()
        p = p[:, np.lexsort((p[1], p[0]))]
        first = np.flatnonzero(np.concatenate([[True], (p[0, 1:] != p[0, :-1]) | (p[1, 1:] != p[1, :-1])]))
        how = (np.minimum, np.minimum, np.add, np.maximum, np.minimum, np.minimum, np.minimum, np.minimum, np.maximum)
        columns = [pa.array(f.reduceat(c, first)) for f, c in zip(how, p, strict=True)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.zeros(len(first), dtype=np.int64))], names=[*_PAIR, "long"])

    def windows(self, run: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rows in order of (run, least size): where the partners of each
        end. Beyond, a partner is too large for what this one has, or for what
        follows the shingle in it."""
        low, high, follow = g[3], g[4], g[5]
        reach = np.minimum(100 * high // PERCENT, (100 + PERCENT) * follow // PERCENT - low)
        wide = int(low.max()) + 2
        end = np.searchsorted(run * wide + low, run * wide + np.clip(reach, -1, wide - 1), side="right")
        return end, np.maximum(end - np.arange(len(run)) - 1, 0)

    def add(self, run: np.ndarray, g: np.ndarray, end: np.ndarray, times: np.ndarray, block: np.ndarray | None = None
            ) -> Iterator[pa.RecordBatch]:
        """Pairs within the windows; of two different blocks only, if given
        (-1: of any)."""
        _, label, node, low, high, follow, hots = g
        plain = (follow == ALL).astype(np.int64)
        upto = np.cumsum(times)
        at = 0
        while at < len(times):
            past = int(upto[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(upto, past + _FLUSH, side="right")))
            i = np.repeat(np.arange(at, to), times[at:to])
            j = i + 1 + np.arange(len(i)) - np.repeat(upto[at:to] - times[at:to] - past, times[at:to])
            fits = np.minimum(follow[i], follow[j]) >= shared_least(low[i], low[j])
            if block is not None:
                fits &= (block[i] != block[j]) | (block[i] < 0)
            i, j = i[fits], j[fits]
            if len(i):
                x, y = np.where(label[i] <= label[j], i, j), np.where(label[i] <= label[j], j, i)
                self.made.append(np.array([label[x], label[y], plain[x], np.minimum(hots[x], hots[y]), node[x], node[y],
                                           low[x], low[y], np.maximum(high[x], high[y])]))
                if sum(m.shape[1] for m in self.made) > _FLUSH:
                    yield self.counted()
            at = to


def _group_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of groups that share shingles (``_Pairs``); rows come sorted by
    shingle and group. Within a run of one shingle the groups are put in order
    of size, so a group looks only at those that it could link with. The rows
    of a run that is long all the same leave as they are (``long``)."""
    pairs, rest, leaving = _Pairs(), np.zeros((len(_ROW), 0), dtype=np.int64), None

    def long_rows(g: np.ndarray) -> pa.RecordBatch:
        shingle, label, node, low, high, follow, hots = map(pa.array, g)
        none = pa.array(np.zeros(g.shape[1], dtype=np.int64))
        return pa.RecordBatch.from_arrays([shingle, label, follow, hots, node, none, low, none, high,
                                           pa.array(np.ones(g.shape[1], dtype=np.int64))], names=[*_PAIR, "long"])

    def pair(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if rows.shape[1] < 2:
            return
        same = rows[0, 1:] == rows[0, :-1]
        rows = rows[:, np.concatenate([same, [False]]) | np.concatenate([[False], same])]
        if not rows.shape[1]:
            return
        # one row for each shingle and group: its smallest node, its least and greatest set
        first = np.flatnonzero(np.concatenate([[True], (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])]))
        g = np.array([rows[0, first], rows[1, first], np.minimum.reduceat(rows[2], first), np.minimum.reduceat(rows[3], first),
                      np.maximum.reduceat(rows[3], first), np.maximum.reduceat(rows[4], first),
                      np.maximum.reduceat(rows[5], first)])
        run = np.concatenate([[0], np.cumsum(g[0, 1:] != g[0, :-1])])
        order = np.lexsort((g[3], run))
        g = g[:, order]
        end, times = pairs.windows(run, g)
        long = np.bincount(run, weights=times) > RUN_PAIRS
        if long.any():
            yield long_rows(g[:, long[run]])
            times = np.where(long[run], 0, times)
        yield from pairs.add(run, g, end, times)

    for batch in batches:
        new = np.array([batch.column(c).to_numpy() for c in _ROW], dtype=np.int64)
        if leaving is not None and new.shape[1]:
            n = int(np.searchsorted(new[0], leaving, side="right"))
            if n:
                yield long_rows(np.array([*new[:4, :n], new[3, :n], *new[4:, :n]]))
                new = new[:, n:]
            leaving = None if new.shape[1] else leaving
        rows = np.concatenate([rest, new], axis=1)
        if not rows.shape[1]:
            continue
        cut = int(np.searchsorted(rows[0], rows[0, -1]))  # the last shingle may go on
        yield from pair(rows[:, :cut])
        rest = rows[:, cut:]
        if rest.shape[1] > RUN_ROWS:
            yield long_rows(np.array([*rest[:4], rest[3], *rest[4:]]))
            leaving, rest = int(rest[0, 0]), rest[:, :0]
    yield from pair(rest)
    if pairs.made:
        yield pairs.counted()


_CELL = (*_LONG, "x", "y", "block")


def _cell_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs within the cells of long runs; rows come sorted by (shingle, x, y)."""
    pairs, rest = _Pairs(), np.zeros((len(_CELL), 0), dtype=np.int64)

    def pair(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if rows.shape[1] < 2:
            return
        at = rows[[0, 7, 8]]
        run = np.concatenate([[0], np.cumsum((at[:, 1:] != at[:, :-1]).any(axis=0))])
        order = np.lexsort((rows[3], run))
        rows, run = rows[:, order], run[order]
        end, times = pairs.windows(run, rows)
        # on the diagonal all pairs, elsewhere those of two blocks
        yield from pairs.add(run, rows[:7], end, times, np.where(rows[7] == rows[8], -1, rows[9]))

    for batch in batches:
        rows = np.concatenate([rest, np.array([batch.column(c).to_numpy() for c in _CELL], dtype=np.int64)], axis=1)
        if not rows.shape[1]:
            continue
        goes_on = (rows[[0, 7, 8]] == rows[[0, 7, 8], -1][:, None]).all(axis=0)
        cut = int(goes_on.argmax())
        yield from pair(rows[:, :cut])
        rest = rows[:, cut:]
    yield from pair(rest)
    if pairs.made:
        yield pairs.counted()


def _long_runs(left: DataFrame) -> DataFrame:
    """Pairs of the runs that no task is to pair alone: the groups of a run are
    dealt into blocks, and each pair of blocks is a cell."""
    one = stored(left.groupBy("shingle", "label").agg(
        F.min("node").alias("node"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("follow").alias("follow"),
        F.max("hots").alias("hots")), "long-runs")
    sizes = stored(one.groupBy("shingle").agg(F.ceil(F.count(F.lit(1)) / RUN_BLOCK).cast("int").alias("blocks")), "run-blocks")
    dealt = (one.join(sizes, "shingle").withColumn("block", F.pmod(F.xxhash64("label"), F.col("blocks")))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - F.lit(1).cast("long"))))
             .select(*_LONG, F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block"))
    cells = dealt.repartition("shingle", "x", "y").sortWithinPartitions("shingle", "x", "y")
    return cells.mapInArrow(_cell_pairs, ", ".join(f"{c} long" for c in (*_PAIR, "long"))).drop("long")


@F.arrow_udf(T.BooleanType())
def _texts_linked(left: pa.Array, right: pa.Array) -> pa.Array:
    out = []
    for begin, end in slices(left):
        n = end - begin
        out.extend(linked(a, b) for a, b in zip(shingle_sets(left.slice(begin, n)), shingle_sets(right.slice(begin, n)),
                                                strict=True))
    return pa.array(out, pa.bool_())


def _verify(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose texts link. ``docs``: node, text."""
    pairs = stored(pairs, "pairs")
    if pairs.isEmpty():
        return pairs
    nodes = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "pair-nodes")
    maybe, _ = split_by_filter(docs, "node", id_filter(nodes, "node"))
    texts = stored(maybe.join(nodes, "node", "left_semi"), "pair-texts")
    both = (pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
            .join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b"))
    with arrow_rows(docs.sparkSession, 500):
        return stored(both.filter(_texts_linked("text_a", "text_b")).select("a", "b").distinct(), "verified")


def _open_block(key, members: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
    """For each asking text one document of the block that it links with, if
    there is any."""
    out = []
    if len(members) and len(asking):
        sets = list(shingle_sets(pa.array(members["text"], pa.string())))
        sizes = np.array([len(x) for x in sets])
        for a, s in zip(asking["node"], shingle_sets(pa.array(asking["text"], pa.string())), strict=True):
            fits = (100 * np.minimum(sizes, len(s)) >= PERCENT * np.maximum(sizes, len(s))).nonzero()[0]
            hit = next((i for i in fits if linked(s, sets[i])), None)
            if hit is not None:
                out.append((a, members["node"].iloc[hit]))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _open_groups(docs: DataFrame, apart: DataFrame, member: DataFrame) -> DataFrame:
    """Links between the documents of pairs of groups. The larger group of a
    pair is dealt out in blocks, and so are the documents of the smaller ones
    that ask it, so a task holds at most about BLOCK + ASKING texts."""
    size = stored(member.groupBy("group").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "group-sizes")
    sized = (apart.join(size.toDF("a", "size_a"), "a", "left").join(size.toDF("b", "size_b"), "b", "left")
             .select("a", "b", F.coalesce("size_a", F.lit(1)).alias("size_a"), F.coalesce("size_b", F.lit(1)).alias("size_b"))
             .filter("size_a > 1 OR size_b > 1"))
    swap = F.col("size_a") > F.col("size_b")
    ask = stored(sized.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("small"),
                              F.when(swap, F.col("a")).otherwise(F.col("b")).alias("large"),
                              F.least("size_a", "size_b").alias("texts"),
                              F.ceil(F.greatest("size_a", "size_b") / BLOCK).cast("int").alias("blocks")), "apart")
    large = stored(ask.groupBy("large", "blocks").agg(F.ceil(F.sum("texts") / ASKING).cast("int").alias("turns")),
                   "large")
    held = (member.join(large, member["group"] == large["large"])
            .select("node", "large", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"),
                    F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn")))
    asks = (ask.select("small", "large").join(member.withColumnRenamed("group", "small"), "small")
            .join(large, "large")
            .select("node", "large", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
                    F.pmod(F.xxhash64("node", F.lit(1)), F.col("turns")).cast("int").alias("turn")))
    held, asks = stored(held, "blocks"), stored(asks, "asking")
    nodes = stored(held.select("node").unionByName(asks.select("node")).distinct(), "open-nodes")
    maybe, _ = split_by_filter(docs, "node", id_filter(nodes, "node"))
    texts = stored(maybe.join(nodes, "node", "left_semi"), "open-texts")
    keys = ("large", "block", "turn")
    left = held.join(texts, "node").select(*keys, "node", "text")
    right = (asks.join(texts.select(F.col("node").alias("of"), F.col("text").alias("asked")),
                       F.col("node") == F.col("of")).select(*keys, "node", F.col("asked").alias("text")))
    return stored(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_open_block, "a long, b long"),
                  "opened")


def _fits(n: str = "n", m: str = "m") -> str:
    return f"100 * least({n}, {m}) >= {PERCENT} * greatest({n}, {m})"


def group_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: node (the id; for a null id a stand-in
    from 2^62 on), n_shingles, component (the smallest node reached)."""
    text = F.col(text_col).cast("string")
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID) + F.pmod(
        F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(NULL_ID - 1))).alias("node"), text.alias("text"))
    found = stored(docs.mapInArrow(_signs, _SIGNS), "signs")
    signs = found.filter("node IS NOT NULL").select("node", "class", "n", "keys")
    # classes of equal sets, by the smallest node
    copies = stored(signs.filter("n > 0").groupBy("class").agg(F.min("node").alias("of"), F.count(F.lit(1)).alias("c"))
                    .filter("c > 1").select("class", "of"), "copies")
    members = stored(signs.join(copies, "class", "left")
                     .select("node", F.coalesce("of", "node").alias("of"), "n", "keys"), "members")

    # frequent shingles, over the documents that aren't copies
    _, single = split_by_filter(docs, "node", id_filter(members.filter("node <> of").select("node"), "node"))
    hot = (single.select("text").mapInArrow(_low_counts, "often long, times long")
           .unionByName(found.filter("often IS NOT NULL").select("often", "times"))
           .groupBy("often").agg(F.sum("times").alias("times")).filter(F.col("times") >= HOT_MIN)
           .orderBy(F.desc("times"), "often").limit(HOT).toPandas())  # at most HOT rows
    hot = hot.sort_values(["times", "often"])["often"].to_numpy(dtype=np.int64).view(np.uint64)
    classes = members.filter("node = of AND n > 0").dropDuplicates(["node"])

    # groups: links to one class for each pair of minimum hashes
    keyed = classes.select("node", "n", F.posexplode("keys").alias("at", "key"))
    pivots = stored(keyed.groupBy("at", "key").agg(F.min(F.struct("node", "n")).alias("p"), F.count(F.lit(1)).alias("c"))
                    .filter("c > 1").select("at", "key", F.col("p.node").alias("b"), F.col("p.n").alias("m")), "pivots")
    near = (keyed.join(pivots, ["at", "key"]).filter(F.col("node") != F.col("b")).filter(_fits())
            .select(F.col("node").alias("a"), "b").distinct())
    links = _verify(docs, near)
    # an id with several texts is one document: its node is then a member of several classes
    several = (members.filter("n > 0").groupBy("node").agg(F.min("of").alias("a"), F.max("of").alias("b"))
               .filter("a <> b").select("a", "b"))
    links = stored(links.unionByName(several), "group-links")
    groups = components(links)

    # documents that are not simply a group of their own get their group; copies go
    special = stored(members.filter("n > 0").select("node", "of").distinct()
                     .join(groups.select(F.col("node").alias("of"), "label"), "of", "left")
                     .select("node", F.coalesce("label", "of").alias("label"), (F.col("node") == F.col("of")).alias("keep"))
                     .filter("NOT keep OR label <> node"), "special")
    maybe, plain = split_by_filter(docs, "node", id_filter(special, "node"))
    special = special.withColumnRenamed("node", "_node")
    texts = (maybe.join(special, F.col("node") == F.col("_node"), "left")
             .filter(F.coalesce("keep", F.lit(True)))
             .select("node", F.coalesce("label", "node").alias("label"), "text")
             .unionByName(plain.select("node", F.col("node").alias("label"), "text")))
    matrix = (texts.mapInArrow(_matrix_rows(hot), ", ".join(f"{c} long" for c in _ROW))
              .repartition("shingle").sortWithinPartitions("shingle", "label"))
    met = stored(matrix.mapInArrow(_group_pairs, ", ".join(f"{c} long" for c in (*_PAIR, "long"))), "met")
    pairs, long = met.filter("long = 0").drop("long"), met.filter("long = 1").select(
        F.col("a").alias("shingle"), F.col("b").alias("label"), F.col("node_a").alias("node"), F.col("low_a").alias("low"), "high",
        F.col("shared").alias("follow"), "hots")
    if not long.isEmpty():
        pairs = pairs.unionByName(_long_runs(long))
    counted = (pairs.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("hots").alias("hots"), F.min("node_a").alias("node_a"),
                                           F.min("node_b").alias("node_b"), F.min("low_a").alias("low_a"),
                                           F.min("low_b").alias("low_b"), F.max("high").alias("high")))
    needed = F.expr(f"ceil({PERCENT} * (low_a + low_b) / {100 + PERCENT}) - ceil({PERCENT} * high / 100) + 1")
    open_pairs = stored(counted.filter(F.col("shared") + F.col("hots") >= F.greatest(F.lit(1), needed)), "qualifying")

    # open: one document of each, then all where a group has more
    first = _verify(docs, open_pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct())
    links = stored(links.unionByName(first), "links")
    labels = components(links)
    member = (classes.select("node", "n").join(groups, "node", "left")
              .select("node", "n", F.coalesce("label", "node").alias("group")))
    now = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
    apart = (open_pairs.select("a", "b")
             .join(now.toDF("a", "now_a"), "a", "left").join(now.toDF("b", "now_b"), "b", "left")
             .filter(F.coalesce("now_a", "a") != F.coalesce("now_b", "b")).select("a", "b"))
    apart = stored(apart.distinct(), "apart")
    if not (apart.isEmpty() or groups.isEmpty()):
        more = _open_groups(docs, apart, member.select("node", "group"))
        if not more.isEmpty():
            labels = components(links.unionByName(more))
    names = labels.select(F.col("node").alias("of"), "label")
    return (members.select("node", "of", F.col("n").alias("n_shingles")).join(names, "of", "left")
            .select("node", "n_shingles", F.coalesce("label", "of").alias("component")))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row left of each component, with its columns."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    node = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID) + F.pmod(F.xxhash64(text), F.lit(NULL_ID - 1)))
    found = group_documents(df, id_col, text_col)
    losers = found.filter("node <> component").select("node", F.lit(True).alias("_out"))
    twice = found.groupBy("node").count().filter("count > 1").select("node", F.lit(False).alias("_out"))
    decided = stored(losers.unionByName(twice).groupBy("node").agg(F.max("_out").alias("_out")), "decided")
    rows = df.select(F.struct("*").alias("row"), node.alias("node"))
    maybe, plain = split_by_filter(rows, "node", id_filter(decided, "node"))
    checked = maybe.join(decided.withColumnRenamed("node", "decided"), F.col("node") == F.col("decided"), "left")
    once = checked.filter("NOT _out").dropDuplicates(["node"])
    return (plain.select("row.*").unionByName(checked.filter("_out IS NULL").select("row.*"))
            .unionByName(once.select("row.*")))
