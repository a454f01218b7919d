"""Benchmark decontamination: an FM-index for each training shard.

* ``build_index`` cuts the documents, where they lie, into shards of about
  SHARD words and stores one row for each: its FM-index (``fm_index``) and the
  documents in it. A document of more words is cut into pieces that share
  ``window - 1`` words. The index doesn't depend on any benchmark.
* ``search`` takes the benchmark's windows (``window`` consecutive words, or
  all words of a shorter item) in blocks of about BLOCK (item, window) pairs.
  For each block one job goes over the shards: backward search of all windows
  at once, location of every occurrence, and the union of the hit words as
  spans. A block is what a task holds of the benchmark, whatever its size.
* Spans and items of a document found in several pieces or blocks are merged
  by the document's key.

Words are runs of ASCII letters and digits and of everything beyond ASCII,
A-Z lower-cased.

Defined results: a null or empty text has no words and is not contaminated,
an item without words has no windows; very long texts are whole; repeated
rows and ids count each (every row has a key of its own); rows of one item id
are one item, a null item id is one item and is written as an empty string;
with no items nothing is hit; an empty table gives an empty result; other
columns are not read, ``remove`` keeps them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ledgerloom.llm.common import arrow_rows, discard, few_large_rows, scratch_path, stored
from ledgerloom.llm.fm_index import FmIndex, build

WINDOW, SHARD, BLOCK = 10, 1 << 20, 32_768
TEXTS_AT_ONCE = 1_024
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def _folding() -> np.ndarray:
    """Byte to lower-cased byte of a word, 0 for what parts words."""
    table = np.zeros(256, dtype=np.uint8)
    for b in range(256):
        c = chr(b)
        if b >= 128 or "0" <= c <= "9" or "a" <= c <= "z":
            table[b] = b
        elif "A" <= c <= "Z":
            table[b] = b + 32
    return table


FOLD = _folding()


def word_bounds(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes of all texts, where words begin, where they end, and the
    number of words of each text."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    size = int(offsets[-1] - offsets[0])
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]] if size else np.zeros(0, dtype=np.uint8)
    offsets = offsets - offsets[0]
    folded = FOLD[raw]
    on = np.zeros(size + 2, dtype=bool)
    on[1:-1] = folded != 0
    inner = offsets[(offsets > 0) & (offsets < size)]  # words don't cross texts
    begins, ends = on[1:] & ~on[:-1], on[:-1] & ~on[1:]
    begins[inner], ends[inner] = on[inner + 1], on[inner]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends)
    return folded, begins, ends, np.diff(np.searchsorted(begins, offsets))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, one after the other, and their number in each."""
    folded, begins, ends, counts = word_bounds(texts)
    offsets = np.concatenate([[0], np.cumsum(ends - begins)])
    body = folded[folded != 0]
    words = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets.astype(np.int64)),
                                                                   pa.py_buffer(body)])
    return words, counts


INDEX = ("keys array<long>, prints array<long>, totals array<long>, skips array<int>, lengths array<int>, "
         "vocabulary binary, counts binary, tree binary, marks binary, samples binary")


def _indexer(shard: int, window: int):
    """Task code: documents in, one row for each shard out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 40
        held: list[tuple] = []  # (words, ids, prints, keys, totals, skips, lengths)
        size = 0

        def flush() -> pa.RecordBatch:
            words, ids, prints, *numbers = zip(*held, strict=True)
            keys, totals, skips, lengths = map(np.concatenate, numbers)
            index = build(pa.concat_arrays(words), lengths)
            held.clear()
            one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            total = pa.array(totals, mask=totals < 0)
            return pa.RecordBatch.from_arrays(
                [one(pa.concat_arrays(ids)), one(pa.array(keys)), one(pa.concat_arrays(prints)), one(total),
                 one(pa.array(skips, pa.int32())), one(pa.array(lengths, pa.int32())),
                 *[pa.array([index[c]], pa.binary()) for c in ("vocabulary", "counts", "tree", "marks", "samples")]],
                ["ids", "keys", "prints", "totals", "skips", "lengths", "vocabulary", "counts", "tree", "marks",
                 "samples"])

        for b in batches:
            words, counts = words_of(b.column("text"))
            starts = np.concatenate([[0], np.cumsum(counts)])
            upto = np.concatenate([[0], np.cumsum(counts + 1)])
            long, at = np.append(np.flatnonzero(counts > shard), len(counts)), 0
            while at < len(counts):
                if counts[at] > shard:  # pieces, each a shard of its own
                    if held:
                        yield flush()
                    for skip in range(0, int(counts[at]) - window + 1, shard - window + 1):
                        n = min(shard, int(counts[at]) - skip)
                        held.append((words.slice(starts[at] + skip, n), b.column("ids").slice(at, 1),
                                     b.column("print").slice(at, 1), np.array([key]),
                                     np.array([counts[at] if not skip else -1]), np.array([skip]), np.array([n])))
                        yield flush()
                    key, at, size = key + 1, at + 1, 0
                    continue
                to = int(np.searchsorted(upto, upto[at] + max(shard - size, 0), side="right")) - 1
                to = min(to, int(long[np.searchsorted(long, at)]))
                if to <= at and held:
                    yield flush()
                    size = 0
                    continue
                to = max(to, at + 1)
                n = to - at
                held.append((words.slice(starts[at], starts[to] - starts[at]), b.column("ids").slice(at, n),
                             b.column("print").slice(at, n), np.arange(key, key + n), counts[at:to],
                             np.zeros(n, dtype=np.int64), counts[at:to]))
                size += int(upto[to] - upto[at])
                key, at = key + n, to
        if held:
            yield flush()

    return run


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                shard: int = SHARD) -> tuple[DataFrame, str]:
    """The stored index, one row for each shard, and its path."""
    if shard < 2 * window:
        raise ValueError("a shard must hold two windows")
    spark = docs.sparkSession
    read = docs.select(F.col(id_col).alias("ids"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("print"))
    schema = f"ids array<{read.schema['ids'].dataType.simpleString()}>, {INDEX}"
    path = scratch_path(spark, "fm-index")
    with arrow_rows(spark, TEXTS_AT_ONCE):
        (read.mapInArrow(_indexer(shard, window), schema).write.option("compression", "zstd").parquet(path))
    return spark.read.schema(schema).parquet(path), path


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct (item, window), the window as its words parted by spaces."""
    read = items.select(F.col(id_col).alias("item"), F.col(text_col).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                words = words_of(b.column("text").slice(i, 1))[0].to_pylist()
                found = list({b" ".join(words[j:j + window]) for j in range(max(1, len(words) - window + 1))}) if words else []
                yield pa.RecordBatch.from_arrays([b.column("item").take(pa.array([i] * len(found), pa.int64())),
                                                  pa.array(found, pa.binary())], ["item", "phrase"])

    return read.mapInArrow(cut, f"item {read.schema['item'].dataType.simpleString()}, phrase binary").distinct()


class Block:
    """Some (item, window) pairs, as a task takes them along."""

    def __init__(self, pairs: list, width: int, kind: pa.DataType):
        self.items = pa.array([p["item"] for p in pairs], kind)
        phrases = sorted({bytes(p["phrase"]) for p in pairs})
        number = {w: i for i, w in enumerate(phrases)}
        which = np.array([number[bytes(p["phrase"])] for p in pairs], dtype=np.int64)
        self.order = np.argsort(which, kind="stable")  # pairs by phrase
        self.first = np.searchsorted(which[self.order], np.arange(len(phrases) + 1))
        cut = [w.split(b" ") for w in phrases]
        self.words = sorted({w for c in cut for w in c})
        place = {w: i for i, w in enumerate(self.words)}
        self.length = np.array([len(c) for c in cut], dtype=np.int64)
        self.phrases = np.full((len(phrases), width), -1, dtype=np.int64)
        for i, c in enumerate(cut):
            self.phrases[i, width - len(c):] = [place[w] for w in c]


def _searcher(block: Block, kind: pa.DataType):
    """Task code: shards in, hit documents with spans and items out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.array(block.words, pa.binary())
        for b in batches:
            for row in b.to_pylist():
                found = _hits(FmIndex(row), row, block, words)
                if found is None:
                    continue
                docs, spans, items = found
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(row["keys"])[docs]), pa.array(spans, to_arrow_type(SPANS)),
                     pa.array(items, pa.list_(kind))], ["key", "spans", "items"])

    return run


def _hits(index: FmIndex, row: dict, block: Block, words: pa.Array):
    symbols = index.symbols(words)
    phrases = np.where(block.phrases < 0, -1, symbols[block.phrases])
    lengths = np.array(row["lengths"], dtype=np.int64)
    begins = np.cumsum(lengths + 1) - lengths - 1
    edges, pairs = np.zeros(index.n + 1, dtype=np.int64), []
    for phrase, place in index.occurrences(phrases):
        np.add.at(edges, place, 1)
        np.add.at(edges, place + block.length[phrase], -1)
        doc = np.searchsorted(begins, place, side="right") - 1
        pairs.append(np.unique(doc * len(phrases) + phrase))
    if not pairs:
        return None
    hit = np.cumsum(edges) > 0
    turns = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]])))
    spans, owner = turns.reshape(-1, 2), np.searchsorted(begins, turns[::2], side="right") - 1
    local = spans - begins[owner][:, None] + np.array(row["skips"], dtype=np.int64)[owner][:, None]
    doc, phrase = np.divmod(np.unique(np.concatenate(pairs)), len(phrases))
    # the items of each found phrase
    times = block.first[phrase + 1] - block.first[phrase]
    at = np.repeat(block.first[phrase], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    doc, pair = np.repeat(doc, times), block.order[at]
    names = block.items.take(pa.array(pair)).to_pylist()
    docs = np.unique(owner)
    span_lists, item_sets = {d: [] for d in docs.tolist()}, {d: set() for d in docs.tolist()}
    for d, (a, z) in zip(owner.tolist(), local.tolist(), strict=True):
        span_lists[d].append({"start": a, "end": z})
    for d, name in zip(doc.tolist(), names, strict=True):
        item_sets[d].add(name)
    return docs, list(span_lists.values()), [list(s) for s in item_sets.values()]


@F.pandas_udf(SPANS)
def merged_spans(spans: pd.Series) -> pd.Series:
    """The union of spans (arrays of start, end): sorted, none touching."""
    out = []
    for row in spans:
        found: list[dict] = []
        for a, z in sorted((s["start"], s["end"]) for s in row):
            if found and a <= found[-1]["end"]:
                found[-1]["end"] = max(found[-1]["end"], z)
            else:
                found.append({"start": a, "end": z})
        out.append(found)
    return pd.Series(out, dtype=object)


def search(index: DataFrame, items: DataFrame, item_col: str = "item_id", text_col: str = "text",
           window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """One row for each document row of the index: id, print (hash of the
    text), n_words, spans (word places, merged, end exclusive) and items
    (distinct ids of items with an occurring window)."""
    spark = index.sparkSession
    pairs = stored(windows(items, item_col, text_col, window), "windows")
    n, kind = pairs.count(), pairs.schema["item"].dataType
    blocks = -(-n // block)
    here = f"key long, spans {SPANS.simpleString()}, items array<{kind.simpleString()}>"
    hits = []
    for at in range(blocks):  # each block is bounded, and so is what the driver holds
        part = Block(pairs.filter(F.pmod(F.xxhash64("item", "phrase"), F.lit(blocks)) == at).collect(), window,
                     to_arrow_type(kind))
        # shards are large rows: few at a time, in the scan and on the way to Python
        with arrow_rows(spark, 1), few_large_rows(spark):
            hits.append(stored(index.select("keys", "skips", "lengths", "vocabulary", "counts", "tree", "marks", "samples")
                               .mapInArrow(_searcher(part, to_arrow_type(kind)), here), "hits"))
    own = (index.select(F.inline(F.arrays_zip("ids", "keys", "prints", "totals"))).filter("totals IS NOT NULL")
           .select(F.col("ids").alias("id"), F.col("keys").alias("key"), F.col("prints").alias("print"),
                   F.col("totals").alias("n_words")))
    nothing = [F.array().cast(SPANS).alias("spans"), F.array().cast(T.ArrayType(kind)).alias("items")]
    if not hits:
        return own.select("id", "print", "n_words", *nothing)
    found = hits[0]
    for more in hits[1:]:
        found = found.unionByName(more)
    # rows of one document: a few, for its pieces and the blocks
    found = (found.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"),
                                      F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
             .select("key", merged_spans("spans").alias("spans"), "items"))
    return own.join(found, "key", "left").select(
        "id", "print", "n_words", F.coalesce("spans", nothing[0]).alias("spans"),
        F.coalesce("items", nothing[1]).alias("items"))


def report(found: DataFrame) -> DataFrame:
    """Figures of each document: words, hit words, items and their digest."""
    names = F.array_sort(F.transform("items", lambda i: F.coalesce(i.cast("string"), F.lit(""))))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


@F.pandas_udf(T.StringType())
def without_spans(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """Texts without the words of the spans, from each span's first byte to
    its last."""
    out = []
    for text, row in zip(texts, spans, strict=True):
        if text is None or row is None or not len(row):
            out.append(text)
            continue
        _, begins, ends, _ = word_bounds(pa.array([text], pa.large_string()))
        raw, kept, at = text.encode(), [], 0
        for s in row:
            kept.append(raw[at:begins[s["start"]]])
            at = ends[s["end"] - 1]
        out.append(b"".join([*kept, raw[at:]]).decode())
    return pd.Series(out, dtype=object)


def remove(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           window: int = WINDOW) -> DataFrame:
    """``docs`` with the benchmark's passages cut out of their texts; all
    rows and columns stay. Rows of equal id and text have equal spans, so
    the hit texts are met by (id, hash of the text)."""
    index, path = build_index(docs, id_col, text_col, window)
    found = stored(search(index, items, window=window).filter(F.size("spans") > 0)
                   .select(F.col("id").alias("_span_id"), F.col("print").alias("_span_print"), F.col("spans").alias("_spans"))
                   .dropDuplicates(["_span_id", "_span_print"]), "spans")
    discard(docs.sparkSession, path)
    met = docs.join(found, docs[id_col].eqNullSafe(found["_span_id"]) & (F.xxhash64(docs[text_col]) == found["_span_print"]), "left")
    return met.select(*[without_spans(docs[c], F.col("_spans")).alias(c) if c == text_col else docs[c] for c in docs.columns])
