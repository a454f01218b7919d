"""Alignment of two tokenizers over a corpus, with an identity-map fast path.

Both tokenizers read every text; byte offsets where tokens of both end cut it
into groups, and every A token of a group is linked with every B token of it.

* ``Pair.identity`` maps an A id to the B id of the same bytes, once for the
  vocabulary. A group of one A and one B token that the map joins is regular:
  it is counted by its A id alone, in a vector as long as A's vocabulary.
  So is an identity pair that an irregular group holds, as a document counts
  once for a pair. Only other pairs, all from irregular groups, are shuffled.
* Texts fall apart into units (a space in front of a visible character ends
  the unit before it; neither tokenizer's tokens cross such a place, else
  texts are units). A task reads documents in blocks of about BLOCK bytes:
  each distinct unit of a block is tokenized, grouped and written down once,
  documents are sums over their units, and a block counts each of its distinct
  pairs once before the shuffle. One stored row per block holds all of it.
* The totals of the pairs are joined back to the blocks' distinct pairs; the
  best count of every A id (again a vector of the vocabulary) and the vector
  of identity counts travel with the task code. Each block then rates its
  units and adds them up by document.

Defined results: a null or empty text, and one whose tokens' bytes differ from
a space and the text, has zeros and an empty digest, and counts nowhere;
repeated rows and ids are documents each; special strings in texts are plain
text; ties for the best count are all best; very long texts are whole (a text
beyond BLOCK is a block of its own); an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ledgerloom.llm.common import arrow_rows, discard, few_large_rows, scratch_path, stored
from ledgerloom.llm.sentencepiece_fst import MARK, model_path
from ledgerloom.llm.token_counts import _byte_symbols
from ledgerloom.llm.token_lattice import compiled

A_MODEL, B_MODEL = "byte_bpe_50k.json", "piece_bpe_32k.model"
BLOCK, TEXTS_AT_ONCE, UNITS_AT_ONCE, LINKS_AT_ONCE = 4 << 20, 512, 2_048, 1 << 20


class Strings:
    """Byte strings by number, for gathering many of them at once."""

    def __init__(self, values: list[bytes]):
        self.size = np.array([len(v) for v in values], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(values), dtype=np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        end = np.cumsum(size)
        return self.flat[np.repeat(self.start[ids] - (end - size), size) + np.arange(size.sum())]


def runs(first: np.ndarray, times: np.ndarray) -> np.ndarray:
    """first[0] .. first[0] + times[0] - 1, first[1] .. and so on."""
    return np.repeat(first - (np.cumsum(times) - times), times) + np.arange(times.sum())


def ordered_set(values: np.ndarray) -> np.ndarray:
    """Distinct values in order; sorts its argument."""
    values.sort()
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def pack(values: np.ndarray) -> bytes:
    """Whole numbers, as narrow as they are, compressed."""
    kind = next(k for k in (np.uint8, np.uint16, np.int32, np.int64)
                if not len(values) or (np.iinfo(k).min <= values.min() and values.max() <= np.iinfo(k).max))
    raw = values.astype(kind).tobytes()
    return np.dtype(kind).char.encode() + len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    raw = pa.decompress(data[9:], int.from_bytes(data[1:9], "little"), codec="zstd", asbytes=True)
    return np.frombuffer(raw, dtype=data[:1].decode()).astype(np.int64)


class Pair:
    """The two tokenizers and what is computed from their vocabularies."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb2
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings are plain text
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = _byte_symbols()
        names = {i: s for s, i in self.a.get_vocab(with_added_tokens=True).items()}
        added = self.a.get_added_tokens_decoder()
        a_bytes = [names[i].encode() if i in added else bytes(byte_of[c] for c in names[i]) if i in names else b""
                   for i in range(max(names) + 1)]
        n, pieces = self.b.get_piece_size(), self.b.id_to_piece
        b_bytes = [bytes([int(pieces(i)[1:-1], 16)]) if self.b.is_byte(i) else pieces(i).replace(MARK, " ").encode()
                   for i in range(n)]
        self.a_bytes, self.b_bytes = Strings(a_bytes), Strings(b_bytes)
        self.decimal = Strings([str(i).encode() for i in range(max(len(a_bytes), n))])
        by_bytes: dict[bytes, int] = {}
        for i in sorted((i for i in range(n) if not self.b.is_control(i) and not self.b.is_unknown(i)),
                        key=lambda i: (self.b.is_byte(i), i)):
            by_bytes.setdefault(b_bytes[i], i)
        self.identity = np.array([-1 if i in added else by_bytes.get(v, -1) for i, v in enumerate(a_bytes)], dtype=np.int64)
        self.width = n
        model = pb2.ModelProto()
        with open(b_path, "rb") as f:
            model.ParseFromString(f.read())
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        norm, pre = model.normalizer_spec, spec.get("pre_tokenizer") or {}
        self.mark = self.b.piece_to_id(MARK)
        #: whether no token of either crosses the end of a unit
        self.cuts = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
                     and not spec.get("normalizer") and norm.add_dummy_prefix and not norm.remove_extra_whitespaces
                     and not norm.precompiled_charsmap and pieces(self.mark) == MARK
                     and not any(MARK in pieces(i).lstrip(MARK) for i in range(n)))

    def encode(self, units: list[bytes]):
        """Ids of A and of B of each unit, flat, with their numbers."""
        ids, counts = ([], []), ([], [])
        for at in range(0, len(units), UNITS_AT_ONCE):
            texts = [u.decode("utf-8", "replace") for u in units[at:at + UNITS_AT_ONCE]]
            a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
            # B puts the space in front itself; of a lone space nothing would be left
            b = self.b.encode([t[1:] for t in texts], num_threads=1)
            if self.cuts:
                b = [[self.mark] if t == " " else i for t, i in zip(texts, b, strict=True)]
            for k, lists in enumerate((a, b)):
                counts[k].append(np.fromiter(map(len, lists), np.int64, len(lists)))
                ids[k].append(np.fromiter(chain.from_iterable(lists), np.int64, int(counts[k][-1].sum())))
        whole = lambda parts: np.concatenate([np.zeros(0, dtype=np.int64), *parts])
        return whole(ids[0]), whole(counts[0]), whole(ids[1]), whole(counts[1])


def unit_starts(raw: np.ndarray, starts: np.ndarray, cuts: bool) -> np.ndarray:
    """Where units begin in texts (each with its space in front) laid end to
    end: at every text, and at a space behind a visible ASCII character or a
    letter of U+00C0 to U+00FF. Behind others the unit goes on, which is
    always right."""
    cut = np.zeros(len(raw), dtype=bool)
    if cuts and len(raw) > 2:
        before, two = raw[1:-1], raw[:-2]
        cut[2:] = (raw[2:] == 32) & (((before >= 33) & (before <= 126)) | ((before >= 128) & (two == 0xC3)))
    cut[starts] = True
    return np.flatnonzero(cut)


def same_bytes(ids: np.ndarray, counts: np.ndarray, table: Strings, raw: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which units the tokens give back byte by byte."""
    owner = np.repeat(np.arange(len(counts)), counts)
    right = np.bincount(owner, weights=table.size[ids], minlength=len(counts)).astype(np.int64) == sizes
    mine = np.repeat(right, sizes)
    differs = table.joined(ids[right[owner]]) != raw[mine]
    right[np.repeat(np.arange(len(sizes)), sizes)[mine][differs]] = False
    return right


class Units:
    """Distinct units of a block: tokens, groups, links and their text."""

    def __init__(self, units: list[bytes], pair: Pair):
        n = len(units)
        raw = np.frombuffer(b"".join(units), dtype=np.uint8)
        sizes = np.array([len(u) for u in units], dtype=np.int64)
        a, a_count, b, b_count = pair.encode(units)
        self.right = (same_bytes(a, a_count, pair.a_bytes, raw, sizes) & same_bytes(b, b_count, pair.b_bytes, raw, sizes))
        a, b = a[np.repeat(self.right, a_count)], b[np.repeat(self.right, b_count)]
        self.n_a, self.n_b = np.where(self.right, a_count, 0), np.where(self.right, b_count, 0)
        a_end, b_end = np.cumsum(pair.a_bytes.size[a]), np.cumsum(pair.b_bytes.size[b])
        a_closes, b_closes = np.isin(a_end, b_end), np.isin(b_end, a_end)  # both end here
        a_group, b_group = np.cumsum(a_closes) - a_closes, np.cumsum(b_closes) - b_closes
        groups = int(a_closes.sum())
        of_a, of_b = np.bincount(a_group, minlength=groups), np.bincount(b_group, minlength=groups)
        unit_of = np.repeat(np.arange(n), self.n_a)[a_closes]  # of each group
        self.n_groups = np.bincount(unit_of, minlength=n)
        links = of_a * of_b
        self.n_links = np.bincount(unit_of, weights=links, minlength=n).astype(np.int64)
        first_a, first_b = np.cumsum(of_a) - of_a, np.cumsum(of_b) - of_b
        regular = (of_a == 1) & (of_b == 1)
        regular[regular] = pair.identity[a[first_a[regular]]] == b[first_b[regular]]
        self._pairs(pair.width, n, unit_of, a, b, first_a, first_b, of_a, of_b, regular)
        self.text = self._written(pair, a, b, a_group, b_group, of_a, of_b, a_closes, b_closes, first_a, first_b, unit_of, n)

    def _pairs(self, width, n, unit_of, a, b, first_a, first_b, of_a, of_b, regular) -> None:
        """Distinct pairs (code = a * width + b), and of each unit which it
        holds and how many links. Regular groups need no expansion; of the
        others the distinct ids of each side are paired."""
        units, codes = [unit_of[regular]], [a[first_a[regular]] * width + b[first_b[regular]]]
        times = [np.ones(len(units[0]), dtype=np.int64)]
        odd = np.flatnonzero(~regular)

        def distinct(ids, first, count):
            rows = ids[runs(first[odd], count[odd])]
            which = np.repeat(np.arange(len(odd)), count[odd])
            key, times = np.unique(which * (1 << 32) + rows, return_counts=True)
            return key & ((1 << 32) - 1), times, np.bincount(key >> 32, minlength=len(odd))

        (ia, ta, ca), (ib, tb, cb) = distinct(a, first_a, of_a), distinct(b, first_b, of_b)
        # every A id of a group with all its B ids
        partners = np.repeat(cb, ca)
        left = np.repeat(np.arange(len(ia)), partners)
        right = runs(np.repeat(np.cumsum(cb) - cb, ca), partners)
        units.append(np.repeat(unit_of[odd], ca * cb))
        codes.append(ia[left] * width + ib[right])
        times.append(ta[left] * tb[right])
        unit, code, time = map(np.concatenate, (units, codes, times))
        self.codes, which = np.unique(code, return_inverse=True)
        key, back = np.unique(unit * max(1, len(self.codes)) + which, return_inverse=True)
        self.pair = (key % max(1, len(self.codes))).astype(np.int64)
        self.times = np.bincount(back, weights=time, minlength=len(key)).astype(np.int64)
        self.n_pairs = np.bincount(key // max(1, len(self.codes)), minlength=n)

    @staticmethod
    def _written(pair, a, b, a_group, b_group, of_a, of_b, a_closes, b_closes, first_a, first_b, unit_of, n) -> list[bytes]:
        """Each unit's groups as ``a1,a2|b1;``."""
        total = len(a) + len(b)
        ids, mark = np.empty(total, dtype=np.int64), np.full(total, ord(","), dtype=np.uint8)
        a_at = np.arange(len(a)) + first_b[a_group]
        b_at = np.arange(len(b)) + (first_a + of_a)[b_group]
        ids[a_at], ids[b_at] = a, b
        mark[a_at[a_closes]], mark[b_at[b_closes]] = ord("|"), ord(";")
        size = pair.decimal.size[ids] + 1
        end = np.cumsum(size)
        out = np.empty(int(end[-1]) if total else 0, dtype=np.uint8)
        is_digit = np.ones(len(out), dtype=bool)
        is_digit[end - 1] = False
        out[is_digit], out[end - 1] = pair.decimal.joined(ids), mark
        of_unit = np.bincount(unit_of, weights=np.bincount(np.concatenate([a_group, b_group]),
                                                           weights=np.concatenate([size[a_at], size[b_at]]),
                                                           minlength=len(of_a)), minlength=n).astype(np.int64)
        flat, cut = out.tobytes(), np.concatenate([[0], np.cumsum(of_unit)]).tolist()
        return [flat[x:y] for x, y in zip(cut, cut[1:], strict=False)]


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
BODY = ("figures", "digests", "units", "unit_at", "unit_times", "pairs_of_unit", "pair_at", "pair_times", "links")


def align_block(texts: pa.Array, pair: Pair) -> dict:
    """All of a block but its documents' ids."""
    n = len(texts)
    full = np.flatnonzero(pc.fill_null(pc.greater(pc.binary_length(texts), 0), False).to_numpy(zero_copy_only=False))
    some = texts.take(pa.array(full)).cast(pa.large_string())
    some = some if isinstance(some, pa.Array) else some.combine_chunks()
    offsets = np.frombuffer(some.buffers()[1], dtype=np.int64)[some.offset:some.offset + len(some) + 1] if len(some) else np.zeros(1, dtype=np.int64)
    raw = (np.insert(np.frombuffer(some.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]], offsets[:-1] - offsets[0], 32)
           if len(some) else np.zeros(0, dtype=np.uint8))
    starts = offsets[:-1] - (offsets[0] if len(some) else 0) + np.arange(len(some))
    begins = unit_starts(raw, starts, pair.cuts)
    ends = np.append(begins, len(raw)).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(ends), pa.py_buffer(raw)]).dictionary_encode()
    unit, doc = coded.indices.to_numpy().astype(np.int64), np.searchsorted(starts, begins, side="right") - 1
    u = Units(coded.dictionary.to_pylist(), pair)
    n_units = max(1, len(u.right))
    valid = np.bincount(doc[~u.right[unit]], minlength=len(some)) == 0
    figures, digests = np.zeros((4, n), dtype=np.int64), [b"\0" * 32] * n
    first = np.searchsorted(begins, starts)
    upto = np.append(first, len(unit)).tolist()
    for i, (at, ok) in enumerate(zip(full.tolist(), valid.tolist(), strict=True)):
        if ok:
            said = b"".join([u.text[k] for k in unit[upto[i]:upto[i + 1]].tolist()])
            digests[at] = hashlib.sha256(said[:-1]).digest()
    key = (full[doc] * n_units + unit)[valid[doc]]
    key.sort()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
    times = np.diff(np.append(first, len(key)))
    at, which = np.divmod(key[first], n_units)
    for k, name in enumerate(NUMBERS):
        figures[k] = np.bincount(at, weights=getattr(u, name)[which] * times, minlength=n).astype(np.int64)
    # documents that hold a pair, each once, some documents at a time
    docs, first = np.zeros(len(u.codes), dtype=np.int64), np.cumsum(u.n_pairs) - u.n_pairs
    held = np.cumsum(u.n_pairs[which])
    from_ = 0
    while from_ < len(at):
        to = int(np.searchsorted(held, (held[from_ - 1] if from_ else 0) + LINKS_AT_ONCE, side="right"))
        to = max(int(np.searchsorted(at, at[min(to, len(at) - 1)])) if to < len(at) else len(at),
                 int(np.searchsorted(at, at[from_], side="right")))
        w = which[from_:to]
        pairs = u.pair[runs(first[w], u.n_pairs[w])]
        owner = np.repeat(at[from_:to] - at[from_], u.n_pairs[w])
        docs += np.bincount(ordered_set(owner * len(u.codes) + pairs) % len(u.codes), minlength=len(u.codes))
        from_ = to
    a, b = np.divmod(u.codes, pair.width)
    same = pair.identity[a] == b
    place = np.empty(len(same), dtype=np.int64)  # identity pairs by A id, others by -1 - number
    place[same], place[~same] = a[same], -1 - np.arange(int((~same).sum()))
    irregular = ~same & (docs > 0)
    steps = np.diff(which, prepend=0)  # units ascend within a document
    return {"figures": pack(figures.ravel()), "digests": b"".join(digests), "units": pack(np.bincount(at, minlength=n)),
            "unit_at": pack(steps), "unit_times": pack(times), "pairs_of_unit": pack(u.n_pairs), "pair_at": pack(u.pair),
            "pair_times": pack(u.times), "links": pack(np.concatenate([place, a])),
            "same": [{"a": int(x), "docs": int(d)} for x, d in zip(a[same], docs[same], strict=True) if d],
            "odd": [{"at": int(-1 - place[k]), "a": int(a[k]), "b": int(b[k]), "docs": int(docs[k])}
                    for k in np.flatnonzero(irregular)]}


SAME, ODD = "array<struct<a:int,docs:long>>", "array<struct<at:int,a:int,b:int,docs:long>>"


def _blocker(a_path: str, b_path: str, block: int, same: pa.DataType, odd: pa.DataType):
    """Task code: documents in, one row for each block out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = compiled(("alignment", a_path, b_path), lambda: Pair(a_path, b_path))
        key, held, size = TaskContext.get().partitionId() << 32, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal key
            made = align_block(pa.concat_arrays([t for _, t in held]), pair)
            ids = pa.concat_arrays([i for i, _ in held])
            held.clear()
            key += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([key]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                 *[pa.array([made[c]], pa.binary()) for c in BODY], pa.array([made["same"]], same),
                 pa.array([made["odd"]], odd)], ["block", "ids", *BODY, "same", "odd"])

        for b in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False) + 64)
            at = 0
            while at < b.num_rows:
                before = int(sizes[at - 1]) if at else 0
                to = int(np.searchsorted(sizes, before + block - size, side="right"))
                if to <= at and held:
                    yield flush()
                    size = 0
                    continue
                to = max(to, at + 1)
                held.append((b.column("ids").slice(at, to - at), b.column("text").slice(at, to - at)))
                size += int(sizes[to - 1]) - before
                at = to
        if held:
            yield flush()

    return run


def _rater(identity_docs: np.ndarray, best: np.ndarray, kind: pa.DataType):
    """Task code: blocks with the counts of their irregular pairs in, documents out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids = b.column("ids").slice(i, 1).flatten()
                n, digests = len(ids), b.column("digests")[i].as_py()
                row = {c: unpack(b.column(c)[i].as_py()) for c in BODY if c != "digests"}
                figures, (place, a) = row["figures"].reshape(4, n), row["links"].reshape(2, -1)
                row["unit_at"] = np.cumsum(row["unit_at"])
                count = np.zeros(len(place), dtype=np.int64)
                count[place >= 0] = identity_docs[place[place >= 0]]
                odd, told = np.flatnonzero(place < 0), b.column("counts").slice(i, 1).flatten()
                if len(told):
                    count[odd[told.field("at").to_numpy()]] = told.field("docs").to_numpy()
                is_best = (count == best[a]) & (count > 0)
                # links of units, then of documents
                unit = np.repeat(np.arange(len(row["pairs_of_unit"])), row["pairs_of_unit"])
                at, docs = row["pair_at"], np.repeat(np.arange(n), row["units"])

                def summed(value):
                    per_unit = np.zeros(len(row["pairs_of_unit"]), dtype=np.int64)  # noqa: B023
                    np.add.at(per_unit, unit, value[at] * row["pair_times"])  # noqa: B023
                    out = np.zeros(n, dtype=np.int64)  # noqa: B023
                    np.add.at(out, docs, per_unit[row["unit_at"]] * row["unit_times"])  # noqa: B023
                    return pa.array(out)

                hashes = [digests[32 * k:32 * k + 32].hex() if has else "" for k, has in enumerate(figures[0] > 0)]
                yield pa.RecordBatch.from_arrays(
                    [ids, *[pa.array(f) for f in figures], summed(is_best.astype(np.int64)), summed(count), pa.array(hashes)],
                    ["id", *NUMBERS, "n_best", "count_sum", "groups_sha256"])

    return run


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_model: str = A_MODEL,
          b_model: str = B_MODEL, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Figures of every document row (id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256), and the pairs (a, b, docs) of the corpus."""
    spark = docs.sparkSession
    read = docs.select(F.col(id_col).alias("ids"), F.col(text_col).cast("string").alias("text"))
    kind, a_path, b_path = read.schema["ids"].dataType, model_path(a_model), model_path(b_model)
    schema = f"block long, ids array<{kind.simpleString()}>, {', '.join(f'{c} binary' for c in BODY)}, same {SAME}, odd {ODD}"
    path = scratch_path(spark, "alignment")
    with arrow_rows(spark, TEXTS_AT_ONCE):
        types = [to_arrow_type(t) for t in (spark.createDataFrame([], f"s {SAME}").schema[0].dataType,
                                            spark.createDataFrame([], f"s {ODD}").schema[0].dataType)]
        (read.mapInArrow(_blocker(a_path, b_path, block, *types), schema)
         .write.option("compression", "zstd").parquet(path))
    pair = compiled(("alignment", a_path, b_path), lambda: Pair(a_path, b_path))
    with few_large_rows(spark), arrow_rows(spark, 1):
        blocks = spark.read.schema(schema).parquet(path)
        same = stored(blocks.select(F.inline("same")).groupBy("a").agg(F.sum("docs").alias("docs")), "identity-pairs")
        odd = blocks.select("block", F.inline("odd"))
        totals = stored(odd.groupBy("a", "b").agg(F.sum("docs").alias("docs")), "irregular-pairs")
        # two vectors of A's vocabulary
        identity_docs, best = np.zeros(len(pair.identity), dtype=np.int64), np.zeros(len(pair.identity), dtype=np.int64)
        for r in same.collect():
            identity_docs[r.a] = best[r.a] = r.docs
        for r in totals.groupBy("a").agg(F.max("docs").alias("docs")).collect():
            best[r.a] = max(best[r.a], r.docs)
        back = (odd.select("block", "at", "a", "b").join(totals, ["a", "b"])
                .groupBy("block").agg(F.collect_list(F.struct("at", "docs")).alias("counts")))  # a block's own pairs
        told = (blocks.select("block", "ids", *BODY).join(stored(back, "block-counts"), "block", "left")
                .select("ids", *BODY, F.coalesce("counts", F.array().cast("array<struct<at:int,docs:long>>")).alias("counts")))
        result = stored(told.mapInArrow(
            _rater(identity_docs, best, to_arrow_type(kind)),
            f"id {kind.simpleString()}, {', '.join(f'{c} long' for c in NUMBERS)}, n_best long, count_sum long, "
            "groups_sha256 string"), "aligned")
    discard(spark, path)
    identity = pa.array(pair.identity)  # of A's vocabulary
    names = spark.createDataFrame([(i, int(b)) for i, b in enumerate(identity.to_pylist()) if b >= 0], "a int, b int")
    return result, same.join(names, "a").select("a", "b", "docs").unionByName(totals.select("a", "b", "docs"))
