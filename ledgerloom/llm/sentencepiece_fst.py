"""SentencePiece encoding and decoding by a weighted transducer.

The model's parts are compiled once per worker and composed with an input:
the normaliser (``piece_normaliser``: longest matches of the compiled character
map, spaces to the space mark, a mark in front), the pieces as a trie of
weighted arcs, and byte fallback, whose arc over a character without a piece
gives its UTF-8 bytes' pieces (or the unknown piece, where a model has no
bytes). The shortest path in the tropical semiring (weights add along a path,
the least sum wins) gives the pieces:

* a unigram model's arc weighs minus the piece's score, a fallback arc ten more
  than the worst piece; sums are kept in single precision and the earlier start
  wins a tie, as in the library;
* a BPE model has no weights that add up to its results: its arcs weigh zero or
  are missing, by the pair of neighbours (``token_lattice``), so that exactly
  one path is left. This equals the library (tested).

In a BPE model no piece holds a mark behind another symbol, so an input falls
apart before each run of marks: a batch's distinct words are read once, in
order, and those found often are kept in a bounded memo. (A model with such
pieces is read in one part per text.) A unigram model and one with a character
map are read text by text.

Defined results: a null text has a null encoding, an empty text no pieces;
rows are independent, so repeated rows, ties and empty tables need no rule;
long texts are whole; a text with the space mark itself decodes to a space,
as in the library; other columns are kept. Models of other kinds, and unigram
models with user-defined pieces, raise ``ValueError``.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ledgerloom.llm.piece_normaliser import MARK, Normaliser
from ledgerloom.llm.token_lattice import TokenLattice, compiled, words_of

MEMO, OFTEN, ROWS = 150_000, 4, 8_000
MODEL = "piece_bpe_32k.model"


def model_path(name: str) -> str:
    """A vocabulary file of the public tokenizers, by name, or any path."""
    if "/" in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


class PieceTransducer:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb2
        model = pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kind, types = pb2.ModelProto.SentencePiece, pb2.TrainerSpec
        self.normaliser = Normaliser(model.normalizer_spec)
        self.prefix = self.normaliser.prefix
        self.unigram = model.trainer_spec.model_type == types.UNIGRAM
        fallback = model.trainer_spec.byte_fallback
        if not self.unigram and (model.trainer_spec.model_type != types.BPE or not fallback):
            raise ValueError("a unigram model, or a BPE model with byte fallback, is needed")
        if any(p.type == kind.USER_DEFINED for p in model.pieces):
            raise ValueError("user-defined pieces are not compiled")
        self.pieces = [p.piece for p in model.pieces]
        ranks = {tuple(p.piece): -p.score for p in model.pieces if p.type == kind.NORMAL}
        self.ids = {tuple(p.piece): i for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        byte_ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.BYTE}
        self.byte_id = [byte_ids[f"<0x{b:02X}>"] for b in range(256)] if fallback else []
        self.byte_of = {i: b for b, i in enumerate(self.byte_id)}
        self.unknown = next((i for i, p in enumerate(model.pieces) if p.type == kind.UNKNOWN), None)
        self.hidden = {i for i, p in enumerate(model.pieces)
                       if p.type == kind.CONTROL or p.type == kind.UNKNOWN and not self.unigram}
        self.surface = model.trainer_spec.unk_surface
        self.memo: dict[str, tuple[bytes, bool]] = {}  # of words found often
        if self.unigram:
            self._compile_arcs(ranks)
            return
        self.lattice = TokenLattice(ranks, lambda a, b: ranks.get(a + b))
        self.inner = any(MARK in "".join(p).lstrip(MARK) for p in ranks)
        # a run of marks opens a part; so does what no piece holds together with others
        alone = "" if any("\n" in p for p in ranks) else "\n"
        self.cut = re.compile(f"{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+|{alone or MARK}").findall

    def _compile_arcs(self, weights: dict[tuple, float]) -> None:
        """The pieces as a trie; None holds the (id, weight) of the arc that ends there."""
        self.inner, self.arcs = True, {}
        for piece, weight in weights.items():
            node = self.arcs
            for c in piece:
                node = node.setdefault(c, {})
            node[None] = (self.ids[piece], np.float32(weight))
        self.fallback = np.float32(max(weights.values(), default=0.0)) + np.float32(10)

    def _shortest(self, text: str) -> np.ndarray:
        """Ids along the path of least weight from the first to the last state,
        a state for each place between characters."""
        n, zero = len(text), np.float32(0)
        weight, came = [zero] + [None] * n, [(0, -1)] * (n + 1)
        for at in range(n):
            here, node, single = weight[at], self.arcs, False
            for end in range(at, n):
                node = node.get(text[end])
                if node is None:
                    break
                arc = node.get(None)
                if arc is not None:
                    single = single or end == at
                    total = here + arc[1]
                    if weight[end + 1] is None or total < weight[end + 1]:
                        weight[end + 1], came[end + 1] = total, (at, arc[0])
            if not single:
                total = here + self.fallback
                if weight[at + 1] is None or total < weight[at + 1]:
                    weight[at + 1], came[at + 1] = total, (at, -1)
        steps, end = [], n
        while end:
            steps.append((came[end][0], end, came[end][1]))
            end = came[end][0]
        out, before = [], None
        for a, z, piece in reversed(steps):
            if piece >= 0:
                out.append(piece)
            elif self.byte_id:
                out.extend(self.byte_id[b] for b in text[a:z].encode("utf-8", "replace"))
            elif before != -1:  # neighbouring unknowns are one
                out.append(self.unknown)
            before = piece
        return np.array(out, dtype=np.int32)

    def parts(self, text: str) -> list[str]:
        return [text] if self.inner else self.cut(text)

    def paths(self, parts: Iterable[str]) -> dict[str, bytes]:
        """The piece ids of distinct parts, as bytes of int32."""
        found, ids = {}, self.ids
        order = sorted(parts)
        for p, (last, begin, _) in zip(order, self.lattice.walk(order), strict=True):
            out: list[int] = []
            for t in self.lattice.path(last, begin):
                i = ids.get(t)
                if i is None:
                    out.extend(self.byte_id[b] for b in "".join(t).encode("utf-8", "replace"))
                else:
                    out.append(i)
            found[p] = array("i", out).tobytes()
        return found

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.int32)
        normal = self.normaliser(text)
        if self.unigram:
            return self._shortest(normal)
        parts = self.parts(normal)
        found = self.paths(set(parts))
        return np.frombuffer(b"".join([found[p] for p in parts]), dtype=np.int32)

    def encode_batch(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Ids of every text, and whether its words decode to themselves.
        Texts are split at spaces; where spaces or marks come in runs or at
        an end, a text is read by itself."""
        if self.unigram or not self.normaliser.plain:
            return self._one_by_one(texts)
        odd = pc.or_kleene(pc.match_substring_regex(texts, f"  |{MARK}|^ | $"), self.inner or not self.prefix)
        odd = odd.fill_null(False).to_numpy(zero_copy_only=False)
        offsets, which, words = words_of(texts, lambda t: pc.split_pattern(t, " "))
        of_word = [self.memo.get(w) for w in words]
        new = [i for i, known in enumerate(of_word) if known is None]
        cut = [self.parts(MARK + words[i]) if words[i] else [] for i in new]
        found = self.paths({p for parts in cut for p in parts})
        times = np.bincount(which, minlength=len(words))
        for i, parts in zip(new, cut, strict=True):
            ids = b"".join([found[p] for p in parts])
            same = self.decode(array("i", ids).tolist()) == words[i]
            of_word[i] = known = (ids, same)
            if times[i] >= OFTEN and len(self.memo) < MEMO:
                self.memo[words[i]] = known
        same_word = np.array([same for _, same in of_word], dtype=bool)
        of_word = [ids for ids, _ in of_word]
        lengths = np.array([len(x) // 4 for x in of_word], dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        pool = np.frombuffer(b"".join(of_word), dtype=np.int32)
        ids, same = [], np.ones(len(texts), dtype=bool)
        valid = texts.is_valid().to_numpy(zero_copy_only=False)
        for i in range(len(texts)):
            if odd[i]:
                ids.append(self.encode(texts[i].as_py()))
                same[i] = self.decode(ids[-1].tolist()) == texts[i].as_py()
            elif valid[i]:
                w = which[offsets[i]:offsets[i + 1]]
                n = lengths[w]
                at = np.repeat(starts[w] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                ids.append(pool[at])
                same[i] = bool(same_word[w].all())
            else:
                ids.append(pool[:0])
        ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        flat = np.concatenate(ids) if ids else pool[:0]
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, type=pa.int32()), mask=pa.array(~valid)), same

    def _one_by_one(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        some = texts.to_pylist()
        ids = [None if t is None else self.encode(t) for t in some]
        same = np.array([i is None or self.decode(i.tolist()) == t for i, t in zip(ids, some, strict=True)], dtype=bool)
        return pa.array(ids, type=pa.list_(pa.int32())), same

    def decode(self, ids) -> str:
        ids = [i for i in ids if i not in self.hidden]
        if self.unigram or self.normaliser.squeeze:
            return self._surfaces(ids)
        if not any(i in self.byte_of for i in ids):
            text = "".join([self.pieces[i] for i in ids])
        else:
            raw = b"".join(bytes((self.byte_of[i],)) if i in self.byte_of else self.pieces[i].encode() for i in ids)
            text = raw.decode("utf-8", "replace")
        text = text.replace(MARK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text

    def _surfaces(self, ids: list[int]) -> str:
        """Pieces behind each other; the mark in front is no space (where
        white space is squeezed, nor are those of the next pieces, as long as
        nothing else came)."""
        out, seen, squeeze = [], False, self.normaliser.squeeze
        for i in ids:
            if i in self.byte_of:
                part = bytes((self.byte_of[i],))
            elif i == self.unknown:
                part = self.surface.encode()
            else:
                piece = self.pieces[i]
                if (self.prefix or squeeze) and not seen and not any(out) and piece.startswith(MARK):
                    piece, seen = piece[1:], not squeeze
                part = piece.replace(MARK, " ").encode()
            out.append(part)
        return b"".join(out).decode("utf-8", "replace")


def transducer(model: str) -> PieceTransducer:
    path = model_path(model)
    return compiled(("pieces", path), lambda: PieceTransducer(path))


def encode(df: DataFrame, text_col: str = "text", out: str = "ids", model: str = MODEL,
           check: str | None = None) -> DataFrame:
    """``df`` with ``out``: the piece ids (array<int>) of the text; with
    ``check``, also whether decoding them gives the text back."""
    kinds = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())),
                          T.StructField("same", T.BooleanType())])

    @F.arrow_udf(kinds)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fst = transducer(model)
        for texts in batches:
            done = [fst.encode_batch(texts.slice(i, ROWS)) for i in range(0, len(texts), ROWS)]
            yield pa.concat_arrays([
                pa.StructArray.from_arrays([ids, pa.array(same, mask=~part.is_valid().to_numpy(zero_copy_only=False))],
                                           names=["ids", "same"])
                for (ids, same), part in zip(done, (texts.slice(i, ROWS) for i in range(0, len(texts), ROWS)),
                                             strict=True)] or [pa.array([], type=to_arrow_type(kinds))])

    rows = df.drop(out, check or out)
    found = rows.select(F.struct("*").alias("row"), run(F.col(text_col).cast("string")).alias("done"))
    extra = [F.col("done.same").alias(check)] if check else []
    return found.select("row.*", F.col("done.ids").alias(out), *extra)


def decode(ids: Column, model: str = MODEL) -> Column:
    """The text behind an array of piece ids (null: null)."""
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fst = transducer(model)
        for batch in batches:
            yield pd.Series([None if i is None else fst.decode(list(i)) for i in batch], dtype=object)

    return run(ids)
