"""Token counts by a compiled finite-state tokenizer.

* A word is read by a deterministic transducer: its state is the set of open
  trie nodes with the tokens before them (``token_lattice``), and every
  transition is annotated with the number of tokens it adds to the count of
  the prefix read so far. A batch's distinct words are read in order, each
  from the state behind the prefix it shares with the last; the maps of
  parts found often are kept in a bounded memo.
* A text longer than CHUNK is cut into chunks that different tasks read. A
  chunk's state map is (open text before its first word boundary, tokens
  inside, open text after its last boundary); two maps compose by joining
  the open texts between them. Neighbouring maps are composed in rounds, FAN
  at a time (a prefix scan's up-sweep; the count of the whole needs no more),
  so no task holds a text's maps. What is left open is one stretch without
  white space or digits; that alone is carried on and read in one task.
  Cuts lie only where normalisation, contractions and special strings can't
  reach across.

Defined results: a null or empty text has no tokens; long texts are whole;
special strings in a text count as one token each, as the library's default
has it; rows are independent (repeated rows count each); an empty table gives
an empty result; other columns are kept.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import stored
from ledgerloom.llm.sentencepiece_fst import model_path
from ledgerloom.llm.token_lattice import TokenLattice, compiled, sum_lists, words_of

MODEL = "word_bpe_49k.json"
CHUNK, FAN = 65_536, 16
MEMO, OFTEN = 150_000, 4
# a word boundary whatever comes before and behind: white space, or next to a digit
HARD = regex.compile(r"\p{White_Space}|\p{N}")


def _byte_symbols() -> dict[str, int]:
    """Printable symbol to byte: printable Latin-1 stands for itself, the
    others follow from U+0100 on."""
    plain = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    rest = iter(range(256, 512))
    return {chr(b if b in plain else next(rest)): b for b in range(256)}


class CountingTransducer:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model["byte_fallback"] or model["ignore_merges"]:
            raise ValueError("a plain BPE tokenizer is needed")
        suffix = model["end_of_word_suffix"] or ""
        byte_of = _byte_symbols()

        def symbols(token: str) -> tuple[int, ...]:
            """Bytes; the last of a word is 256 more."""
            if suffix and token.endswith(suffix) and token != suffix:
                body = [byte_of[c] for c in token[:-len(suffix)]]
                return (*body[:-1], body[-1] + 256)
            return tuple(byte_of[c] for c in token)

        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ranks = {(symbols(a), symbols(b)): i for i, (a, b) in enumerate(merges)}
        self.last = 256 if suffix else 0
        self.lattice = TokenLattice(map(symbols, model["vocab"]), lambda a, b: ranks.get((a, b)))
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special)) or r"(?!)")
        self.reach = max(map(len, special), default=1)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern.replace(r"\s", r"\p{White_Space}")).findall
        self.memo: dict[str, int] = {}  # of parts found often

    def count_words(self, words: Iterable[str]) -> dict[str, int]:
        """The counts of distinct words of the pre-tokenizer."""
        symbols = {}
        for w in words:
            symbols[w] = raw = list(w.encode("utf-8", "replace"))
            raw[-1] += self.last
        order = sorted(symbols, key=symbols.get)
        return {w: count[-1] for w, (_, _, count) in
                zip(order, self.lattice.walk([symbols[w] for w in order]), strict=True)}

    def _count_normal(self, text: str) -> int:
        words = self.words(text)
        found = self.count_words(set(words))
        return sum([found[w] for w in words])

    def count_batch(self, texts: pa.Array) -> np.ndarray:
        """Tokens of every text. White space ends words whatever surrounds
        it, so the map of a text is the sum over its space-separated parts,
        each read once for the batch."""
        offsets, which, parts = words_of(texts, pc.ascii_split_whitespace)
        counts = [self.memo.get(p) for p in parts]
        new = [i for i, known in enumerate(counts) if known is None]
        plain = [self._plain(parts[i]) for i in new]
        cut = [self.words(p) for p, _ in plain]
        found = self.count_words({w for words in cut for w in words})
        times = np.bincount(which, minlength=len(parts))
        for i, words, (_, special) in zip(new, cut, plain, strict=True):
            counts[i] = special + sum([found[w] for w in words])
            if times[i] >= OFTEN and len(self.memo) < MEMO:
                self.memo[parts[i]] = counts[i]
        n = np.array(counts, dtype=np.int64)
        return sum_lists(n[which], offsets)

    @staticmethod
    def normalise(text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower-cased letter by letter
        return text.lower()

    def _plain(self, text: str) -> tuple[str, int]:
        """Normalised text with a line end for each special string, and their number."""
        parts = self.special.split(text)
        return "\n".join(map(self.normalise, parts)), len(parts) - 1

    def count(self, text: str) -> int:
        plain, n = self._plain(text)
        return n + self._count_normal(plain)

    def cuts(self, text: str, size: int) -> list[str]:
        """The text in chunks of about ``size`` that can be read apart."""
        out, begin = [], 0
        while len(text) - begin > size:
            at = begin + size
            while at < len(text) and not self._apart(text, at):
                at += 1
            out.append(text[begin:at])
            begin = at
        return [*out, text[begin:]]

    def _apart(self, text: str, at: int) -> bool:
        c = text[at]
        if unicodedata.category(c)[0] == "M" or unicodedata.name(c, "").startswith("HANGUL J"):
            return False  # it may compose with what is before
        if "'" in text[max(0, at - 3):at]:
            return False
        around = text[max(0, at - self.reach):at + self.reach]
        middle = min(at, self.reach)
        return not any(m.start() < middle < m.end() for m in self.special.finditer(around))

    def state_map(self, chunk: str) -> tuple[str, int, str | None]:
        """(open text in front, tokens inside, open text behind); None
        behind: the chunk has no boundary, so all of it is open."""
        plain, n = self._plain(chunk)
        first = HARD.search(plain)
        if first is None:
            return plain, n, None
        last = first.start() + 1
        for m in HARD.finditer(plain, max(first.start(), len(plain) - 4096)):
            last = m.end()
        if last == first.start() + 1:  # none in the end: look at all of it
            for m in HARD.finditer(plain, first.start()):
                last = m.end()
        return plain[:first.start()], n + self._count_normal(plain[first.start():last]), plain[last:]

    def merge(self, maps) -> tuple[str, int, str | None]:
        """The state map of neighbouring chunks from theirs, in order."""
        head, total, pending = None, 0, []
        for front, inside, behind in maps:
            pending.append(front)
            total += inside
            if behind is not None:
                if head is None:
                    head = "".join(pending)
                else:
                    total += self._count_normal("".join(pending))
                pending = [behind]
        if head is None:
            return "".join(pending), total, None
        return head, total, "".join(pending)

    def close(self, front: str, inside: int, behind: str | None) -> int:
        """The count of a text from its state map."""
        return inside + self._count_normal(front) + (self._count_normal(behind) if behind else 0)

    def compose(self, maps) -> int:
        """The count of a text from the state maps of its chunks, in order."""
        return self.close(*self.merge(maps))


def transducer(model: str) -> CountingTransducer:
    path = model_path(model)
    return compiled(("counts", path), lambda: CountingTransducer(path))


def count_tokens(df: DataFrame, text_col: str = "text", out: str = "n_tokens", model: str = MODEL,
                 chunk: int = CHUNK) -> DataFrame:
    """``df`` with ``out``, the number of tokens of the whole text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    @F.arrow_udf("long")
    def whole(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fst = transducer(model)
        for texts in batches:
            yield pa.array(fst.count_batch(texts), type=pa.int64())

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fst = transducer(model)
        for batch in texts:
            yield pd.Series([fst.cuts(t, chunk) for t in batch], dtype=object)

    maps_type = T.StructType([T.StructField("front", T.StringType()), T.StructField("inside", T.LongType()),
                              T.StructField("behind", T.StringType())])

    @F.pandas_udf(maps_type)
    def state_map(chunks: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fst = transducer(model)
        for batch in chunks:
            yield pd.DataFrame([fst.state_map(c) for c in batch], columns=maps_type.names)

    @F.pandas_udf(maps_type)
    def merge(runs: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fst = transducer(model)
        for batch in runs:
            yield pd.DataFrame([fst.merge((m["front"], m["inside"], m["behind"]) for m in maps) for maps in batch],
                               columns=maps_type.names)

    @F.pandas_udf("long")
    def close(maps: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        fst = transducer(model)
        for batch in maps:
            yield pd.Series([fst.close(f, n, None if pd.isna(b) else b)
                             for f, n, b in batch[maps_type.names].itertuples(index=False)], dtype="int64")

    rows = df.drop(out).select(F.struct("*").alias("row"), text.alias("text"))
    short = rows.filter(F.length("text") <= chunk).select("row.*", whole("text").alias(out))
    # a long text's chunks are dealt to all tasks; its row stays behind, found again by a number
    long_rows = stored(rows.filter(F.length("text") > chunk).withColumn("id", F.monotonically_increasing_id()), "long")
    chunks = long_rows.select("id", F.posexplode(cut("text")).alias("at", "chunk")).repartition("id", "at")
    maps = chunks.select("id", "at", state_map("chunk").alias("map"))
    # a chunk has at least `chunk` characters, but for the last
    left = (long_rows.agg(F.max(F.length("text"))).first()[0] or 0) // chunk + 1
    while left > 1:
        maps = (maps.groupBy("id", F.floor(F.col("at") / FAN).cast("int").alias("run"))
                .agg(F.sort_array(F.collect_list(F.struct("at", "map"))).alias("maps"))  # at most FAN
                .select("id", F.col("run").alias("at"), merge(F.transform("maps", lambda m: m["map"])).alias("map")))
        left = -(-left // FAN)
    counted = maps.select("id", close("map").alias("count"))
    return short.unionByName(long_rows.join(counted, "id").select("row.*", F.col("count").alias(out)))
