"""A compressed full-text index of one shard of texts, over words.

The shard's words and one separator behind each text are sorted by suffix
(separators differ from each other, so no phrase crosses texts); the words
before the suffixes, in that order, are kept in a wavelet tree, level by level
as bit vectors with ranks. A phrase is found by backward search: each of its
words, from the last to the first, narrows the interval of suffixes by two
ranks. A suffix is located by walking back through the text until a sampled
position. All steps run over many phrases or suffixes at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Every SAMPLE-th word of the text, and the first of each text, is sampled.
SAMPLE = 8
LOCATE_AT_ONCE = 1 << 19


def _order(key: np.ndarray) -> np.ndarray:
    """Stable order of whole numbers, by one sort of (key, place) if it fits."""
    place = max(1, len(key) - 1).bit_length()
    if len(key) and int(key.max()).bit_length() + place <= 62:
        return np.sort(key << place | np.arange(len(key))) & ((1 << place) - 1)
    return np.argsort(key, kind="stable")


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling; a 0 is a separator, smaller than
    any word, and smaller than the separators behind it. Each round sorts
    only the suffixes that are still equal to a neighbour."""
    n, seps = len(text), np.flatnonzero(text == 0)
    rank = text + (len(seps) - 1)
    rank[seps] = np.arange(len(seps))
    after = np.append(rank[1:], 0)
    after[seps] = 0
    key = rank << int(rank.max()).bit_length() | after
    suffixes, slots, h = _order(key), np.arange(n), 2
    key = key[suffixes]
    part = suffixes
    while True:
        new = np.append(True, key[1:] != key[:-1])
        rank[part] = slots[np.maximum.accumulate(np.where(new, np.arange(len(part)), 0))]
        slots = slots[~(new & np.append(new[1:], True))]
        if not len(slots):
            return suffixes
        part = suffixes[slots]
        key = rank[part] * n + rank[part + h]
        order = _order(key)
        part, key = part[order], key[order]
        suffixes[slots] = part
        h *= 2


class Bits:
    """Bit vectors with the number of ones before every place."""

    def __init__(self, words: np.ndarray):
        self.words = words  # (levels, words), 64 bits each, one word to spare
        ones = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int64)
        self.before = np.concatenate([np.zeros((len(words), 1), dtype=np.int64), ones], axis=1)

    @staticmethod
    def packed(bits: np.ndarray) -> np.ndarray:
        out = np.zeros((len(bits) // 64 + 1) * 8, dtype=np.uint8)
        raw = np.packbits(bits, bitorder="little")
        out[:len(raw)] = raw
        return out.view(np.uint64)

    def get(self, level: int, at: np.ndarray) -> np.ndarray:
        return (self.words[level][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0

    def rank(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        low = self.words[level][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[level][word] + np.bitwise_count(low)


def build(words: pa.Array, lengths: np.ndarray) -> dict[str, bytes]:
    """The index of texts given as their words, one after the other, and their
    numbers of words; as the parts that ``FmIndex`` reads."""
    coded = words.dictionary_encode()
    ends = np.cumsum(lengths + 1) - 1
    text = np.zeros(int(lengths.sum()) + len(lengths), dtype=np.int64)
    is_word = np.ones(len(text), dtype=bool)
    is_word[ends] = False
    text[is_word] = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    suffixes = suffix_order(text)
    last = text[suffixes - 1]  # the word before each suffix; the first one's is a separator
    counts = np.bincount(text, minlength=len(coded.dictionary) + 1)
    depth, levels, row = max(1, (len(counts) - 1).bit_length()), [], last.astype(np.int32)
    for level in range(depth - 1, -1, -1):
        bits = (row >> level) & 1 != 0
        levels.append(Bits.packed(bits))
        row = np.concatenate([row[~bits], row[bits]])
    sampled = np.arange(len(text)) % SAMPLE == 0
    sampled[0] = True
    sampled[ends[:-1] + 1] = True
    marks = sampled[suffixes]
    return {"vocabulary": b"\n".join(coded.dictionary.to_pylist()), "counts": counts.astype(np.int32).tobytes(),
            "tree": np.stack(levels).tobytes(), "marks": Bits.packed(marks).tobytes(),
            "samples": suffixes[marks].astype(np.int32).tobytes()}


class FmIndex:
    def __init__(self, parts: dict[str, bytes]):
        self.counts = np.frombuffer(parts["counts"], dtype=np.int32).astype(np.int64)
        self.start = np.cumsum(self.counts) - self.counts  # separators first, then words
        depth = max(1, (len(self.counts) - 1).bit_length())
        self.tree = Bits(np.frombuffer(parts["tree"], dtype=np.uint64).reshape(depth, -1))
        self.marks = Bits(np.frombuffer(parts["marks"], dtype=np.uint64).reshape(1, -1))
        self.samples = np.frombuffer(parts["samples"], dtype=np.int32).astype(np.int64)
        self.n, self.depth = int(self.counts.sum()), depth
        self.zeros = self.n - self.tree.before[:, -1]
        words = parts["vocabulary"].split(b"\n") if len(self.counts) > 1 else []
        self.vocabulary = pa.array(words, pa.binary())
        # where a word's places begin on the lowest level: words by reversed bits
        symbols, mirrored = np.arange(len(self.counts)), np.zeros(len(self.counts), dtype=np.int64)
        for level in range(depth):
            mirrored = mirrored << 1 | (symbols >> level) & 1
        order = np.argsort(mirrored)
        self.base = np.empty_like(self.start)
        self.base[order] = np.cumsum(self.counts[order]) - self.counts[order]

    def symbols(self, words: pa.Array) -> np.ndarray:
        """The numbers of words in this shard, 0 for one that it lacks."""
        if not len(self.vocabulary):
            return np.zeros(len(words), dtype=np.int64)
        return pc.fill_null(pc.index_in(words, value_set=self.vocabulary), -1).to_numpy().astype(np.int64) + 1

    def _rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often a word stands among the first ``at`` of the tree."""
        for level in range(self.depth):
            one = (symbol >> (self.depth - 1 - level)) & 1 != 0
            ones = self.tree.rank(level, at)
            at = np.where(one, self.zeros[level] + ones, at - ones)
        return at - self.base[symbol]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of suffixes that begin with the phrases: rows of
        symbols, 0 where the shard lacks the word, -1 in front of short ones."""
        low, high = np.zeros(len(phrases), dtype=np.int64), np.zeros(len(phrases), dtype=np.int64)
        alive = np.flatnonzero((phrases != 0).all(axis=1) & (phrases[:, -1] > 0) if len(phrases) else [])
        last = phrases[alive, -1]
        low[alive], high[alive] = self.start[last], self.start[last] + self.counts[last]
        for column in range(phrases.shape[1] - 2, -1, -1):
            alive = alive[(phrases[alive, column] > 0) & (high[alive] > low[alive])]
            if not len(alive):
                break
            symbol = phrases[alive, column]
            low[alive] = self.start[symbol] + self._rank(symbol, low[alive])
            high[alive] = self.start[symbol] + self._rank(symbol, high[alive])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of suffixes, given their numbers in order."""
        out, steps = np.empty(len(rows), dtype=np.int64), 0
        todo, rows = np.arange(len(rows)), rows.copy()
        while len(todo):
            known = self.marks.get(0, rows)
            out[todo[known]] = self.samples[self.marks.rank(0, rows[known])] + steps
            todo, rows, steps = todo[~known], rows[~known], steps + 1
            symbol, at = np.zeros(len(rows), dtype=np.int64), rows
            for level in range(self.depth):
                one = self.tree.get(level, at)
                ones = self.tree.rank(level, at)
                symbol = symbol << 1 | one
                at = np.where(one, self.zeros[level] + ones, at - ones)
            rows = self.start[symbol] + at - self.base[symbol]
        return out

    def occurrences(self, phrases: np.ndarray):
        """(phrase, place) arrays of every occurrence, some at a time."""
        low, high = self.search(phrases)
        found = np.flatnonzero(high > low)
        upto = np.cumsum(high[found] - low[found])
        for at in range(0, int(upto[-1]) if len(upto) else 0, LOCATE_AT_ONCE):
            number = np.arange(at, min(at + LOCATE_AT_ONCE, int(upto[-1])))
            which = np.searchsorted(upto, number, side="right")
            rows = high[found[which]] - (upto[which] - number)
            yield found[which], self.locate(rows)
