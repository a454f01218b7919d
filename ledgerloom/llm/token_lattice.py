"""Byte-pair encoding as a finite-state problem (used by encoding and by
token counts).

BPE's output is the one segmentation in which every two neighbours are
stable: merging their symbols greedily gives back the same two tokens. So
the transducer's states remember the last token, an arc to the next token has
weight zero if the pair is stable and no arc otherwise, and the shortest path
over an input is what greedy merging would give, found in one pass from left
to right. Each prefix has exactly one finite path, so a state is one last
token per position still open and the trie nodes there, and every move can
say how many tokens it adds to the prefix's count.
"""

from __future__ import annotations

import math
import sys
import types
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa

PAIR_MEMO = 300_000


def compiled(key: tuple, build: Callable):
    """``build()`` once for each Python worker, which Spark reuses for many tasks."""
    kept = sys.modules.setdefault("_ledgerloom_compiled", types.ModuleType("_ledgerloom_compiled")).__dict__
    if key not in kept:
        kept[key] = build()
    return kept[key]


class TokenLattice:
    """Tokens are tuples of symbols; ``rank(a, b)`` is the priority of merging
    two adjacent ones (smaller first), None if they don't merge."""

    def __init__(self, tokens: Iterable[tuple], rank: Callable[[tuple, tuple], float | None]):
        self.rank = rank
        self.children: list[dict] = [{}]
        self.token: list[tuple | None] = [None]
        self.edge_memo: dict = {}
        self.stable_memo: dict[tuple, bool] = {}
        for t in tokens:
            self._add(t)

    def _add(self, symbols: tuple) -> int:
        at = 0
        for s in symbols:
            after = self.children[at].get(s)
            if after is None:
                after = self.children[at][s] = len(self.children)
                self.children.append({})
                self.token.append(None)
            at = after
        self.token[at] = symbols
        return at

    def _merge(self, symbols: tuple) -> list[tuple]:
        """Greedy merging by rank, leftmost first, of a short input: the
        trees (token, rank of its merge, left tree, right tree) it ends with."""
        parts: list[tuple] = [((s,), -math.inf, None, None) for s in symbols]
        while len(parts) > 1:
            ranks = [self.rank(a[0], b[0]) for a, b in zip(parts, parts[1:])]
            best = min((r for r in ranks if r is not None), default=None)
            if best is None:
                break
            i = ranks.index(best)
            parts[i:i + 2] = [(parts[i][0] + parts[i + 1][0], best, parts[i], parts[i + 1])]
        return parts

    def _edges(self, token: tuple) -> tuple | None:
        """(tokens at the right edge, tokens at the left edge), each from
        symbol to whole with the rank that forms the next; None if the token
        is not what its own symbols merge to, False if ranks don't rise."""
        known = self.edge_memo.get(token)
        if known is None and token not in self.edge_memo:
            trees = self._merge(token)
            if len(trees) == 1 and trees[0][0] == token:
                known = []
                for side in (3, 2):
                    chain, tree, above = [], trees[0], math.inf
                    while tree is not None:
                        chain.append((tree[0], above))
                        rises, above, tree = tree[1] <= above, tree[1], tree[side]
                        if not rises:
                            known = False
                            break
                    if known is False:
                        break
                    known.append(chain[::-1])
            self.edge_memo[token] = known
        return known

    def stable(self, left: tuple | None, token: tuple) -> bool:
        """Whether ``token`` can follow ``left`` (None: the beginning)."""
        known = self.stable_memo.get((left, token))
        if known is None:
            if len(self.stable_memo) >= PAIR_MEMO:
                self.stable_memo.clear()
            known = self.stable_memo[left, token] = self._stable(left, token)
        return known

    def _stable(self, left: tuple | None, token: tuple) -> bool:
        own = self._edges(token)
        if own is None or left is None:
            return own is not None
        before = self._edges(left)
        if own is False or before is False:
            return [t[0] for t in self._merge(left + token)] == [left, token]
        # replay the merges at the border in the order of their ranks: does one across it come first?
        right_edge, left_edge = before[0], own[1]
        i = j = 0
        while True:
            (a, a_next), (b, b_next) = right_edge[i], left_edge[j]
            across = self.rank(a, b)
            if across is not None and across < a_next and across <= b_next:
                return False
            if a_next == b_next == math.inf:
                return True
            if a_next <= b_next:
                i += 1
            else:
                j += 1

    def walk(self, words: Iterable[Sequence]) -> Iterator[tuple[list, list, list]]:
        """For each word the state behind every prefix: its last token, where
        that begins, and its number of tokens. A word keeps the states of the
        prefix it shares with the one before, so sorted words are read fast.
        The lists are reused for the next word."""
        children, token, memo = self.children, self.token, self.stable_memo
        last: list = [None]
        begin, count = [0], [0]
        live: list[list] = [[]]  # per prefix: (begin of an open token, its node), longest first
        before: Sequence = ()
        for word in words:
            i, end = 0, min(len(before), len(word))
            while i < end and before[i] == word[i]:
                i += 1
            del last[i + 1:], begin[i + 1:], count[i + 1:], live[i + 1:]
            before = word
            for i in range(i, len(word)):
                s, chosen, still = word[i], None, []
                for j, node in live[i]:
                    after = children[node].get(s)
                    if after is None:
                        continue
                    if children[after]:
                        still.append((j, after))
                    if chosen is None and (t := token[after]) is not None:
                        known = memo.get((last[j], t))
                        if self.stable(last[j], t) if known is None else known:
                            chosen, start = t, j
                after = children[0].get(s)
                if after is None:  # outside the vocabulary: a token of its own
                    after = self._add((s,))
                if children[after]:
                    still.append((i, after))
                if chosen is None:
                    chosen, start = token[after], i
                    if chosen is None or not self.stable(last[i], chosen):
                        raise ValueError(f"no path over {word!r}")
                last.append(chosen)
                begin.append(start)
                count.append(count[start] + 1)
                live.append(still)
            yield last, begin, count

    @staticmethod
    def path(last: list, begin: list) -> list:
        """The tokens of the whole word."""
        out, i = [], len(last) - 1
        while i:
            out.append(last[i])
            i = begin[i]
        return out[::-1]


def words_of(texts: pa.Array, split: Callable) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Texts split to words by an Arrow function: offsets of each text's
    words, their numbers in the list of distinct words, and that list."""
    lists = split(texts.fill_null(""))
    coded = lists.flatten().dictionary_encode()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def sum_lists(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return upto[offsets[1:]] - upto[offsets[:-1]]
