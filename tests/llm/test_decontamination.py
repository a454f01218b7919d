"""FM-index and decontamination against plain search."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import decontamination as dc
from ledgerloom.llm.fm_index import FmIndex, build, suffix_order

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute(docs, items, window=10):
    """doc rows (id, text), item rows (id, text): (id, n_words, n_hit, n_items, digest, spans)."""
    wins = {}
    for i, t in items:
        w = plain_words(t)
        for j in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[j:j + window]), set()).add("" if i is None else str(i))
    sizes = {len(w) for w in wins}
    out = []
    for i, t in docs:
        w, hit, found = plain_words(t), set(), set()
        for m in sizes:
            for j in range(len(w) - m + 1):
                got = wins.get(tuple(w[j:j + m]))
                if got:
                    hit |= set(range(j, j + m))
                    found |= got
        spans = [(a, b + 1) for a, b in zip(sorted(p for p in hit if p - 1 not in hit),
                                            sorted(p for p in hit if p + 1 not in hit), strict=True)]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), spans))
    return out


def run(spark, docs, items, parts=3, **kw):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, items string, key int").repartition(parts)
    b = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, doc_id string")
    shard = kw.pop("shard", dc.SHARD)
    index, _ = dc.build_index(d, shard=shard)
    found = dc.search(index, b, **kw)
    spans = {}
    for r in found.collect():
        spans.setdefault((r.id, r.n_words), []).append([(s.start, s.end) for s in r.spans])
    rows = [(r.id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in dc.report(found).collect()]
    assert all(r.contaminated == (r.n_hit > 0) for r in dc.report(found).collect())
    return rows, spans


KEY = lambda r: tuple(str(x) for x in r)


def check(spark, docs, items, **kw):
    got, spans = run(spark, docs, items, **kw)
    want = brute(docs, items)
    assert sorted(got, key=KEY) == sorted([w[:5] for w in want], key=KEY)
    for i, n, *_, s in want:
        assert s in spans[i, n]


def corpus(seed, n=40, vocabulary=30, longest=200):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["Élan", "ÑU", "x9", "日本"]
    text = lambda k: "".join(rnd.choice(words) + rnd.choice([" ", ", ", "\n", "-"]) for _ in range(k))
    items = [(i, text(rnd.choice([1, 3, 9, 10, 11, 25]))) for i in range(12)]
    docs = []
    for i in range(n):
        t = text(rnd.randint(0, longest))
        if i % 3 == 0:
            t += " " + rnd.choice(items)[1].upper() + " " + text(3)
        docs.append((i, t))
    return docs, items


def test_suffix_order():
    rnd = np.random.default_rng(1)
    for n, letters in ((1, 1), (50, 2), (300, 3), (2000, 40)):
        text = rnd.integers(1, letters + 1, n)
        text[rnd.random(n) < .05] = 0
        text[-1] = 0
        order = iter(range(n))
        named = [(0, next(order)) if c == 0 else (1, int(c)) for c in text]
        assert suffix_order(text.astype(np.int64)).tolist() == sorted(range(n), key=lambda i: named[i:])


@pytest.mark.parametrize("letters", [1, 2, 7, 500])
def test_search_and_locate(letters):
    rnd = random.Random(letters)
    texts = [[f"v{rnd.randint(1, letters)}" for _ in range(rnd.randint(0, 60))] for _ in range(25)] + [["v1"] * 40] * 3
    flat = pa.array([w.encode() for t in texts for w in t], pa.binary())
    index = FmIndex(build(flat, np.array([len(t) for t in texts])))
    whole = [w for t in texts for w in [*t, None]]
    known = index.vocabulary.to_pylist()
    for m in (1, 2, 4):
        phrases = {tuple(rnd.choice(known) for _ in range(m)) for _ in range(20)}
        phrases |= {tuple(w.encode() for w in t[i:i + m]) for t in texts for i in range(0, len(t) - m, 7)}
        phrases = sorted(phrases)
        rows = np.array([index.symbols(pa.array(p, pa.binary())) for p in phrases])
        rows = np.concatenate([np.full((len(rows), 2), -1), rows], axis=1)
        got = sorted((int(a), int(b)) for which, place in index.occurrences(rows) for a, b in zip(which, place, strict=True))
        want = sorted((k, i) for k, p in enumerate(phrases) for i in range(len(whole) - m + 1)
                      if whole[i:i + m] == [w.decode() for w in p])
        assert got == want
    assert index.symbols(pa.array([b"unknown"], pa.binary())).tolist() == [0]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_search(spark, seed):
    check(spark, *corpus(seed))


def test_small_vocabulary_many_overlaps(spark):
    docs, items = corpus(3, vocabulary=2)
    check(spark, docs, items)


def test_pieces_and_blocks(spark):
    """Documents longer than a shard, more windows than a block."""
    docs, items = corpus(5, n=20, vocabulary=4, longest=150)
    check(spark, docs, items, shard=25, block=16)
    check(spark, docs, items, shard=64, block=7, parts=1)


def test_odd_rows(spark):
    long = " ".join(f"q{i}" for i in range(40_000))
    items = [(1, "one two three"), (1, "four five six seven eight nine ten eleven twelve thirteen fourteen"),
             (None, "One, two THREE"), (2, None), (3, ""), (4, "--"), (5, " ".join(f"q{i}" for i in range(39_980, 39_999)))]
    docs = [(1, None), (2, ""), (3, "..."), (4, "zero one two three four"), (4, "zero one two three four"), (4, "another"),
            (None, "ONE two three"), (5, long), (6, "onetwo three"), (7, "one two"), (8, "three\x00one two\tthree")]
    check(spark, docs, items)
    check(spark, docs, items, shard=1000)


def test_words_do_not_cross_texts(spark):
    docs = [(i, t) for i, t in enumerate(["alpha", "beta", "alphabeta", "", "alpha beta"])]
    check(spark, docs, [(1, "alphabeta"), (2, "alpha beta")], parts=1)


def test_empty_tables(spark):
    docs, items = corpus(1, n=5)
    assert run(spark, [], items)[0] == []
    rows, _ = run(spark, docs, [])
    assert sorted(r[0] for r in rows) == list(range(5)) and all(r[2] == r[3] == 0 for r in rows)


def test_remove_cuts_the_passages(spark):
    docs = [(1, "keep this; ONE, two three! and this"), (1, "other text"), (2, None), (3, "one two three"), (3, "one two three")]
    d = spark.createDataFrame([(i, t, "s", 7) for i, t in docs], "doc_id long, text string, spans string, start int")
    b = spark.createDataFrame([(9, "one two three")], "item_id long, text string")
    got = dc.remove(d, b)
    assert got.columns == d.columns
    assert sorted((str(r.doc_id), str(r.text), r.spans) for r in got.collect()) == sorted([
        ("1", "keep this; ! and this", "s"), ("1", "other text", "s"), ("2", "None", "s"), ("3", "", "s"), ("3", "", "s")])
