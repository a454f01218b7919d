"""Vector codes against a plain integer k-means."""

import hashlib
import random

import numpy as np
import pytest

from ledgerloom.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<double>, label int, code string, bounds int"


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    """rows of (id, vector); returns codes, errors and last codebooks."""
    top = vc.limit(len(rows[0][1]))
    x = [[max(-top, min(top, int(np.floor(scale * float(c))))) for c in v] for _, v in rows]
    w = len(x[0]) // parts
    cut = [[tuple(v[p * w:(p + 1) * w]) for p in range(parts)] for v in x]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, x[i]))[:entries]
    books = [[cut[i][p] for i in order] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(c[p], e, strict=True)), j) for j, e in enumerate(books[p])) for p in range(parts)]
                for c in cut]

    for _ in range(rounds):
        near = assign()
        for p in range(parts):
            for j in range(len(books[p])):
                mine = [c[p] for c, n in zip(cut, near, strict=True) if n[p][1] == j]
                if mine:
                    books[p][j] = tuple(sum(col) // len(mine) for col in zip(*mine, strict=True))
    near = assign()
    return ["".join(f"{j:02x}" for _, j in n) for n in near], [sum(d for d, _ in n) for n in near], books


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, lab, "x", 1) for i, v, lab in rows], SCHEMA).repartition(3)
    coded, books = vc.compress(df, **kw)
    return vc.with_label_error(coded).collect(), books


def clustered(n, dims=8, seed=1):
    rnd = np.random.default_rng(seed)
    centers = rnd.normal(0, 1, (6, dims))
    return [(i, [float(v) for v in centers[i % 6] + rnd.normal(0, .2, dims)], i % 3 if i % 7 else None) for i in range(n)]


@pytest.mark.parametrize("entries", [3, 24])
def test_equals_plain_rounds(spark, entries):
    rows = clustered(150)
    got, books = run(spark, rows, entries=entries, groups=5)
    codes, errors, last = brute([(i, v) for i, v, _ in rows], entries=entries)
    by_label = {}
    for (_, _, lab), e in zip(rows, errors, strict=True):
        by_label[lab] = by_label.get(lab, 0) + e
    assert {r.vec_id: (r.code, r.error, r.label_error) for r in got} == {
        i: (c, e, by_label[lab]) for (i, _, lab), c, e in zip(rows, codes, errors, strict=True)}
    flat = [str(v) for book in last for e in book for v in e]
    assert books.sha256() == hashlib.sha256(",".join(flat).encode()).hexdigest()


def test_ties_repeats_and_hot_vector(spark):
    rnd = random.Random(4)
    same = [.5] * 8
    rows = [(i, same if i % 3 == 0 else [rnd.choice([-.5, 0., .25, .5]) for _ in range(8)], 1) for i in range(90)]
    rows += rows[:10]
    got, _ = run(spark, rows, entries=16, groups=4)
    codes, errors, _ = brute([(i, v) for i, v, _ in rows], entries=16)
    assert sorted((r.vec_id, r.code, r.error) for r in got) == sorted(
        (i, c, e) for (i, _, _), c, e in zip(rows, codes, errors, strict=True))


def test_odd_rows(spark):
    good = clustered(20)
    odd = [(100, None, 1), (101, [1.0, None] + [0.0] * 6, 1), (102, [float("nan")] * 8, 1), (103, [float("inf")] * 8, 1),
           (104, [1.0], 1), (105, [], 1)]
    huge = [(None, [0.0] * 8, None), (106, [1e200, -1e200] + [0.0] * 6, 2), (107, [3e5] * 8, 2)]
    got, _ = run(spark, good + odd + huge, entries=8)
    kept = good + huge
    codes, errors, _ = brute([(i, v) for i, v, _ in kept], entries=8)
    assert sorted(((r.vec_id or -1), r.code, r.error) for r in got) == sorted(
        ((i or -1), c, e) for (i, _, _), c, e in zip(kept, codes, errors, strict=True))


def test_length_that_does_not_divide(spark):
    rows = [(i, v[:6], lab) for i, v, lab in clustered(40)]
    got, books = run(spark, rows, entries=8)
    codes, errors, _ = brute([(i, v + [0.0, 0.0]) for i, v, _ in rows], entries=8)
    assert {r.vec_id: (r.code, r.error) for r in got} == {i: (c, e) for (i, _, _), c, e in zip(rows, codes, errors, strict=True)}
    assert len(books.decode(got[0].code)) == 6


def test_empty_table(spark):
    got, books = run(spark, [])
    assert got == [] and books is None


def test_bounds_hold_and_save_scans(spark):
    """The lowered bound never exceeds the true distance, and later rounds
    scan less than the first."""
    rnd = np.random.default_rng(5)
    x = rnd.integers(-300, 300, (400, 6)).astype(np.int64) + 2000 * rnd.integers(0, 8, (400, 1))
    book = x[:32].copy()
    groups = vc.split_entries(book, 8)
    assert sorted(np.concatenate(groups)) == list(range(32))
    history = [book[None]]
    code, bound = np.full(400, -1), np.zeros((400, 8))
    stamp = np.zeros((400, 8), dtype=np.int64)
    scans = []
    for now in range(4):
        drift = vc.net_drift(history, [groups])[0]
        code, error, n = vc.assign_part(x, history[-1][0], groups, drift, now, code, bound, stamp)
        scans.append(n)
        true = ((x[:, None] - history[-1][0][None]) ** 2).sum(-1)
        assert (code == true.argmin(1)).all() and (error == true.min(1)).all()
        true[np.arange(400), code] = np.iinfo(np.int64).max
        least = np.stack([np.sqrt(true[:, g].min(1).astype(float)) for g in groups], axis=1)
        assert (bound - drift[stamp, np.arange(8)] <= least + 1e-9).all()
        new = history[-1][0].copy()
        for j in np.unique(code):
            new[j] = x[code == j].sum(0) // (code == j).sum()
        history.append(new[None])
    assert scans[0] == 400 * 8 and scans[-1] < scans[0] / 2


def test_scan_share_is_reported_and_books_decode(spark):
    shares = []
    got, books = run(spark, clustered(200, seed=3), entries=16, scanned=shares)
    assert len(shares) == 4 and shares[0] == 1.0 and shares[-1] < 1.0
    assert books.rows(spark).count() == 4 * 16
    assert len(books.decode(got[0].code)) == 8
