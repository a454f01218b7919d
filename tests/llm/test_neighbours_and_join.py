"""Nearest neighbours and the Jaccard join against brute force; the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import jaccard_join, learned_ann, packing, quality_classifier, quality_rules


def brute_nearest(ids, x, asked, k=10):
    out = {}
    for q in asked:
        d = np.sqrt(((x - x[ids.index(q)]) ** 2).sum(axis=1))
        out[q] = sorted((s, i) for s, i in zip(d, ids, strict=True) if i != q)[:k]
    return out


@pytest.mark.parametrize("seed,blocks", [(0, False), (1, True)])
def test_recall_and_exact_scores(spark, monkeypatch, seed, blocks):
    if blocks:  # parts of several blocks, several blocks of queries
        monkeypatch.setattr(learned_ann, "BLOCK", 50)
        monkeypatch.setattr(learned_ann, "QUERY_BLOCK", 20)
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[700:1700] = x[700]  # a vector that a third of all rows share
    ids = list(range(3000))
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in zip(ids, x, strict=True)],
                               "vec_id long, embedding array<float>, part int").repartition(5)
    got = learned_ann.search(df, F.col("vec_id") % 50 == 0, parts=12).toPandas()
    want = brute_nearest(ids, x.astype(np.float64), [i for i in ids if i % 50 == 0])
    hits = 0
    for q, best in want.items():
        g = got[got["query_id"] == q].sort_values("rank")
        assert list(g["rank"]) == list(range(1, 11))
        pairs = list(zip(g["score"], g["vec_id"], strict=True))
        assert pairs == sorted(pairs)
        hits += len({i for _, i in best} & set(g["vec_id"]))
        for s, i in pairs:
            assert s == np.sqrt(((x[i].astype(np.float64) - x[q].astype(np.float64)) ** 2).sum())
        if 700 <= q < 1700:  # ties go to the smallest ids
            assert pairs == best
    assert hits >= 0.9 * 10 * len(want)


def test_partition_is_balanced():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 8))
    label = learned_ann.partition_graph(x, learned_ann._nearest(x, 10), 7)
    assert np.bincount(label, minlength=7).max() <= np.ceil(500 / 7 * 1.1)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]),
            (6, [1.0, 1.0]), (7, [1.0, 1.0]), (None, [1.0, 0.0]), (8, [1.0, 2.0, 3.0]), (9, []), (0, [1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = learned_ann.search(df, F.col("vec_id") == 0).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])][:2] == [6, 6] or {r.vec_id for r in got} == {6, 7}
    assert {r.vec_id for r in got} == {6, 7}
    assert learned_ann.search(df.limit(0), F.col("vec_id") == 0).collect() == []
    assert learned_ann.search(df.filter("vec_id = 6"), F.lit(True)).collect() == []


def shingles(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(
        {ord(c): " " for c in "\t\n\x0b\x0c\r"}).split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4)) if len(words) > 4 else frozenset([tuple(words)])


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if rows[i][0] == rows[j][0] or both and 100 * both >= 75 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows))


def planted(seed, n=160):
    """Copies, near copies around the threshold, chains and shared passages."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(3000)}"
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(n):
        kind = rnd.random()
        if kind < 0.35 or not texts:
            texts.append([word() for _ in range(rnd.randint(1, 160))])
        elif kind < 0.45:
            texts.append(list(rnd.choice(texts)))
        elif kind < 0.8:
            t = list(rnd.choice(texts))
            for _ in range(rnd.randint(1, 1 + len(t) // 25)):
                t[rnd.randrange(len(t))] = word()
            texts.append(t + [word() for _ in range(rnd.randint(0, len(t) // 6))])
        else:
            t = [word() for _ in range(rnd.randint(5, 40))]
            texts.append(t + passage + [word() for _ in range(rnd.randint(0, 20))])
    ids = rnd.sample(range(10_000), n)
    return [(i, rnd.choice([" ", "\n", "  "]).join(w.upper() if rnd.random() < 0.05 else w for w in t))
            for i, t in zip(ids, texts, strict=True)]


@pytest.mark.parametrize("seed,keys,hot,block", [(0, 6, 24, 256), (1, 6, 2, 1), (2, 1, 3, 2)])
def test_components_equal_brute_force(docs, monkeypatch, seed, keys, hot, block):
    monkeypatch.setattr(jaccard_join, "KEYS", keys)  # fewer keys: more is left to the matrix
    monkeypatch.setattr(jaccard_join, "HOT_MIN", hot)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "ASKING", block)
    rows = planted(seed)
    got = jaccard_join.group_documents(docs(rows).repartition(4))
    assert sorted((r.node, r.n_shingles, r.component) for r in got.collect()) == brute_components(rows)


def test_the_matrix_alone_finds_all_links(docs, monkeypatch):
    """Without any groups from minimum hashes the matrix must find each link."""
    monkeypatch.setattr(jaccard_join, "KEYS", 0)
    rows = planted(5, 120)
    got = jaccard_join.group_documents(docs(rows).repartition(3))
    assert sorted((r.node, r.n_shingles, r.component) for r in got.collect()) == brute_components(rows)


def test_odd_documents(docs):
    base = " ".join(f"x{i}" for i in range(50))
    rows = [(5, None), (6, ""), (7, " \n\t"), (8, "one two"), (9, "ONE  two"), (10, "one two three"), (None, base),
            (20, base), (21, base + " y"), (21, base + " y"), (30, "é É"), (31, "é é"), (40, "z " * 90_000),
            (41, "z z z z z"), (50, "a b c d e f"), (50, base + " k l")]
    df = docs(rows).withColumn("node", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("_out", F.lit(2))
    got = {}
    for r in jaccard_join.group_documents(df).collect():
        got.setdefault(r.node if r.node < jaccard_join.NULL_ID else None, set()).add((r.n_shingles, r.component))
    assert got[5] == {(0, 5)} and got[6] == {(0, 6)} and got[7] == {(0, 7)}
    assert got[8] == got[9] == {(1, 8)} and got[10] == {(1, 10)}
    assert {c for _, c in got[20] | got[21] | got[None]} == {20}
    assert got[30] == {(1, 30)} and got[31] == {(1, 31)}
    assert got[40] == got[41] == {(1, 40)}
    assert {c for _, c in got[50]} == {20}  # one id, two texts: one document
    kept = jaccard_join.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [5, 6, 7, 8, 10, 20, 30, 31, 40]
    assert jaccard_join.keep_one(df.limit(0)).collect() == []
    assert jaccard_join.group_documents(df.limit(0)).collect() == []


def test_pipeline_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).collect())
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality_classifier.fit(docs, labels)
    score = model.scorer()
    rows = [r for r in docs.collect() if model.tails(np.array([score(r.text)]))[1][0] >= 0.5]
    bad = quality_rules.rejected_hosts(quality_rules.measure(spark.createDataFrame(rows, docs.schema)), "source", 0.5)
    bad = {r.host for r in bad.collect()}

    def passes(r):
        n, _, _, _, _, repeats = quality_rules.counts_of(r.text)
        return n >= 10 and 100 * repeats <= 20 * n and r.source not in bad

    rows = [r for r in rows if passes(r)]
    keep = {c for _, _, c in brute_components([(r.doc_id, r.text) for r in rows])}
    rows = [r for r in rows if r.doc_id in keep]
    assert sorted(r[0] for r in got) == sorted(r.doc_id for r in rows)
    lengths = sorted(len([w for w in (r.text or "").split() if w]) for r in rows)
    cells = [(lengths.count(n), 0, n) for n in sorted(set(lengths))]
    if max(lengths) < 256:
        assert sorted({r[3] for r in got}) == packing.best_boundaries(cells, 16)
    assert all(r[1] <= r[3] for r in got) and len({(r[2], r[4], r[5]) for r in got}) == len(got)


def test_stages_return_the_columns_of_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
