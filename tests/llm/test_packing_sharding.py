"""Packing against all boundary choices; sharding as a bijection."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import packing, sharding

WORDS = "[^\\x20\\x09-\\x0D]+"


def padding(lengths, bounds):
    return sum(min(b for b in bounds if b >= n) - n for n in lengths)


@pytest.mark.parametrize("seed", range(8))
def test_boundaries_are_optimal(seed):
    rnd = random.Random(seed)
    lengths = sorted(rnd.choice([1, 2, 3, 5, 9, 14, 40, 41, 90]) for _ in range(30))
    cells = [(lengths.count(n), n * lengths.count(n), n) for n in sorted(set(lengths))]
    for buckets in (1, 2, 3, 5, 20):
        got = packing.best_boundaries(cells, buckets)
        assert len(got) <= buckets and got[-1] == lengths[-1]
        sizes = [c[2] for c in cells]
        best = min(padding(lengths, [*pick, sizes[-1]]) for k in range(min(buckets, len(sizes)))
                   for pick in itertools.combinations(sizes[:-1], k))
        assert padding(lengths, got) == best


def test_no_cells():
    assert packing.best_boundaries([], 4) == []


def test_cells_are_few_and_close(spark):
    n = [0, 1, 2, 255, 256, 257, 1000, 1001, 10**6 + 1, 2**40 + 3]
    got = spark.createDataFrame([(x,) for x in n], "n long").select("n", packing.length_cell("n").alias("c")).collect()
    for r in got:
        assert r.n <= r.c <= r.n * 1.008 + 1 and (r.n > 255 or r.c == r.n)


def test_batches_keep_budget_and_all_rows(spark, small_docs):
    rows = packing.pack(small_docs, buckets=5, budget=3000).toPandas()
    assert sorted(rows["doc_id"]) == sorted(r.doc_id for r in small_docs.select("doc_id").collect())
    assert (rows["n_tokens"] <= rows["boundary"]).all() and (rows["padding"] == rows["boundary"] - rows["n_tokens"]).all()
    for (_, boundary, _), g in rows.groupby(["bucket", "boundary", "batch"]):
        assert sorted(g["slot"]) == list(range(len(g)))
        assert len(g) * max(boundary, 1) <= 3000 or len(g) == 1
    for _, g in rows.groupby("bucket"):  # only a bucket's last batch may have room
        sizes = g.groupby("batch").size().sort_index()
        assert list(sizes.index) == list(range(len(sizes))) and sizes.iloc[:-1].nunique() <= 1
    assert rows["over_budget"].equals(rows["n_tokens"] > 3000)


def test_odd_rows(docs):
    rows = docs([(1, None), (2, ""), (None, "a b"), (3, "x " * 70_000), (3, "x " * 70_000), (3, "y"), (None, None)])
    rows = rows.withColumn("n_tokens", F.lit("clash")).withColumn("_cell", F.lit(1)).withColumn("bucket", F.lit(None))
    got = packing.pack(rows).collect()
    assert sorted(r.n_tokens for r in got) == [0, 0, 0, 1, 2, 70_000, 70_000]
    assert [r.over_budget for r in got if r.n_tokens == 70_000] == [True, True]
    assert packing.pack(rows.limit(0)).collect() == []


def test_permutation_is_a_bijection():
    for n in (1, 2, 3, 16, 17, 1000, 4097):
        for seed in (0, 5):
            p = sharding.permute(np.arange(n), n, seed)
            assert sorted(p) == list(range(n))
            assert (sharding.permute(p, n, seed, back=True) == np.arange(n)).all()
    assert not (sharding.permute(np.arange(1000), 1000, 1) == sharding.permute(np.arange(1000), 1000, 2)).all()


def test_shards_differ_by_one_and_slots_have_no_gaps(spark, small_docs):
    rows = sharding.shard_rows(small_docs, shards=16, seed=3).toPandas()
    n = len(rows)
    sizes = rows.groupby("shard").size()
    assert n == small_docs.count() and sizes.max() - sizes.min() <= 1
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in rows.groupby("shard"))
    assert sorted(rows["row_number"]) == list(range(n))
    for r in rows.sample(20, random_state=1).itertuples():
        assert sharding.locate(r.shard, r.slot, n, 16, 3) == r.row_number
    texts = {r.doc_id: r.text for r in small_docs.collect()}
    for r in rows.itertuples():
        raw = texts[r.doc_id].encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)


def test_shard_layout_ignores_partitioning(small_docs):
    key = lambda df: sorted(map(tuple, sharding.shard_rows(df).collect()))
    assert key(small_docs.repartition(7)) == key(small_docs.coalesce(1))


def test_sharding_of_odd_rows(docs):
    rows = docs([(1, None), (1, None), (None, "é"), (2, "a"), (2, "b"), (5, "long " * 50_000)])
    rows = rows.withColumn("size", F.lit("clash")).withColumn("_mix", F.lit(0))
    got = sharding.shard_rows(rows, shards=4).toPandas()
    assert len(got) == 6 and sorted(got["size"]) == [1, 1, 2, 2, 3, 250_001]
    assert sharding.shard_rows(rows.limit(0)).collect() == []
