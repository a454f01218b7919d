"""Groups that hold most rows: one id, one shingle."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import common, jaccard_join, packing, sharding
from test_neighbours_and_join import brute_components


@pytest.mark.parametrize("id_", ["7", "CAST(NULL AS LONG)"])
def test_two_hundred_thousand_rows_of_one_id(spark, monkeypatch, id_):
    written, stored = [], common.stored
    monkeypatch.setattr(common, "stored", lambda df, name: written.append(stored(df, name)) or written[-1])
    df = spark.range(200_000).selectExpr(f"{id_} AS doc_id", "CAST(id % 3 AS LONG) AS n_tokens")
    got = common.numbered(df, "doc_id", ["n_tokens"], "number")
    parts = written[0].groupBy("_part").count().agg(F.max("count")).first()[0]
    assert parts < 20_000
    low, high, n, distinct = got.agg(F.min("number"), F.max("number"), F.count("number"), F.countDistinct("number")).first()
    assert (low, high, n, distinct) == (0, 199_999, 200_000, 200_000)
    # in the order given, whatever the partitions
    edges = got.groupBy("n_tokens").agg(F.min("number").alias("a"), F.max("number").alias("z")).orderBy("n_tokens").collect()
    assert [(r.a, r.z) for r in edges] == [(0, 66_666), (66_667, 133_333), (133_334, 199_999)]


def test_numbers_in_groups_ignore_partitioning(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice([1, 1, 1, None, *range(50)]), rnd.randint(0, 4), rnd.choice("ab")) for _ in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, n long, g string")
    key = lambda d: sorted(map(str, (tuple(r) for r in common.numbered(d, "doc_id", ["n"], "number", by=["g"]).collect())))
    one, two = key(df.repartition(9)), key(df.coalesce(1))
    assert one == two
    for g in "ab":
        assert sorted(int(x.split(", ")[-1][:-1]) for x in one if f"'{g}'" in x) == list(range(sum(r[2] == g for r in rows)))


def test_packing_and_sharding_of_one_id(spark):
    df = spark.range(3000).selectExpr("1L AS doc_id", "repeat('w ', CAST(id % 5 AS INT)) AS text")
    rows = sharding.shard_rows(df, shards=7).toPandas()
    sizes = rows.groupby("shard").size()
    assert len(rows) == 3000 and sizes.max() - sizes.min() <= 1
    packed = packing.pack(df, budget=20).toPandas()
    assert len(packed) == 3000 and not packed.duplicated(["bucket", "batch", "slot"]).any()


def run_of(n, follow, sizes):
    """Rows of one shingle, one for each of n groups."""
    label = np.arange(n, dtype=np.int64)
    columns = [np.full(n, 5), label, label, sizes, np.full(n, follow), np.ones(n)]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=list(jaccard_join._ROW))


def spent(n, follow, sizes):
    t = time.process_time()
    rows = sum(b.num_rows for b in jaccard_join._group_pairs(iter([run_of(n, follow, sizes)])))
    return time.process_time() - t, rows


def test_a_run_without_pairs_is_linear():
    """Groups of a shingle that can't be the first that two have in common."""
    few, found = spent(5_000, 10, np.full(5_000, 100))
    many, found_many = spent(40_000, 10, np.full(40_000, 100))
    assert found == found_many == 0
    assert many < 20 * max(few, 0.01)  # 64 times if quadratic
    # and sizes too different to link
    assert spent(30, jaccard_join.ALL, 10 * 2 ** np.arange(30))[1] == 0


def test_long_runs_leave_a_task(monkeypatch):
    monkeypatch.setattr(jaccard_join, "RUN_PAIRS", 1000)
    out = list(jaccard_join._group_pairs(iter([run_of(100, jaccard_join.ALL, np.full(100, 20))])))
    assert [b.column("long").to_pylist() for b in out] == [[1] * 100]


def template_texts(n, own, seed=1):
    """A common template with some words of each text's own."""
    rnd = random.Random(seed)
    template = [f"t{i}" for i in range(30)]
    return [(i, " ".join(template[:rnd.choice([30, 30, 25])] + [f"x{rnd.randrange(10**9)}" for _ in range(rnd.randint(0, own))]))
            for i in range(n)]


@pytest.mark.parametrize("rows,pairs,block", [(1 << 16, 20, 8), (5, 1 << 24, 4)])
def test_runs_dealt_out_give_the_same_components(spark, docs, monkeypatch, rows, pairs, block):
    for name, value in (("RUN_ROWS", rows), ("RUN_PAIRS", pairs), ("RUN_BLOCK", block), ("HOT_MIN", 4)):
        monkeypatch.setattr(jaccard_join, name, value)
    found = template_texts(60, 12, seed=rows) + [(1000 + i, t) for i, (_, t) in enumerate(template_texts(20, 3, seed=2))]
    got = jaccard_join.group_documents(docs(found).repartition(3)).collect()
    assert sorted((r.node, r.n_shingles, r.component) for r in got) == brute_components(found)
