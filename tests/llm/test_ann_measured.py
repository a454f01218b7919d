"""Recall and the share of rows opened, measured; vectors of any finite size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import learned_ann

def asks():
    return F.col("vec_id") % 100 == 0


def measured(df, **kw):
    stats = {}
    found = learned_ann.search(df, asks(), stats=stats, **kw)
    return learned_ann.recall(found, learned_ann.search(df, asks(), coverage=1.0)), stats


def test_given_embeddings(spark):
    """sf0.1: vectors without structure (neighbours share a label as often
    as chance has it), so most rows are opened."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    recall, stats = measured(df)
    print(f"sf0.1: recall {recall:.3f}, opened {stats['opened']:.2f} in {stats['parts']} parts")
    assert recall >= 0.9 and stats["opened"] < 1


def test_fifty_thousand_clustered_vectors(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(0, 1, (300, 32))
    x = (centers[rng.integers(0, 300, 50_000)] + rng.normal(0, 0.25, (50_000, 32))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(8)
    recall, stats = measured(df)
    print(f"clustered: recall {recall:.3f}, opened {stats['opened']:.3f} in {stats['parts']} parts")
    assert recall >= 0.9 and stats["opened"] <= 1 / 3


@pytest.mark.parametrize("scale", [1e200, 1e-200, 3e307])
def test_finite_vectors_of_any_size(spark, scale):
    rng = np.random.default_rng(2)
    base = rng.uniform(-1, 1, (40, 4))
    df = spark.createDataFrame([(i, (v * scale).tolist()) for i, v in enumerate(base)], "vec_id long, embedding array<double>")
    got = learned_ann.search(df, F.col("vec_id") % 10 == 0, k=5, coverage=1.0).toPandas()
    x = base * scale
    for q in range(0, 40, 10):
        top = np.abs(x - x[q]).max(axis=1)
        with np.errstate(all="ignore"):
            d = np.where(top == 0, 0, top * np.sqrt((((x - x[q]) / np.where(top == 0, 1, top)[:, None]) ** 2).sum(axis=1)))
        want = sorted((s, i) for i, s in enumerate(d) if i != q)[:5]
        g = got[got["query_id"] == q].sort_values("rank")
        assert g["vec_id"].tolist() == [i for _, i in want]
        assert np.allclose(g["score"], [s for s, _ in want], rtol=1e-12)


def test_one_huge_vector_among_small_ones(spark):
    rng = np.random.default_rng(3)
    x = [v.tolist() for v in rng.normal(size=(60, 3))] + [[1e300, 0.0, 0.0]]
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    got = learned_ann.search(df, F.col("vec_id") % 20 == 0, k=4).toPandas()
    y = np.array(x[:60])
    for q in (0, 20, 40):
        d = np.sqrt(((y - y[q]) ** 2).sum(axis=1))
        want = sorted((s, i) for i, s in enumerate(d) if i != q)[:4]
        assert list(got[got["query_id"] == q].sort_values("rank")["vec_id"]) == [i for _, i in want]


def test_the_result_does_not_depend_on_partitions(spark):
    """Repeated ids at the border of the fitting sample."""
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i // 3, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 4)))],
                               "vec_id long, embedding array<double>")
    one, two = (learned_ann.search(d, F.col("vec_id") % 10 == 0, sample=100, coverage=0.6).toPandas()
                .sort_values(["query_id", "rank"]).values.tolist() for d in (df.repartition(1), df.repartition(7)))
    assert one == two
