"""Query rows that share an id are one query."""

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import learned_ann


def test_repeated_queries_keep_k_different_neighbours(spark, monkeypatch):
    monkeypatch.setattr(learned_ann, "BLOCK", 20)  # a part of several blocks
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    other = rng.normal(size=6)
    # id 0 asks twice with one vector, id 1 with two; candidate 50 is there twice
    rows += [rows[0], (1, other.tolist()), rows[50]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = learned_ann.search(df, F.col("vec_id") < 3, parts=1).collect()
    for q, vectors in ((0, [x[0]]), (1, [x[1], other]), (2, [x[2]])):
        want = sorted((min(np.sqrt(((np.array(v) - w) ** 2).sum()) for w in vectors), i) for i, v in rows if i != q)[:10]
        found = sorted((r["rank"], r.score, r.vec_id) for r in got if r.query_id == q)
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert [i for _, _, i in found] == [i for _, i in want]
        assert np.allclose([s for _, s, _ in found], [s for s, _ in want])
