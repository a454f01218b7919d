"""Packing by a tokenizer's counts instead of white-space words."""

from pyspark.sql import functions as F

from ledgerloom.llm import packing, token_counts


def test_the_unit_is_stated_and_real_tokens_can_be_packed(spark):
    assert "white-space word" in packing.__doc__
    df = spark.createDataFrame([(0, "\u4e2d\u6587" * 300), (1, "unspaced" * 90), (2, "two words"), (3, None)],
                               "doc_id long, text string")
    words = {r.doc_id: r.n_tokens for r in packing.pack(df, budget=100).collect()}
    assert words == {0: 1, 1: 1, 2: 2, 3: 0}
    counted = token_counts.count_tokens(df)
    want = {r.doc_id: r.n_tokens for r in counted.collect()}
    got = packing.pack(counted, length=F.col("n_tokens"), budget=100).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want and want[0] > 100 and want[1] > 100
    assert all(r.over_budget == (r.n_tokens > 100) for r in got)
