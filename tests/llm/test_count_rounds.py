"""State maps of a long text are composed in rounds of neighbours."""

import random

import pytest

from ledgerloom.llm import token_counts
from ledgerloom.llm.sentencepiece_fst import model_path

TEXTS = ["two words and 12 digits, then more " * 40, "x" * 900, "ab" * 300 + " " + "cd" * 300, "7" * 700,
         "<|endoftext|>don't " * 60, "\u4e2d\u6587" * 400]


def test_maps_compose_in_any_grouping():
    fst = token_counts.CountingTransducer(model_path(token_counts.MODEL))
    rng = random.Random(4)
    for text in TEXTS:
        maps = [fst.state_map(c) for c in fst.cuts(text, 20)]
        while len(maps) > 1:
            at, n = rng.randrange(len(maps) - 1), rng.randint(2, 5)
            maps[at:at + n] = [fst.merge(maps[at:at + n])]
        assert fst.close(*maps[0]) == fst.count(text), text[:40]


@pytest.mark.parametrize("fan", [2, 16])
def test_no_step_holds_all_maps_of_a_text(spark, monkeypatch, fan):
    monkeypatch.setattr(token_counts, "FAN", fan)
    fst = token_counts.CountingTransducer(model_path(token_counts.MODEL))
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    df = token_counts.count_tokens(rows, chunk=100)
    rounds, left = 0, max(map(len, TEXTS)) // 100 + 1
    while left > 1:
        rounds, left = rounds + 1, -(-left // fan)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(") == rounds
    assert {r.doc_id: r.n_tokens for r in df.collect()} == {i: fst.count(t) for i, t in enumerate(TEXTS)}
