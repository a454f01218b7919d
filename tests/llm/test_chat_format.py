"""Formatting and reading back, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import chat_format as cf

PIECES = ["<|im_end|>", "<|im_start|>", "<|im_sep|>", "<", "|", "\\", "<\\|", "<\\\\|", "\n", "a", "é😀", "%0A", "+", "$1"]


def conversations(seed, n=40):
    rnd = random.Random(seed)
    for c in range(n):
        for t in range(rnd.randint(1, 9)):
            yield (c, t, rnd.choice(["user", "assistant", "system", "od|d<|\n role%"]),
                   "".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 12))))


def made(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = cf.format_conversations(df.withColumn("end", F.lit(1)).withColumn("turns", F.lit("clash")).repartition(3))
    return {r.conv_id: r for r in out.select("*", cf.parse(F.col("formatted")).alias("back"), cf.loss_text(
        F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}


@pytest.mark.parametrize("seed", range(4))
def test_round_trip(spark, seed):
    rows = list(conversations(seed))
    got = made(spark, rows)
    for c, r in got.items():
        turns = sorted((t, role, text) for x, t, role, text in rows if x == c)
        assert [(b.role, b.text) for b in r.back] == [(role, text) for _, role, text in turns]
        assert r.n_turns == len(turns)
        assert r.n_merged == sum(i == 0 or turns[i - 1][1] != t[1] for i, t in enumerate(turns))
        assert r.loss == "".join(text for _, role, text in turns if role == "assistant")
        assert r.formatted.count("<|im_start|>") == r.n_merged == r.formatted.count("<|im_end|>")
        assert r.formatted.count("<|im_sep|>") == r.n_turns - r.n_merged


def test_odd_rows(spark):
    rows = [(None, 0, "user", "x"), (1, None, None, None), (1, 0, "assistant", ""), (2, 0, "assistant", "tie b"),
            (2, 0, "assistant", "tie a"), (2, 0, "assistant", "tie a"), (3, 5, "assistant", "long " * 100_000)]
    got = made(spark, rows)
    assert set(got) == {None, 1, 2, 3}
    assert [(b.role, b.text) for b in got[1].back] == [("", ""), ("assistant", "")]
    assert got[2].loss == "tie atie atie b" and got[2].n_merged == 1
    assert got[3].loss == "long " * 100_000
    assert made(spark, rows[:0]) == {}


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = cf.format_conversations(df)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
