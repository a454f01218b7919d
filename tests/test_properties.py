"""Property tests (hypothesis) for the two numeric helpers every report
relies on: money rounding and the skew-tolerant running sum."""

import datetime as dt
import math
from decimal import Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.functions import money
from ledgerloom.functions.running import running_sum

CENTS3 = st.integers(min_value=-10**9, max_value=10**9).map(lambda n: Decimal(n).scaleb(-3))


@settings(max_examples=20, deadline=None)
@given(st.lists(CENTS3, min_size=1, max_size=40))
def test_money_rounds_half_toward_plus_infinity(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x decimal(18,3)")
    got = [r[0] for r in df.select(money("x")).collect()]
    want = [math.floor(v * 100 + Decimal("0.5")) / 100 for v in values]
    assert got == want


ROWS = st.lists(st.tuples(st.integers(0, 3), st.integers(0, 6), st.integers(-500, 500)), min_size=1, max_size=80)


@settings(max_examples=15, deadline=None)
@given(ROWS)
def test_running_sum_equals_plain_window(spark, rows):
    data = [(k, dt.date(2024, 1, 1) + dt.timedelta(days=d), i, Decimal(v).scaleb(-2))
            for i, (k, d, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "k int, d date, id bigint, v decimal(18,2)")
    w = Window.partitionBy("k").orderBy("d", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = {r.id: r.run for r in df.withColumn("run", F.sum("v").over(w)).collect()}
    for per_bucket in (None, 1 << 20, 3, 1):  # sqrt rule, one bucket per day, small buckets, one row each
        got = {r.id: r.run for r in running_sum(df, "k", "d", ["id"], "v", "run", per_bucket).collect()}
        assert got == want
