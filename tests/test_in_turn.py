"""Transfers one after the other, and the prefix scan below them."""

import datetime as dt
import random
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.running import last_before, running_sum
from ledgerloom.operators import rules, validation
from ledgerloom.sources.catalog import Catalog

A, B, C = 1, 2, 3
BATCH = "id bigint, item_id bigint, to_location_id bigint, transfer_date date"


@pytest.fixture
def places(spark, frames):
    def make(*items):
        """(id, location, status) of items over the places 1, 2 and 3."""
        return Catalog.from_frames(spark, {
            "location": frames("location", [(i, f"L{i}", "gallery") for i in (A, B, C)]),
            "item": frames("item", [(i, None, at, "x", "c", "d", D(1), D(2), status) for i, at, status in items])})
    return make


def day(n):
    return None if n is None else dt.date(2024, 1, 1) + dt.timedelta(days=n)


def run(spark, c, moves):
    batch = spark.createDataFrame([(i, item, to, day(d)) for i, item, to, d in moves], BATCH)
    return ({r.id: (r.location_id, r.status, r.last_transfer_id) for r in rules.transfer_apply(c, batch).collect()},
            {r.id: r.reason for r in validation.transfers_in_turn(c, batch).collect()})


def brute(items, moves):
    place, state = {i: (at, status, None) for i, at, status in items}, {}
    for i, item, to, d in sorted(moves, key=lambda m: (m[3] is not None, m[3] or 0, m[0])):
        at = place.get(item)
        reason = ("item_not_found" if at is None else "item_sold" if at[1] == "sold" else
                  "to_location_id_required" if not to else "transfer_date_required" if d is None else
                  "same_location" if to == at[0] else "location_not_found" if to not in (A, B, C) else None)
        state[i] = reason
        if reason is None:
            place[item] = (to, "in_storage", i)
    return place, state


def test_there_and_back(spark, places):
    c = places((1, A, "on_display"), (2, A, "on_display"), (3, B, "sold"))
    got, why = run(spark, c, [(10, 1, B, 1), (11, 1, A, 2), (20, 2, B, 1), (21, 2, B, 2), (30, 3, A, 1), (40, 9, A, 1)])
    assert got == {1: (A, "in_storage", 11), 2: (B, "in_storage", 20), 3: (B, "sold", None)}
    assert why == {10: None, 11: None, 20: None, 21: "same_location", 30: "item_sold", 40: "item_not_found"}


def test_refused_transfers_change_nothing(spark, places):
    c = places((1, A, "on_display"))
    got, why = run(spark, c, [(1, 1, A, 1), (2, 1, 99, 2), (3, 1, None, 3), (4, 1, B, None), (5, 1, A, 4)])
    assert got == {1: (A, "on_display", None)}
    assert why == {1: "same_location", 2: "location_not_found", 3: "to_location_id_required", 4: "transfer_date_required",
                   5: "same_location"}


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_order(spark, places, seed):
    rnd = random.Random(seed)
    items = [(i, rnd.choice([A, B, C, 77]), rnd.choice(["in_storage", "on_display", "sold"])) for i in range(1, 8)]
    moves = [(i, rnd.choice([1, 1, 1, *range(1, 9), None]), rnd.choice([A, B, C, 77, 0, None, A, B]),
              rnd.choice([*range(6), None])) for i in range(120)]
    got, why = run(spark, places(*items), moves)
    place, state = brute(items, moves)
    assert got == place and why == state


def test_an_item_with_a_third_of_all_transfers(spark, places):
    rnd = random.Random(3)
    items = [(i, A, "in_storage") for i in range(1, 41)]
    moves = [(i, 1 if i % 3 == 0 else rnd.randint(2, 40), rnd.choice([A, B, C]), i // 50) for i in range(3000)]
    got, why = run(spark, places(*items), moves)
    place, state = brute(items, moves)
    assert got == place and why == state


def test_empty_batch(spark, places):
    got, why = run(spark, places((1, A, "sold")), [])
    assert got == {1: (A, "sold", None)} and why == {}


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_scan_carries_over_many_parts(spark, parts):
    """A key that spans several parts, null keys, null values, null days."""
    rnd = random.Random(parts)
    rows = [(i, rnd.choice([None, "a", "a", "a", "b"]), rnd.choice([None, 1, 2, 3]), D(rnd.randint(-9, 9)) if i % 4 else None)
            for i in range(200)]
    df = spark.createDataFrame(rows, "id long, k string, d int, v decimal(18,2)").repartition(5)
    order = sorted(rows, key=lambda r: (r[1] or "", r[2] or 0, r[0]))
    sums, lasts, run_, last = {}, {}, {}, {}
    for i, k, _, v in order:
        lasts[i] = last.get(k)
        run_[k] = run_.get(k, D(0)) + (v or D(0))
        sums[i] = run_[k]
        if v is not None:
            last[k] = v
    got = {r.id: r.run for r in running_sum(df, "k", "d", ["id"], "v", "run", parts).collect()}
    assert got == sums
    got = {r.id: r.before for r in last_before(df, "k", ["d", "id"], "v", "before", parts).collect()}
    assert got == lasts


def test_scan_reads_the_rows_once_and_shuffles_them_twice(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("k"), F.col("id").alias("d"), F.lit(1).alias("v"))
    done = running_sum(df, "k", "d", ["id"], "v", "run", 4)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
    assert running_sum(df.limit(0), "k", "d", ["id"], "v", "run").collect() == []
