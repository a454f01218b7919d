"""Backorder claims one after the other, by components of the claim graph."""

import random

import pytest

from ledgerloom.functions.graph import components
from ledgerloom.operators.rules import standing_claims


def brute(claims):
    orders, items, won = set(), set(), set()
    for o, i in sorted(set(claims)):
        if o not in orders and i not in items:
            orders.add(o)
            items.add(i)
            won.add((o, i))
    return won


def run(spark, claims, **kw):
    df = spark.createDataFrame(claims, "order_id bigint, item_id bigint").repartition(3)
    return {(r.order_id, r.item_id) for r in standing_claims(df, **kw).collect()}


def chain(n, base=0):
    """Every claim but the first hangs on the one before it."""
    return [c for k in range(base, base + n // 2) for c in ((k, k), (k, k + 1))]


def jobs(spark, work):
    """Number of jobs that ``work`` starts."""
    sc = spark.sparkContext
    sc.setJobGroup("counted", "counted")
    try:
        result = work()
        return result, len(sc.statusTracker().getJobIdsForGroup("counted"))
    finally:
        sc._jsc.clearJobGroup()


def test_a_long_chain_takes_few_jobs(spark):
    claims = chain(10_000)
    got, few = jobs(spark, lambda: run(spark, claims))
    assert got == brute(claims)
    _, fewer = jobs(spark, lambda: run(spark, chain(100)))
    assert few <= fewer + 2 < 20


def test_components_of_bounded_size_go_to_tasks(spark):
    claims = [c for b in range(0, 4000, 100) for c in chain(60, b)]
    got, n = jobs(spark, lambda: run(spark, claims, in_task=100))
    assert got == brute(claims)
    assert n < 120  # one labelling, not a round for each claim of a chain


def test_a_component_larger_than_a_task(spark):
    claims = chain(60)
    assert run(spark, claims, in_task=25) == brute(claims)


def test_a_hot_item_and_a_hot_order(spark):
    rnd = random.Random(5)
    claims = [(k, 1) for k in range(100)] + [(7, k) for k in range(100)] + [
        (rnd.randint(0, 100), rnd.randint(0, 100)) for _ in range(100)]
    assert run(spark, claims + claims[:50], in_task=40) == brute(claims)


@pytest.mark.parametrize("in_task", [3, 1000])
def test_random_claims(spark, in_task):
    rnd = random.Random(in_task)
    claims = [(rnd.randint(0, 25), rnd.randint(0, 30)) for _ in range(40)]
    assert run(spark, claims, in_task=in_task) == brute(claims)


def test_no_claims(spark):
    assert run(spark, []) == set()


def test_components(spark):
    rnd = random.Random(1)
    links = [(k, k + 1) for k in range(0, 90)] + [(rnd.randint(200, 260), rnd.randint(200, 260)) for _ in range(30)] + [(500, 500)]
    root = {n: n for pair in links for n in pair}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {n: find(n) for n in root}
