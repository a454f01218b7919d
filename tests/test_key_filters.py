"""Runtime key filters, and the reports that use them."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerloom.functions.keyfilter import key_filter, may_match, split_by_keys
from ledgerloom.operators import finance, ledger


def test_no_key_is_lost_and_few_others_pass(spark):
    keys = spark.range(0, 1000).select((F.col("id") * 7).alias("k"), F.lit("a").alias("t"))
    table = spark.range(0, 100_000).select(F.col("id").alias("key"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("tag"))
    kf = key_filter(keys, ["t", "k"])
    passed = may_match(table, ["tag", "key"], kf)
    assert passed.columns == table.columns
    wanted = table.join(keys, (table.tag == keys.t) & (table.key == keys.k), "left_semi")
    assert wanted.exceptAll(passed).count() == 0
    assert passed.count() < wanted.count() + 5000
    yes, no = split_by_keys(table, ["tag", "key"], kf)
    assert yes.count() + no.count() == 100_000
    tiny = key_filter(keys, ["t", "k"], bits=64)  # full: lets all pass, loses none
    assert may_match(table, ["tag", "key"], tiny).count() == 100_000
    assert may_match(table, ["tag", "key"], key_filter(keys.limit(0), ["t", "k"])).count() == 0


def test_a_days_report_moves_only_its_rows(spark, small_catalog, monkeypatch):
    day = dt.date(1998, 3, 2)
    led = finance.ledger_range(small_catalog.transaction_log, day, day)
    looked_up = []
    hop = finance._hop
    monkeypatch.setattr(finance, "_hop", lambda rows, table: looked_up.append((rows.count(), table.count())) or hop(rows, table))
    few = finance.ledger_party(small_catalog, led).select("id", "party")
    got = {r.id: r.party for r in few.collect()}
    monkeypatch.undo()
    want = {r.id: r.party for r in finance.ledger_party(small_catalog).join(led.select(F.col("id").alias("i")), F.col("id") == F.col("i"))
            .select("id", "party").collect()}
    assert got == want and got
    for rows, table in looked_up:
        assert table <= 2 * rows + 200  # of tables with thousands of rows


def test_empty_range(spark, small_catalog):
    day = dt.date(2150, 1, 1)
    assert finance.finance_daily_entries(small_catalog, day, day).collect() == []


def test_reconcile_months_and_one_shuffle(spark, small_catalog):
    expected, dirty = ledger.post_ledger(small_catalog), small_catalog.ledger_dirty
    whole = ledger.ledger_reconcile(expected, dirty)
    one = ledger.ledger_reconcile(expected, dirty, months=[f"1996-{m:02d}" for m in range(1, 13)])
    assert 0 < one.count() < whole.count()
    plan = ledger.ledger_reconcile(small_catalog.transaction_log, small_catalog.transaction_log)
    assert plan.count() == 0
    a = spark.createDataFrame([("X", 1, dt.date(2024, 1, 1), 1)], "source_table string, source_id bigint, transaction_date date, amount int")
    text = ledger.ledger_reconcile(a, a)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text
