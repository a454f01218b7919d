"""``installment_expand`` runs over a whole table of nested payloads."""

from pyspark.sql import functions as F

from ledgerloom.plans.registry import entries


def test_the_registered_query_expands_nested_payloads(small_catalog):
    plan = entries()["installment_expand"][0](small_catalog)._jdf.queryExecution().optimizedPlan().toString()
    assert "inline(" in plan and "collect_list(" not in plan
    payloads = small_catalog.installment_payloads
    assert payloads.filter(F.size("installments") > 1).count() > 0
    held, rows = payloads.agg(F.sum(F.size("installments"))).first()[0], small_catalog.installment_batch.count()
    assert held == rows and payloads.count() == small_catalog.shipment.count()
