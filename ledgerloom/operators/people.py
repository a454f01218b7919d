"""People, work log and payroll."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import money, zero_if_null
from ledgerloom.sources.catalog import Catalog


def people_locations(c: Catalog, as_csv: bool = False) -> DataFrame:
    """People with the sorted list of their location ids ([] if none), one
    entry for each bridge row, as the reference lists them. A location comes
    with its count from the partial aggregate, so what is collected for a
    person is bounded by the location dimension."""
    each = c.person_location.groupBy("person_id", "location_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    pl = each.groupBy("person_id").agg(F.array_sort(F.flatten(F.collect_list(
        F.array_repeat("location_id", F.col("n"))))).alias("ids"))
    p = c.person
    ids = F.coalesce("ids", F.array().cast("array<bigint>"))
    out = p.join(pl, p.id == pl.person_id, "left")
    loc = F.array_join(ids, ",") if as_csv else ids
    return (out.select("id", "name", "role", money("rate").alias("rate"),
                       loc.alias("location_ids_csv" if as_csv else "location_ids"))
            .orderBy("id"))


def person_work_log(c: Catalog, person_id: int | None = None) -> DataFrame:
    """Work log rows of a person (or everyone), newest first."""
    w = c.work_log if person_id is None else c.work_log.filter(F.col("person_id") == person_id)
    return (w.select("id", "person_id", "location_id", "log_date", "log_type", "quantity",
                     money("amount_earned").alias("amount_earned"))
            .orderBy("person_id", F.col("log_date").desc(), "id"))


def person_payments(c: Catalog, person_id: int | None = None) -> DataFrame:
    """Staff payments of a person (or everyone), newest first."""
    p = c.person_payment if person_id is None else c.person_payment.filter(F.col("person_id") == person_id)
    return (p.select("id", "person_id", money("amount").alias("amount"), "payment_date", "method")
            .orderBy("person_id", F.col("payment_date").desc(), "id"))


def _period_sums(c: Catalog, date_from, date_to, location_id=None, role=None):
    """(earned per person in period [location, role]), (paid per person in
    period [role]): the location filter applies to earnings only (Q15)."""
    p = c.person.select(F.col("id").alias("pid"), "name", "role")
    if role:
        p = p.filter(F.col("role") == role)
    w = c.work_log.filter(F.col("log_date").between(F.lit(date_from), F.lit(date_to)))
    if location_id is not None:
        w = w.filter(F.col("location_id") == location_id)
    earned = (w.groupBy("person_id").agg(F.sum("amount_earned").alias("earned"))
              .join(p, F.col("person_id") == F.col("pid")).drop("pid"))
    pp = c.person_payment.filter(F.col("payment_date").between(F.lit(date_from), F.lit(date_to)))
    paid = (pp.groupBy(F.col("person_id").alias("paid_person_id")).agg(F.sum("amount").alias("paid"))
            .join(p.select("pid"), F.col("paid_person_id") == F.col("pid")).drop("pid"))
    return earned, paid


def payroll_summary(c: Catalog, date_from, date_to, location_id=None, role=None) -> DataFrame:
    """Per person with earnings in the period: earned, paid, outstanding."""
    earned, paid = _period_sums(c, date_from, date_to, location_id, role)
    df = earned.join(paid, earned.person_id == paid.paid_person_id, "left")
    pd_ = zero_if_null("paid")
    return (df.select("person_id", "name", "role", money("earned").alias("earned"), money(pd_).alias("paid"),
                      money(F.col("earned") - pd_).alias("outstanding"))
            .orderBy("person_id"))


def payroll_totals(c: Catalog, date_from, date_to, location_id=None, role=None) -> DataFrame:
    """Totals and headcount, counting people paid without work (full join)."""
    earned, paid = _period_sums(c, date_from, date_to, location_id, role)
    df = earned.join(paid, earned.person_id == paid.paid_person_id, "full")
    e, p = zero_if_null(F.sum("earned")), zero_if_null(F.sum("paid"))
    return df.agg(money(e).alias("total_earned"), money(p).alias("total_paid"),
                  money(e - p).alias("total_outstanding"), F.count(F.lit(1)).alias("headcount"))


def staff_balances(c: Catalog) -> DataFrame:
    """person id, name, exact all-time earned - paid."""
    w = c.work_log.groupBy("person_id").agg(F.sum("amount_earned").alias("earned"))
    pp = c.person_payment.groupBy(F.col("person_id").alias("pp_person")).agg(F.sum("amount").alias("paid"))
    p = c.person
    df = p.join(w, p.id == w.person_id, "left").join(pp, p.id == pp.pp_person, "left")
    return df.select(F.col("id").alias("person_id"), "name",
                     (zero_if_null("earned") - zero_if_null("paid")).alias("outstanding"))


def obligations_staff(c: Catalog) -> DataFrame:
    """Staff owed money (earned minus paid > 0), largest first."""
    b = staff_balances(c).filter(F.col("outstanding") > 0)
    return (b.select("person_id", "name", money("outstanding").alias("outstanding"))
            .orderBy(F.col("outstanding").desc(), "person_id"))
