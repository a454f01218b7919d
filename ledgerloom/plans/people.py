"""Registered people and payroll queries."""

from ledgerloom.operators import people as op
from ledgerloom.plans.oracle import M, Z
from ledgerloom.plans.params import GALLERY_ID, STAFF_FROM, STAFF_TO


def _per_person(loc=None, role=None):
    """Every person with what they earned (NULL without a log) and were paid
    in the period, each looked up by itself; the payment side ignores the
    location, the role holds for both."""
    at = f" AND location_id = {loc}" if loc is not None else ""
    return (f"SELECT id, name, role, (SELECT SUM(amount_earned) FROM work_log l WHERE l.person_id = q.id AND l.log_date "
            f"BETWEEN DATE '{STAFF_FROM}' AND DATE '{STAFF_TO}'{at}) AS got, (SELECT SUM(amount) FROM person_payment l "
            f"WHERE l.person_id = q.id AND l.payment_date BETWEEN DATE '{STAFF_FROM}' AND DATE '{STAFF_TO}') AS had, "
            f"EXISTS (SELECT 1 FROM work_log l WHERE l.person_id = q.id AND l.log_date BETWEEN DATE '{STAFF_FROM}' "
            f"AND DATE '{STAFF_TO}'{at}) AS worked FROM person q" + (f" WHERE role = '{role}'" if role else ""))


def _summary(loc=None, role=None):
    return (f"SELECT id AS person_id, name, role, {M(Z('got'))} AS earned, {M(Z('had'))} AS paid, "
            f"{M(Z('got') + ' - ' + Z('had'))} AS outstanding FROM ({_per_person(loc, role)}) x WHERE worked")


def _totals(loc=None, role=None):
    se, sp = Z("SUM(got)"), Z("SUM(had)")
    return (f"SELECT {M(se)} AS total_earned, {M(sp)} AS total_paid, {M(se + ' - ' + sp)} AS total_outstanding, "
            f"COUNT(*) FILTER (WHERE worked OR had IS NOT NULL) AS headcount FROM ({_per_person(loc, role)}) x")


STAFF = f"""SELECT p.id AS person_id, p.name,
 {Z('(SELECT SUM(w.amount_earned) FROM work_log w WHERE w.person_id = p.id)')}
 - {Z('(SELECT SUM(q.amount) FROM person_payment q WHERE q.person_id = p.id)')} AS outstanding
FROM person p"""

ENTRIES = {
    "people_locations": (
        lambda c: op.people_locations(c, as_csv=True),
        f"SELECT p.id, p.name, p.role, {M('p.rate')} AS rate, COALESCE(l.ids, '') AS location_ids_csv FROM person p "
        "LEFT JOIN (SELECT person_id, string_agg(CAST(location_id AS VARCHAR), ',' ORDER BY location_id) AS ids "
        "FROM person_location d WHERE location_id IS NOT NULL GROUP BY person_id) l ON l.person_id = p.id"),
    "person_work_log": (
        lambda c: op.person_work_log(c),
        f"SELECT id, person_id, location_id, log_date, log_type, quantity, {M('amount_earned')} AS amount_earned FROM work_log"),
    "person_payments": (
        lambda c: op.person_payments(c),
        f"SELECT id, person_id, {M('amount')} AS amount, payment_date, method FROM person_payment"),
    "payroll_summary": (lambda c: op.payroll_summary(c, STAFF_FROM, STAFF_TO), _summary()),
    "payroll_summary_gallery": (
        lambda c: op.payroll_summary(c, STAFF_FROM, STAFF_TO, location_id=GALLERY_ID, role="worker"),
        _summary(GALLERY_ID, "worker")),
    "payroll_totals": (lambda c: op.payroll_totals(c, STAFF_FROM, STAFF_TO), _totals()),
    "payroll_totals_gallery": (
        lambda c: op.payroll_totals(c, STAFF_FROM, STAFF_TO, location_id=GALLERY_ID), _totals(GALLERY_ID)),
    "obligations_staff": (
        lambda c: op.obligations_staff(c),
        f"SELECT person_id, name, {M('outstanding')} AS outstanding FROM ({STAFF}) s WHERE outstanding > 0"),
}
