"""Registered window queries; the oracle uses plain SQL window functions."""

from ledgerloom.operators import windows as op
from ledgerloom.plans.oracle import M

RUN = """SELECT p.id, p.order_id, p.payment_date, p.amount, o.agreed_price, o.status,
 SUM(p.amount) OVER (PARTITION BY p.order_id ORDER BY p.payment_date, p.id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
 FROM order_payment p JOIN sales_order o ON o.id = p.order_id"""

ENTRIES = {
    "order_payment_running_total": (
        lambda c: op.order_payment_running_total(c),
        f"SELECT id AS payment_id, order_id, payment_date, {M('amount')} AS amount, {M('run')} AS running_paid, "
        f"{M('agreed_price - run')} AS remaining, CASE WHEN run >= agreed_price AND run - amount < agreed_price "
        f"THEN 1 ELSE 0 END AS completes FROM ({RUN}) r"),
    "order_fulfilment_date": (
        lambda c: op.order_fulfilment_date(c),
        f"SELECT order_id, id AS payment_id, payment_date AS fulfilled_on, {M('run')} AS paid_at_fulfilment FROM ("
        f"SELECT *, ROW_NUMBER() OVER (PARTITION BY order_id ORDER BY payment_date, id) AS rn FROM ({RUN}) r "
        f"WHERE status = 'active' AND run >= agreed_price) x WHERE rn = 1"),
    "payroll_outstanding_after": (
        lambda c: op.payroll_outstanding_after(c),
        f"""SELECT id AS payment_id, person_id, d AS payment_date, {M('-delta')} AS amount, {M('bal')} AS outstanding_after
FROM (SELECT *, SUM(delta) OVER (PARTITION BY person_id ORDER BY d, kind, id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bal
      FROM (SELECT person_id, log_date AS d, 0 AS kind, id, amount_earned AS delta FROM work_log
            UNION ALL SELECT person_id, payment_date, 1, id, -amount FROM person_payment) e) x WHERE kind = 1"""),
    "current_item_location": (
        lambda c: op.current_item_location(c),
        """SELECT i.id AS item_id, COALESCE(t.to_location_id, i.location_id) AS location_id, t.id AS last_transfer_id
FROM item i LEFT JOIN (SELECT item_id, to_location_id, id, ROW_NUMBER() OVER (PARTITION BY item_id
  ORDER BY transfer_date DESC, id DESC) AS rn FROM item_transfer) t ON t.item_id = i.id AND t.rn = 1"""),
}
