"""Registered supply-side queries: Spark builder + DuckDB oracle text."""

from ledgerloom.operators import supply as op
from ledgerloom.plans.oracle import M, Z
from ledgerloom.plans.params import AS_OF, TRADE_FROM, TRADE_TO

PAID_BY_SHIPMENT = ("(SELECT shipment_id, SUM(amount) FILTER (WHERE is_paid = 1) AS total_paid "
                    "FROM shipment_installment GROUP BY shipment_id)")

SHIPMENT_BALANCES = f"""SELECT sh.id, sh.supplier_id, s.name AS supplier_name, sh.date_received,
 {M('sh.declared_value')} AS declared_value, sh.payment_status,
 {M(Z('p.total_paid'))} AS amount_paid, {M('sh.declared_value - ' + Z('p.total_paid'))} AS remaining_balance
FROM shipment sh JOIN erp_supplier s ON s.id = sh.supplier_id
LEFT JOIN {PAID_BY_SHIPMENT} p ON p.shipment_id = sh.id"""

# per supplier, as correlated scalar subqueries (DuckDB decorrelates them)
SUPPLIER_TOTALS = f"""SELECT s.id, s.name, s.phone, s.status,
 {Z('(SELECT SUM(x.declared_value) FROM shipment x WHERE x.supplier_id = s.id)')} AS declared,
 {Z('(SELECT SUM(i.amount) FROM shipment_installment i, shipment y WHERE y.id = i.shipment_id AND y.supplier_id = s.id AND i.is_paid = 1)')} AS paid
FROM erp_supplier s"""

SUPPLIER_SUMMARY = f"""SELECT s.id AS supplier_id, s.name,
 (SELECT COUNT(*) FROM shipment x WHERE x.supplier_id = s.id) AS total_shipments,
 {M('declared')} AS total_value, {M('paid')} AS amount_paid, {M('declared - paid')} AS outstanding_balance,
 (SELECT MAX(x.date_received) FROM shipment x WHERE x.supplier_id = s.id) AS last_shipment_date
FROM ({SUPPLIER_TOTALS}) s"""

ENTRIES = {
    "supplier_balances": (
        lambda c: op.supplier_balances(c),
        f"SELECT id, name, phone, status, {M('declared - paid')} AS outstanding_balance, "
        f"{M('paid')} AS total_paid_lifetime FROM ({SUPPLIER_TOTALS}) t"),
    "supplier_balances_owing": (
        lambda c: op.supplier_balances(c, status="active", has_balance=True),
        f"SELECT id, name, phone, status, {M('declared - paid')} AS outstanding_balance, "
        f"{M('paid')} AS total_paid_lifetime FROM ({SUPPLIER_TOTALS}) t "
        f"WHERE status = 'active' AND declared - paid > 0"),
    "supplier_summary": (lambda c: op.supplier_summary(c), SUPPLIER_SUMMARY),
    "supplier_kpis": (
        lambda c: op.supplier_kpis(c, AS_OF),
        f"""SELECT supplier_id,
 CAST(CASE WHEN total_value = 0 THEN 0 ELSE floor(amount_paid / total_value * 100 + 0.5) END AS BIGINT) AS paid_pct,
 CAST(CASE WHEN last_shipment_date IS NULL THEN 0
      ELSE date_diff('day', last_shipment_date, DATE '{AS_OF}') END AS INTEGER) AS days_since_last_shipment
FROM ({SUPPLIER_SUMMARY}) x"""),
    "shipment_balances": (
        lambda c: op.shipment_balances(c, date_from=TRADE_FROM, date_to=TRADE_TO),
        f"SELECT * FROM ({SHIPMENT_BALANCES}) b WHERE date_received >= DATE '{TRADE_FROM}' "
        f"AND date_received <= DATE '{TRADE_TO}'"),
    "supplier_shipments": (lambda c: op.supplier_shipments(c), SHIPMENT_BALANCES),
    "shipment_balances_supplier": (
        lambda c: op.shipment_balances(c, supplier_id=1, payment_status="unpaid"),
        f"SELECT * FROM ({SHIPMENT_BALANCES}) b WHERE supplier_id = 1 AND payment_status = 'unpaid'"),
    "shipment_detail": (
        lambda c: op.shipment_detail(c),
        f"""SELECT b.*, si.id AS installment_id, {M('si.amount')} AS installment_amount, si.due_date, si.is_paid, si.paid_date
FROM ({SHIPMENT_BALANCES}) b LEFT JOIN shipment_installment si ON si.shipment_id = b.id"""),
    "shipment_payment_status": (
        lambda c: op.shipment_payment_status(c),
        f"""SELECT sh.id, sh.supplier_id, sh.payment_status AS stored_status,
 CASE WHEN {Z('p.total_paid')} >= sh.declared_value THEN 'settled' WHEN {Z('p.total_paid')} > 0 THEN 'partial'
      ELSE 'unpaid' END AS payment_status, {M(Z('p.total_paid'))} AS amount_paid
FROM shipment sh LEFT JOIN {PAID_BY_SHIPMENT} p ON p.shipment_id = sh.id"""),
    "shipment_paid_pct": (
        lambda c: op.shipment_paid_pct(c),
        f"""SELECT sh.id, CAST(CASE WHEN sh.declared_value = 0 THEN 0
 ELSE floor({M(Z('p.total_paid'))} / {M('sh.declared_value')} * 100 + 0.5) END AS BIGINT) AS paid_pct
FROM shipment sh LEFT JOIN {PAID_BY_SHIPMENT} p ON p.shipment_id = sh.id"""),
    "shipments_total_debt": (
        lambda c: op.shipments_total_debt(c),
        f"SELECT {M(Z('SUM(sh.declared_value - ' + Z('p.total_paid') + ')'))} AS total_debt "
        f"FROM shipment sh LEFT JOIN {PAID_BY_SHIPMENT} p ON p.shipment_id = sh.id "
        "WHERE sh.supplier_id IN (SELECT id FROM erp_supplier)"),
    "suppliers_total_debt": (
        lambda c: op.suppliers_total_debt(c),
        f"SELECT {M(Z('SUM(declared - paid)'))} AS total_debt FROM ({SUPPLIER_TOTALS}) t"),
    "top_supplier_by_paid": (
        lambda c: op.top_supplier_by_paid(c),
        f"SELECT id, name, {M('paid')} AS total_paid_lifetime FROM ({SUPPLIER_TOTALS}) t WHERE paid > 0 "
        f"ORDER BY paid DESC, id LIMIT 1"),
    "supplier_codes": (
        lambda c: op.supplier_codes(c),
        "SELECT id, '#SPL-' || CASE WHEN length(CAST(id AS VARCHAR)) < 4 THEN lpad(CAST(id AS VARCHAR), 4, '0') "
        "ELSE CAST(id AS VARCHAR) END AS code FROM erp_supplier"),
    "shipment_item_status": (
        lambda c: op.shipment_item_status(c),
        "SELECT shipment_id, status, COUNT(*) AS count FROM item WHERE shipment_id IS NOT NULL GROUP BY shipment_id, status"),
    "shipment_item_value": (
        lambda c: op.shipment_item_value(c),
        f"SELECT shipment_id, {M(Z('SUM(purchase_value)'))} AS total_purchase, {M(Z('SUM(sale_price)'))} AS total_sale "
        "FROM item WHERE shipment_id IS NOT NULL GROUP BY shipment_id"),
    "supplier_history": (
        lambda c: op.supplier_history(c),
        # the timeline of each supplier, its payments found through the shipments it owns
        f"""SELECT supplier_id, entry.id AS id, entry.date AS date, entry.type AS type, entry.amount AS amount,
 entry.notes AS notes FROM (
 SELECT supplier_id, unnest(list_prepend(
   {{'id': id, 'date': date_received, 'type': 'shipment', 'amount': {M('declared_value')}, 'notes': notes}},
   COALESCE((SELECT list({{'id': k.id, 'date': k.paid_date, 'type': 'payment', 'amount': {M('k.amount')},
                          'notes': 'For shipment #' || CAST(k.shipment_id AS VARCHAR)}})
             FROM shipment_installment k WHERE k.is_paid = 1 AND k.shipment_id = q.id), []))) AS entry
 FROM shipment q) t"""),
    "obligations_suppliers": (
        lambda c: op.obligations_suppliers(c, AS_OF),
        # the supplier's name looked up for every unpaid instalment
        f"""SELECT installment_id, shipment_id, supplier, amount, due_date, overdue FROM (
 SELECT id AS installment_id, shipment_id, (SELECT any_value(name) FROM erp_supplier WHERE id =
   (SELECT any_value(supplier_id) FROM shipment WHERE shipment.id = q.shipment_id)) AS supplier,
 {M('amount')} AS amount, due_date, CAST(due_date < DATE '{AS_OF}' AS INTEGER) AS overdue
 FROM shipment_installment q WHERE NOT is_paid = 1) x WHERE supplier IS NOT NULL"""),
    "shipment_remainders": (
        lambda c: op.shipment_remainders(c),
        f"""SELECT id, CAST(strftime(date_received, '%Y%m%d') AS BIGINT) AS date_key,
 {M('CASE WHEN left_over < 0 THEN 0 ELSE left_over END')} AS remainder FROM (SELECT id, date_received,
 declared_value - COALESCE((SELECT SUM(amount) FROM shipment_installment k WHERE k.is_paid = 1 AND k.shipment_id = q.id),
                           CAST(0 AS DECIMAL(18,2))) AS left_over FROM shipment q) x"""),
    "deletable_suppliers": (
        lambda c: op.deletable_suppliers(c),
        "SELECT s.id, s.name FROM erp_supplier s WHERE NOT EXISTS (SELECT 1 FROM shipment sh WHERE sh.supplier_id = s.id)"),
}
