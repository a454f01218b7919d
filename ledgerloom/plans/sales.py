"""Registered sales-side queries."""

from ledgerloom.operators import sales as op
from ledgerloom.plans.oracle import M, Z
from ledgerloom.plans.params import ORDER_SEARCH

PAID = "(SELECT order_id, SUM(amount) AS total_paid FROM order_payment GROUP BY order_id)"

ORDER_COLS = (f"o.id, o.customer_id, o.item_id, o.location_id, {M('o.agreed_price')} AS agreed_price, o.status, "
              f"o.is_backorder, o.backorder_description, o.expected_arrival, o.order_date, {M('o.discount')} AS discount, "
              "o.delivery_status")


def enriched(phone: bool = False, balance: bool = True) -> str:
    """Orders with what belongs to them looked up row by row; an order whose
    customer or location is unknown is left out."""
    found = ("SELECT *, (SELECT any_value(name) FROM erp_customer k WHERE k.id = q.customer_id) AS customer_name, "
             "(SELECT any_value(phone) FROM erp_customer k WHERE k.id = q.customer_id) AS customer_phone, "
             "(SELECT any_value(name) FROM location k WHERE k.id = q.location_id) AS location_name, "
             f"{Z('(SELECT SUM(amount) FROM order_payment k WHERE k.order_id = q.id)')} AS had FROM sales_order q "
             "WHERE q.customer_id IN (SELECT id FROM erp_customer) AND q.location_id IN (SELECT id FROM location)")
    cols = ORDER_COLS + ", customer_name" + (", customer_phone" if phone else "") + ", location_name"
    if balance:
        cols += f", {M('had')} AS total_paid, {M('o.agreed_price - had')} AS remaining_balance"
    return f"SELECT {cols} FROM ({found}) o"


LIST_QUERY = "  Customer#00000012 "

ENTRIES = {
    "order_search": (
        lambda c: op.order_search(c, ORDER_SEARCH),
        enriched(phone=True) + f" WHERE customer_name ILIKE '%{ORDER_SEARCH}%' OR customer_phone ILIKE '%{ORDER_SEARCH}%'"),
    "order_search_all": (lambda c: op.order_search(c), enriched(phone=True)),
    "order_detail": (lambda c: op.order_detail(c), enriched()),
    "customer_orders": (lambda c: op.customer_orders(c), enriched()),
    "sales_list_filter": (
        lambda c: op.sales_list_filter(c, "active", LIST_QUERY),
        enriched(phone=True) + f" WHERE o.status = 'active' AND (coalesce(contains(lower(customer_name), "
        f"'{LIST_QUERY.lower().strip()}'), false) OR coalesce(contains(customer_phone, '{LIST_QUERY.lower().strip()}'), false))"),
    "backorders": (
        lambda c: op.backorders(c),
        enriched(balance=False) + " WHERE o.is_backorder = 1 AND o.status = 'backorder'"),
    "order_payments": (
        lambda c: op.order_payments(c),
        f"SELECT id, order_id, {M('amount')} AS amount, payment_date, method FROM order_payment"),
    "customer_payments": (
        lambda c: op.customer_payments(c),
        f"SELECT o.customer_id, p.id, p.order_id, {M('p.amount')} AS amount, p.payment_date, p.method, o.order_date "
        "FROM order_payment p JOIN sales_order o ON o.id = p.order_id"),
    "customer_list": (lambda c: op.customer_list(c), "SELECT id, name, phone, notes FROM erp_customer"),
    "customer_remaining_total": (
        lambda c: op.customer_remaining_total(c),
        f"SELECT o.customer_id, COUNT(*) AS order_count, {M('SUM(o.agreed_price - ' + Z('p.total_paid') + ')')} "
        f"AS remaining_total FROM sales_order o JOIN erp_customer c ON c.id = o.customer_id "
        f"JOIN location l ON l.id = o.location_id LEFT JOIN {PAID} p ON p.order_id = o.id GROUP BY o.customer_id"),
    "order_net_due": (
        lambda c: op.order_net_due(c),
        f"SELECT o.id, {M('o.agreed_price')} AS agreed_price, {M(Z('p.total_paid'))} AS total_paid, "
        f"{M('o.discount')} AS discount, {M('o.agreed_price - ' + Z('p.total_paid') + ' - o.discount')} AS net_due "
        f"FROM sales_order o LEFT JOIN {PAID} p ON p.order_id = o.id"),
    "obligations_customers": (
        lambda c: op.obligations_customers(c),
        # what an order owes is the sum of its price and of its payments, taken negative
        f"""SELECT * FROM (WITH moves AS (
  SELECT id AS ref, agreed_price AS due FROM sales_order UNION ALL SELECT order_id, -amount FROM order_payment),
 owing AS (SELECT ref, SUM(due) AS rest FROM moves GROUP BY ref HAVING SUM(due) > 0),
 live AS (SELECT id AS ref, customer_id AS buyer FROM sales_order EXCEPT
  SELECT id, customer_id FROM sales_order WHERE status = 'cancelled')
 SELECT ref AS order_id, (SELECT k.name FROM erp_customer k WHERE k.id = live.buyer) AS customer, {M('rest')} AS outstanding,
  0 AS overdue FROM owing JOIN live USING (ref)) x"""),
    "deletable_customers": (
        lambda c: op.deletable_customers(c),
        "SELECT c.id, c.name FROM erp_customer c WHERE NOT EXISTS "
        "(SELECT 1 FROM sales_order o WHERE o.customer_id = c.id)"),
}
