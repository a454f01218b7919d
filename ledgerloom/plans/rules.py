"""Registered rule jobs (status transitions, assignments, instalments,
transfers, patches, child replacement, deletes, lookups)."""

from pyspark.sql import functions as F

from ledgerloom.fixed import (
    CUSTOMER_PATCH_ALLOWED,
    EXPENSE_PATCH_ALLOWED,
    INVENTORY_PATCH_ALLOWED,
    ITEM_PATCH_ALLOWED,
    ORDER_PATCH_ALLOWED,
    PERSON_PATCH_ALLOWED,
    SHIPMENT_PATCH_ALLOWED,
    SUPPLIER_PATCH_ALLOWED,
)
from ledgerloom.functions import zero_if_null
from ledgerloom.operators import rules as op
from ledgerloom.operators import validation as val
from ledgerloom.plans.edge import edge
from ledgerloom.plans.oracle import M, Z
from ledgerloom.plans.validation import IN_TURN, ORDERS

PAID = "(SELECT order_id, SUM(amount) AS total_paid FROM order_payment GROUP BY order_id)"
FULLY_PAID = (f"SELECT o.id, o.item_id FROM sales_order o LEFT JOIN {PAID} p ON p.order_id = o.id "
              f"WHERE o.status = 'active' AND {Z('p.total_paid')} >= o.agreed_price")
# a JSON value counts as paid when it is the literal true, the number 1 or the text "true"
PAID_RAW = ("COALESCE(b.is_paid_raw = 'true' OR b.is_paid_raw = '1' OR (length(b.is_paid_raw) = 6 "
            "AND b.is_paid_raw LIKE '\"true\"'), false)")


def _intake(c):
    acc = val.validate_orders(c).filter(F.col("accepted"))
    return op.order_intake(c, c.order_batch, acc)


def _status_expr():
    return "CASE WHEN b.is_backorder = 1 THEN 'backorder' WHEN b.initial_payment >= b.agreed_price THEN 'fulfilled' ELSE 'active' END"


INTAKE = f"""SELECT b.id, {_status_expr()} AS status,
 CASE WHEN COALESCE(b.item_id, 0) = 0 THEN NULL WHEN {_status_expr()} = 'fulfilled' THEN 'sold' ELSE 'reserved' END AS item_status,
 {M('CASE WHEN b.initial_payment > 0 THEN b.initial_payment ELSE 0 END')} AS total_paid,
 {M('b.agreed_price - CASE WHEN b.initial_payment > 0 THEN b.initial_payment ELSE 0 END')} AS remaining_balance,
 CASE WHEN b.initial_payment > 0 THEN 1 ELSE 0 END AS posts_ledger
FROM order_batch b WHERE b.id IN (SELECT id FROM ({ORDERS}) r WHERE reason IS NULL)"""

# one claim after the other: the state of the recursion is what has been served so far
ASSIGN = """SELECT order_id, item_id, outcome, CASE WHEN outcome = 'assigned' THEN 'fulfilled' END AS order_status,
 CASE WHEN outcome = 'assigned' THEN 'reserved' END AS item_status FROM (
 WITH RECURSIVE r AS (
  SELECT a.order_id, a.item_id, CASE WHEN o.id IS NULL THEN 'order_not_found'
   WHEN COALESCE(o.is_backorder, 0) <> 1 THEN 'not_backorder' WHEN o.status = 'fulfilled' THEN 'already_fulfilled'
   WHEN COALESCE(a.item_id, 0) = 0 THEN 'item_required' WHEN i.id IS NULL THEN 'item_not_found'
   WHEN i.status IN ('reserved', 'sold') THEN 'item_unavailable' END AS reason
  FROM assignments a LEFT JOIN sales_order o ON o.id = a.order_id LEFT JOIN item i ON i.id = a.item_id),
 q AS (SELECT order_id, item_id, ROW_NUMBER() OVER (ORDER BY order_id, item_id) AS n
       FROM (SELECT DISTINCT order_id, item_id FROM r WHERE reason IS NULL) u),
 turn AS (
  SELECT CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS orders, CAST([] AS BIGINT[]) AS items, '' AS outcome
  UNION ALL
  SELECT q.n, CASE WHEN list_contains(t.orders, q.order_id) OR list_contains(t.items, q.item_id) THEN t.orders
    ELSE list_append(t.orders, q.order_id) END, CASE WHEN list_contains(t.orders, q.order_id)
    OR list_contains(t.items, q.item_id) THEN t.items ELSE list_append(t.items, q.item_id) END,
   CASE WHEN list_contains(t.orders, q.order_id) THEN 'already_fulfilled'
    WHEN list_contains(t.items, q.item_id) THEN 'item_taken' ELSE 'assigned' END
  FROM turn t JOIN q ON q.n = t.n + 1)
 SELECT order_id, item_id, reason AS outcome FROM r WHERE reason IS NOT NULL
 UNION ALL SELECT q.order_id, q.item_id, t.outcome FROM q JOIN turn t USING (n)) x"""

TRANSFER = f"""SELECT i.id, COALESCE(w.to_location_id, i.location_id) AS location_id,
 CASE WHEN w.item_id IS NOT NULL THEN 'in_storage' ELSE i.status END AS status, w.id AS last_transfer_id
FROM item i LEFT JOIN ({IN_TURN} SELECT item_id, id, to_location_id FROM walk WHERE n > 0 AND reason IS NULL
 QUALIFY ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY n DESC) = 1) w ON w.item_id = i.id"""

DELETES = """SELECT d.id, CASE WHEN COALESCE(d.id, 0) <= 0 THEN 'invalid' WHEN i.id IS NULL THEN 'not_found'
 WHEN i.status = 'sold' THEN 'blocked' ELSE 'deleted' END AS outcome
FROM (SELECT DISTINCT id FROM delete_batch) d LEFT JOIN item i ON i.id = d.id"""


def _patched(table, batch, key, allowed, **rules):
    """The whole table after a batch that names columns of all kinds."""
    return lambda c: edge(op.apply_patch(c[table], op.patch_map(c[batch], key, allowed, "seq"), allowed, seq="seq", **rules))


def _stock_value():
    return F.coalesce(F.col("quantity"), F.lit(0)) * zero_if_null("unit_price")


def _patched_sql(table, batch, key, columns, money="", derived=""):
    """Two patches in turn; ``columns`` are the table's, a ``+`` marks those a patch may set."""
    out = []
    for name in columns.split():
        col = name.lstrip("+")
        sql = (f"CASE WHEN b.has_{col} THEN b.{col} WHEN a.has_{col} THEN a.{col} ELSE t.{col} END" if name != col
               else f"t.{col}")
        out.append(f"{M(sql) if col in money.split() else sql} AS {col}")
    return (f"SELECT {', '.join(out)}{derived} FROM {table} t LEFT JOIN {batch} a ON a.{key} = t.id AND a.seq = 1 "
            f"LEFT JOIN {batch} b ON b.{key} = t.id AND b.seq = 2")


def _raw_flag(c):
    return f"CASE WHEN {c} IS NULL OR {c} IN ('false', '0', '0.0', '-0', '\"\"') THEN 0 ELSE 1 END"


# a changed row's value follows from its new quantity and price
_QTY, _PRICE = (f"CASE WHEN b.has_{c} THEN b.{c} WHEN a.has_{c} THEN a.{c} ELSE t.{c} END" for c in ("quantity", "unit_price"))
_CHANGED = " OR ".join(f"{p}.has_{c}" for p in "ab" for c in ("name", "category", "location_id", "quantity", "unit_price"))
STOCK_VALUE = f", {M(f'CASE WHEN {_CHANGED} THEN ({_QTY}) * ({_PRICE}) ELSE t.total_value END')} AS total_value"
PARTIAL = (f", CASE WHEN b.has_partial_delivery THEN {_raw_flag('b.partial_delivery')} WHEN a.has_partial_delivery "
           f"THEN {_raw_flag('a.partial_delivery')} ELSE t.partial_delivery END AS partial_delivery")


def _item_deletes(c):
    return op.apply_deletes(c.item, c.delete_batch, guard=F.col("status") == "sold")


ENTRIES = {
    "order_intake": (_intake, INTAKE),
    "order_status_reconcile": (
        lambda c: op.order_status_reconcile(c),
        f"SELECT o.id, o.status AS status_before, CASE WHEN o.id IN (SELECT id FROM ({FULLY_PAID}) f) THEN 'fulfilled' "
        "ELSE o.status END AS status FROM sales_order o"),
    "item_status_reconcile": (
        lambda c: op.item_status_reconcile(c),
        f"SELECT i.id, i.status AS status_before, CASE WHEN i.id IN (SELECT item_id FROM ({FULLY_PAID}) f "
        "WHERE item_id IS NOT NULL) THEN 'sold' ELSE i.status END AS status FROM item i"),
    "delivery_status_items": (
        lambda c: op.delivery_status_items(c),
        "SELECT i.id, CASE WHEN i.id IN (SELECT item_id FROM sales_order WHERE delivery_status = 'received' "
        "AND item_id IS NOT NULL) THEN 'sold' ELSE i.status END AS status FROM item i"),
    "backorder_assign": (lambda c: op.backorder_assign(c, c.assignments), ASSIGN),
    "installment_expand": (
        lambda c: op.installment_expand(c.installment_payloads, c.shipment),
        f"SELECT b.shipment_id, b.inst_key, {M('b.amount')} AS amount, b.due_date, CAST({PAID_RAW} AS INTEGER) AS is_paid, "
        f"COALESCE(b.paid_date, CASE WHEN {PAID_RAW} THEN s.date_received END) AS paid_date "
        "FROM installment_batch b LEFT JOIN shipment s ON s.id = b.shipment_id"),
    "work_log_earnings": (
        lambda c: op.work_log_earnings(c, c.work_batch),
        f"SELECT w.id, w.person_id, w.quantity, {M('p.rate')} AS rate, {M('p.rate * COALESCE(w.quantity, 0)')} "
        "AS amount_earned FROM work_batch w JOIN person p ON p.id = w.person_id"),
    "trip_work_log": (
        lambda c: op.trip_work_log(c),
        f"SELECT t.id AS transfer_id, t.transporter_id AS person_id, t.to_location_id AS location_id, "
        f"t.transfer_date AS log_date, 'trip' AS log_type, 1 AS quantity, {M(Z('p.rate'))} AS amount_earned "
        "FROM item_transfer t LEFT JOIN person p ON p.id = t.transporter_id WHERE COALESCE(t.transporter_id, 0) <> 0"),
    "transfer_apply": (lambda c: op.transfer_apply(c, c.transfer_batch), TRANSFER),
    "apply_patch": (
        lambda c: edge(op.apply_patch(c.item, op.patch_map(c.item_patch, "item_id", ["sale_price", "description"], "seq"),
                                      ITEM_PATCH_ALLOWED, seq="seq")),
        f"""SELECT i.id, i.shipment_id, i.location_id, i.name, i.category,
 CASE WHEN b.has_description THEN b.description WHEN a.has_description THEN a.description ELSE i.description END
   AS description,
 {M('i.purchase_value')} AS purchase_value,
 {M('CASE WHEN b.has_sale_price THEN b.sale_price WHEN a.has_sale_price THEN a.sale_price ELSE i.sale_price END')}
   AS sale_price, i.status
FROM item i LEFT JOIN item_patch a ON a.item_id = i.id AND a.seq = 1
LEFT JOIN item_patch b ON b.item_id = i.id AND b.seq = 2"""),
    "apply_patch_people": (
        lambda c: edge(op.apply_patch(c.person, op.patch_map(c.person_patch, "person_id", ["rate", "role"], "seq"),
                                      PERSON_PATCH_ALLOWED, seq="seq").select("id", "name", "role", "rate")),
        f"""SELECT p.id, p.name, COALESCE((SELECT x.role FROM person_patch x WHERE x.person_id = p.id AND x.has_role
   ORDER BY x.seq DESC LIMIT 1), p.role) AS role,
 {M('CASE WHEN b.has_rate THEN b.rate WHEN a.has_rate THEN a.rate ELSE p.rate END')} AS rate
FROM person p LEFT JOIN person_patch a ON a.person_id = p.id AND a.seq = 1
LEFT JOIN person_patch b ON b.person_id = p.id AND b.seq = 2"""),
    "apply_patch_orders": (
        lambda c: edge(op.apply_patch(c.sales_order, op.patch_map(c.order_patch, "order_id",
                                                                  ["discount", "delivery_status"], "seq"),
                                      ORDER_PATCH_ALLOWED, seq="seq").select("id", "status", "discount",
                                                                             "delivery_status")),
        f"""SELECT o.id, o.status,
 {M('CASE WHEN b.has_discount THEN b.discount WHEN a.has_discount THEN a.discount ELSE o.discount END')} AS discount,
 CASE WHEN b.has_delivery_status THEN b.delivery_status WHEN a.has_delivery_status THEN a.delivery_status
   ELSE o.delivery_status END AS delivery_status
FROM sales_order o LEFT JOIN order_patch a ON a.order_id = o.id AND a.seq = 1
LEFT JOIN order_patch b ON b.order_id = o.id AND b.seq = 2"""),
    "apply_patch_items_all": (
        _patched("item", "item_patch_all", "item_id", ITEM_PATCH_ALLOWED),
        _patched_sql("item", "item_patch_all", "item_id", "id +shipment_id +location_id +name +category +description "
                     "+purchase_value +sale_price +status", "purchase_value sale_price")),
    "apply_patch_people_all": (
        _patched("person", "person_patch_all", "person_id", PERSON_PATCH_ALLOWED),
        _patched_sql("person", "person_patch_all", "person_id", "id +name +role +rate +phone +employment_type "
                     "+payment_type +contract_start +contract_end +status", "rate")),
    "apply_patch_orders_all": (
        _patched("sales_order", "order_patch_all", "order_id", ORDER_PATCH_ALLOWED),
        _patched_sql("sales_order", "order_patch_all", "order_id", "id customer_id item_id location_id +agreed_price "
                     "+status is_backorder +backorder_description +expected_arrival order_date +discount "
                     "+delivery_status +fulfillment_trigger", "agreed_price discount")),
    "apply_patch_shipments": (
        _patched("shipment", "shipment_patch_all", "shipment_id", SHIPMENT_PATCH_ALLOWED,
                 convert={"partial_delivery": op.truthy}),
        _patched_sql("shipment", "shipment_patch_all", "shipment_id", "id supplier_id +date_received "
                     "+declared_value payment_status +notes +container_number +estimated_arrival +delivery_status "
                     "+image_url +account_notes", "declared_value", PARTIAL)),
    "apply_patch_suppliers": (
        _patched("erp_supplier", "supplier_patch_all", "supplier_id", SUPPLIER_PATCH_ALLOWED),
        _patched_sql("erp_supplier", "supplier_patch_all", "supplier_id", "id +name +phone +status +address +notes")),
    "apply_patch_customers": (
        _patched("erp_customer", "customer_patch_all", "customer_id", CUSTOMER_PATCH_ALLOWED),
        _patched_sql("erp_customer", "customer_patch_all", "customer_id", "id +name +phone +notes")),
    "apply_patch_expenses": (
        _patched("expense", "expense_patch_all", "expense_id", EXPENSE_PATCH_ALLOWED),
        _patched_sql("expense", "expense_patch_all", "expense_id", "id +description +amount +expense_date +category "
                     "+location_id +paid_by_person_id is_reimbursement +notes", "amount")),
    "apply_patch_inventory": (
        _patched("inventory", "inventory_patch_all", "inventory_id", INVENTORY_PATCH_ALLOWED,
                 derived={"total_value": _stock_value}),
        _patched_sql("inventory", "inventory_patch_all", "inventory_id", "id +name +category +location_id +quantity "
                     "+unit_price", "unit_price", STOCK_VALUE)),
    "replace_children": (
        lambda c: op.replace_children(c.item_image, c.image_replacement, "item_id", "url"),
        "SELECT item_id, id, url, 'kept' AS origin FROM item_image WHERE item_id NOT IN "
        "(SELECT item_id FROM image_replacement) UNION ALL SELECT item_id, CAST(NULL AS BIGINT), trim(url), 'new' "
        "FROM image_replacement WHERE trim(url) <> ''"),
    "replace_children_people": (
        lambda c: op.replace_children(c.person_location, c.person_location_replacement, "person_id", "location_id"),
        "SELECT person_id, id, location_id, 'kept' AS origin FROM person_location pl WHERE NOT EXISTS "
        "(SELECT 1 FROM person_location_replacement r WHERE r.person_id = pl.person_id) "
        "UNION ALL SELECT person_id, CAST(NULL AS BIGINT), location_id, 'new' FROM person_location_replacement "
        "WHERE location_id IS NOT NULL"),
    "apply_deletes": (_item_deletes, DELETES),
    "apply_deletes_survivors": (
        lambda c: op.surviving_rows(c.item, _item_deletes(c)).select("id", "name", "status"),
        f"SELECT i.id, i.name, i.status FROM item i WHERE i.id NOT IN (SELECT id FROM ({DELETES}) d "
        "WHERE outcome = 'deleted')"),
    "entity_lookup": (
        lambda c: op.entity_lookup(c.item, c.delete_batch, ["name", "status"]),
        "SELECT d.id, CASE WHEN COALESCE(d.id, 0) <= 0 THEN 'invalid' WHEN i.id IS NULL THEN 'not_found' "
        "ELSE 'found' END AS lookup, i.name, i.status FROM (SELECT DISTINCT id FROM delete_batch) d "
        "LEFT JOIN item i ON i.id = d.id"),
}
