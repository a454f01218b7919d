"""Registered validation and audit jobs; each oracle is an ordered CASE."""

from ledgerloom import fixed as fx
from ledgerloom.operators import validation as op

# an order takes its item from later orders: counted here by a window over the free claims
ORDERS = """SELECT id, CASE WHEN reason IS NULL AND COALESCE(item_id, 0) <> 0 AND COUNT(*) FILTER (WHERE reason IS NULL)
  OVER (PARTITION BY item_id ORDER BY id ROWS UNBOUNDED PRECEDING) > 1 THEN 'item_unavailable' ELSE reason END AS reason
FROM (SELECT b.id, b.item_id, CASE
 WHEN b.customer_id IS NULL OR b.customer_id = 0 THEN 'customer_id_required'
 WHEN b.location_id IS NULL OR b.location_id = 0 THEN 'location_id_required'
 WHEN b.agreed_price IS NULL THEN 'agreed_price_required'
 WHEN cu.id IS NULL THEN 'customer_not_found'
 WHEN lo.id IS NULL THEN 'location_not_found'
 WHEN b.is_backorder = 1 AND (b.backorder_description IS NULL OR trim(b.backorder_description) = '') THEN 'backorder_description_required'
 WHEN COALESCE(b.item_id, 0) <> 0 AND it.id IS NULL THEN 'item_not_found'
 WHEN COALESCE(b.item_id, 0) <> 0 AND it.status IN ('reserved', 'sold') THEN 'item_unavailable' END AS reason
FROM order_batch b LEFT JOIN erp_customer cu ON cu.id = b.customer_id LEFT JOIN location lo ON lo.id = b.location_id
LEFT JOIN item it ON it.id = b.item_id) z"""


def res(body: str, kind: str | None = None, extra: str = "") -> str:
    k = f"'{kind}' AS kind, " if kind else ""
    return f"SELECT {k}id, reason IS NULL AS accepted, reason{extra} FROM ({body}) r"


PAYMENTS = res("""SELECT b.id, CASE WHEN o.id IS NULL THEN 'order_not_found' WHEN b.amount IS NULL OR b.amount = 0
 THEN 'amount_required' WHEN b.payment_date IS NULL THEN 'payment_date_required' END AS reason
 FROM payment_batch b LEFT JOIN sales_order o ON o.id = b.order_id""", "order") + " UNION ALL " + res(
    """SELECT b.id, CASE WHEN p.id IS NULL THEN 'person_not_found' WHEN b.amount IS NULL OR b.amount = 0
 THEN 'amount_required' WHEN b.payment_date IS NULL THEN 'payment_date_required'
 WHEN b.method IS NULL OR b.method = '' THEN 'method_required' END AS reason
 FROM staff_payment_batch b LEFT JOIN person p ON p.id = b.person_id""", "staff")

SHIPMENTS = res("""SELECT b.id, CASE WHEN b.supplier_id IS NULL OR b.supplier_id = 0 THEN 'supplier_id_required'
 WHEN b.date_received IS NULL THEN 'date_received_required' WHEN b.declared_value IS NULL THEN 'declared_value_required'
 WHEN s.id IS NULL THEN 'supplier_not_found' END AS reason
 FROM shipment_batch b LEFT JOIN erp_supplier s ON s.id = b.supplier_id""", "shipment") + " UNION ALL " + res(
    """SELECT b.inst_key AS id, CASE WHEN sh.id IS NULL THEN 'shipment_not_found' WHEN b.amount IS NULL OR b.amount = 0
 THEN 'amount_required' WHEN b.due_date IS NULL THEN 'due_date_required' END AS reason
 FROM installment_batch b LEFT JOIN shipment sh ON sh.id = b.shipment_id""", "installment")

ITEMS = res("""SELECT b.id, CASE WHEN b.name IS NULL OR b.name = '' THEN 'name_required'
 WHEN b.location_id IS NULL OR b.location_id = 0 THEN 'location_id_required'
 WHEN b.purchase_value IS NULL THEN 'purchase_value_required' WHEN lo.id IS NULL THEN 'location_not_found'
 WHEN COALESCE(b.shipment_id, 0) <> 0 AND sh.id IS NULL THEN 'shipment_not_found' END AS reason
 FROM item_batch b LEFT JOIN location lo ON lo.id = b.location_id LEFT JOIN shipment sh ON sh.id = b.shipment_id""",
            "item") + " UNION ALL " + res(
    "SELECT id, CASE WHEN name IS NULL OR name = '' THEN 'name_required' END AS reason FROM inventory", "bulk")

# one transfer of an item after the other: the state of the recursion is where the item is
IN_TURN = """WITH RECURSIVE q AS (
  SELECT t.*, it.id AS it, it.status, it.location_id AS stored, lo.id AS lo,
   ROW_NUMBER() OVER (PARTITION BY t.item_id ORDER BY t.transfer_date NULLS FIRST, t.id) AS n
  FROM transfer_batch t LEFT JOIN item it ON it.id = t.item_id LEFT JOIN location lo ON lo.id = t.to_location_id),
 walk AS (
  SELECT item_id, CAST(0 AS BIGINT) AS n, MIN(stored) AS place, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS to_location_id,
   CAST(NULL AS VARCHAR) AS reason FROM q GROUP BY item_id
  UNION ALL
  SELECT q.item_id, q.n, CASE WHEN x.reason IS NULL THEN q.to_location_id ELSE w.place END, q.id, q.to_location_id, x.reason
  FROM walk w JOIN q ON q.item_id = w.item_id AND q.n = w.n + 1,
   LATERAL (SELECT CASE WHEN q.it IS NULL THEN 'item_not_found' WHEN q.status = 'sold' THEN 'item_sold'
    WHEN q.to_location_id IS NULL OR q.to_location_id = 0 THEN 'to_location_id_required'
    WHEN q.transfer_date IS NULL THEN 'transfer_date_required' WHEN q.to_location_id = w.place THEN 'same_location'
    WHEN q.lo IS NULL THEN 'location_not_found' END AS reason) x)"""
TRANSFERS = res(f"SELECT id, reason FROM ({IN_TURN} SELECT id, reason FROM walk WHERE n > 0) w")

PEOPLE = res("""SELECT id, CASE WHEN name IS NULL OR name = '' THEN 'name_required' WHEN role IS NULL OR role = ''
 THEN 'role_required' WHEN employment_type IS NULL OR employment_type = '' THEN 'employment_type_required'
 WHEN payment_type IS NULL OR payment_type = '' THEN 'payment_type_required' WHEN rate IS NULL THEN 'rate_required'
 WHEN COALESCE(n_locations, 0) = 0 THEN 'location_ids_required'
 WHEN employment_type = 'temporary' AND contract_start IS NULL THEN 'contract_start_required' END AS reason
 FROM people_batch""")

WORK = res("""SELECT w.id, CASE WHEN p.id IS NULL THEN 'person_not_found' WHEN w.log_date IS NULL THEN 'log_date_required'
 WHEN w.log_type IS NULL OR w.log_type = '' THEN 'log_type_required'
 WHEN w.location_id IS NULL OR w.location_id = 0 THEN 'location_id_required'
 WHEN w.quantity IS NULL THEN 'quantity_required' END AS reason
 FROM work_batch w LEFT JOIN person p ON p.id = w.person_id""")

EXPENSES = res("""SELECT id, paid_by_person_id, CASE WHEN description IS NULL OR description = '' THEN 'description_required'
 WHEN amount IS NULL THEN 'amount_required' WHEN expense_date IS NULL THEN 'expense_date_required'
 WHEN category IS NULL OR category = '' THEN 'category_required' END AS reason FROM expense_batch""",
               extra=", CASE WHEN COALESCE(paid_by_person_id, 0) <> 0 THEN 1 ELSE 0 END AS is_reimbursement")

CONTACTS = res(f"""SELECT id, CASE WHEN name IS NULL OR name = '' THEN 'name_required'
 WHEN length(name) < 3 OR length(name) > 100 THEN 'name_length'
 WHEN phone IS NULL OR phone = '' THEN 'phone_required'
 WHEN NOT regexp_full_match(phone, '{fx.SUPPLIER_PHONE.strip('^$')}') THEN 'phone_format'
 WHEN COALESCE(status, 'active') NOT IN ('active', 'inactive') THEN 'status_invalid' END AS reason FROM erp_supplier""",
               "supplier") + " UNION ALL " + res(f"""SELECT id, CASE WHEN name IS NULL OR name = '' THEN 'name_required'
 WHEN phone IS NULL OR phone = '' THEN 'phone_required'
 WHEN NOT regexp_full_match(phone, '{fx.CUSTOMER_PHONE.strip('^$')}') THEN 'phone_format' END AS reason
 FROM erp_customer""", "customer")

# the constraints of the DDL, listed here once more by table: allowed values, and what columns refer to
CHECKS = """location type: gallery warehouse
erp_supplier status: active inactive
shipment payment_status: unpaid partial settled
item status: on_display in_storage reserved sold in_transit
sales_order status: active backorder fulfilled cancelled
sales_order fulfillment_trigger: specific_order assigned_on_arrival customer_waiting
person role: accountant sales transporter cleaner worker other
person employment_type: permanent temporary daily_hire
person payment_type: monthly_salary daily_wage per_task mixed
person status: active inactive contract_ended
work_log log_type: day_worked task trip month_confirmed
person_payment method: cash bank_transfer
expense category: packaging cleaning tools repair other
transaction_log type: supplier customer payroll transport expense
transaction_log direction: inflow outflow"""

REFERENCES = """shipment: supplier_id erp_supplier
shipment_installment: shipment_id shipment
item: shipment_id shipment, location_id location
item_part: parent_item_id item, part_item_id item
item_image: item_id item
item_transfer: item_id item, from_location_id location, to_location_id location, transporter_id person
sales_order: customer_id erp_customer, item_id item, location_id location
order_payment: order_id sales_order
person_location: person_id person, location_id location
work_log: person_id person, location_id location, transfer_id item_transfer
person_payment: person_id person
expense: location_id location, paid_by_person_id person
transaction_log: location_id location
inventory: location_id location"""


def _enum_sql(line: str) -> str:
    (table, col), allowed = line.split(":")[0].split(), line.split(":")[1].split()
    ok = " OR ".join(f"{col} = '{v}'" for v in allowed)
    return (f"SELECT '{table}' AS table_name, '{col}' AS column_name, COUNT(*) FILTER (WHERE NOT ({ok})) AS bad_rows "
            f"FROM {table}")


def _fk_sql(line: str) -> list[str]:
    table, refs = line.split(": ")
    return [f"SELECT '{table}' AS table_name, '{col}' AS column_name, '{ref}' AS ref_table, "
            f"COUNT(*) FILTER (WHERE c.{col} IS NOT NULL AND p.id IS NULL) AS orphans "
            f"FROM {table} c LEFT JOIN {ref} p ON p.id = c.{col}" for col, ref in map(str.split, refs.split(", "))]


ENUM = " UNION ALL ".join(map(_enum_sql, CHECKS.splitlines()))
FK = " UNION ALL ".join(sql for line in REFERENCES.splitlines() for sql in _fk_sql(line))

ENTRIES = {
    "validate_orders": (lambda c: op.validate_orders(c), res(ORDERS)),
    "validate_payments": (lambda c: op.validate_payments(c), PAYMENTS),
    "validate_shipments": (lambda c: op.validate_shipments(c), SHIPMENTS),
    "validate_items": (lambda c: op.validate_items(c), ITEMS),
    "validate_transfers": (lambda c: op.validate_transfers(c), TRANSFERS),
    "validate_people": (lambda c: op.validate_people(c), PEOPLE),
    "validate_work_logs": (lambda c: op.validate_work_logs(c), WORK),
    "validate_expenses": (lambda c: op.validate_expenses(c), EXPENSES),
    "validate_contacts": (lambda c: op.validate_contacts(c), CONTACTS),
    "enum_audit": (lambda c: op.enum_audit(c), ENUM),
    "fk_audit": (lambda c: op.fk_audit(c), FK),
    "parse_payloads": (
        lambda c: op.parse_payloads(c.payload_batch),
        "SELECT id, CASE WHEN json_valid(body) THEN CAST(json_extract(body, '$.k') AS BIGINT) END AS k, "
        "NOT json_valid(body) AS malformed FROM payload_batch"),
}
