"""Literals that must equal the reference's for the results to
match (labels, prefixes, enum domains, patterns, limits). Kept together here,
as plain text, in the order the ERP defines them."""

# Ledger source tags (transaction_log.source_table).
ORDER_PAYMENT = "ORDER_PAYMENT"
SHIPMENT_INSTALLMENT = "SHIPMENT_INSTALLMENT"
PERSON_PAYMENT = "PERSON_PAYMENT"
ITEM_TRANSFER = "ITEM_TRANSFER"
EXPENSE = "EXPENSE"

# Counterparty fallbacks of the daily finance report.
UNKNOWN_CUSTOMER = "Unknown customer"
UNKNOWN_SUPPLIER = "Unknown supplier"
UNKNOWN_PERSON = "Unknown person"
TRANSPORT = "Transport"
EXPENSE_PARTY = "Expense"

# Generated notes and codes.
SHIPMENT_PAYMENT_NOTE = "Payment for shipment #"
SHIPMENT_HISTORY_NOTE = "For shipment #"
SUPPLIER_CODE_PREFIX = "#SPL-"
SUPPLIER_CODE_DIGITS = 4

# The ledger type enum, the ledger page size (default, cap),
# dashboard list length and monthly targets.
LEDGER_TYPES = ("supplier", "customer", "payroll", "transport", "expense")
PAGE_DEFAULT, PAGE_CAP = 50, 200
RECENT_ROWS = 10
DASHBOARD_TARGET, ACCOUNTS_TARGET = 50000, 600000

# The contact form rules of the client.
SUPPLIER_PHONE = r"^01[0125][0-9]{8}$"
CUSTOMER_PHONE = r"^[0-9+]+$"
SUPPLIER_STATUS = ("active", "inactive")

# The CHECK (... IN ...) enums of the schema (table, column, allowed).
ENUMS = (
    ("location", "type", ("gallery", "warehouse")),
    ("erp_supplier", "status", ("active", "inactive")),
    ("shipment", "payment_status", ("unpaid", "partial", "settled")),
    ("item", "status", ("on_display", "in_storage", "reserved", "sold", "in_transit")),
    ("sales_order", "status", ("active", "backorder", "fulfilled", "cancelled")),
    ("sales_order", "fulfillment_trigger", ("specific_order", "assigned_on_arrival", "customer_waiting")),
    ("person", "role", ("accountant", "sales", "transporter", "cleaner", "worker", "other")),
    ("person", "employment_type", ("permanent", "temporary", "daily_hire")),
    ("person", "payment_type", ("monthly_salary", "daily_wage", "per_task", "mixed")),
    ("person", "status", ("active", "inactive", "contract_ended")),
    ("work_log", "log_type", ("day_worked", "task", "trip", "month_confirmed")),
    ("person_payment", "method", ("cash", "bank_transfer")),
    ("expense", "category", ("packaging", "cleaning", "tools", "repair", "other")),
    ("transaction_log", "type", ("supplier", "customer", "payroll", "transport", "expense")),
    ("transaction_log", "direction", ("inflow", "outflow")),
)

# Foreign keys of the schema (table, column, referenced table).
FOREIGN_KEYS = (
    ("shipment", "supplier_id", "erp_supplier"),
    ("shipment_installment", "shipment_id", "shipment"),
    ("item", "shipment_id", "shipment"),
    ("item", "location_id", "location"),
    ("item_part", "parent_item_id", "item"),
    ("item_part", "part_item_id", "item"),
    ("item_transfer", "item_id", "item"),
    ("item_transfer", "from_location_id", "location"),
    ("item_transfer", "to_location_id", "location"),
    ("item_transfer", "transporter_id", "person"),
    ("sales_order", "customer_id", "erp_customer"),
    ("sales_order", "item_id", "item"),
    ("sales_order", "location_id", "location"),
    ("order_payment", "order_id", "sales_order"),
    ("person_location", "person_id", "person"),
    ("person_location", "location_id", "location"),
    ("work_log", "person_id", "person"),
    ("work_log", "location_id", "location"),
    ("work_log", "transfer_id", "item_transfer"),
    ("person_payment", "person_id", "person"),
    ("expense", "location_id", "location"),
    ("expense", "paid_by_person_id", "person"),
    ("transaction_log", "location_id", "location"),
    ("inventory", "location_id", "location"),
    ("item_image", "item_id", "item"),
)

# The columns that a patch may set, by table.
ITEM_PATCH_ALLOWED = ["name", "category", "description", "purchase_value", "sale_price", "status", "location_id",
                      "shipment_id"]
PERSON_PATCH_ALLOWED = ["name", "role", "phone", "employment_type", "payment_type", "rate", "contract_start",
                        "contract_end", "status"]
ORDER_PATCH_ALLOWED = ["status", "agreed_price", "backorder_description", "expected_arrival", "fulfillment_trigger",
                       "discount", "delivery_status"]
SHIPMENT_PATCH_ALLOWED = ["date_received", "declared_value", "partial_delivery", "notes", "container_number",
                          "estimated_arrival", "delivery_status", "image_url", "account_notes"]
SUPPLIER_PATCH_ALLOWED = ["name", "phone", "address", "notes", "status"]
CUSTOMER_PATCH_ALLOWED = ["name", "phone", "notes"]
EXPENSE_PATCH_ALLOWED = ["description", "amount", "expense_date", "category", "location_id", "paid_by_person_id", "notes"]
INVENTORY_PATCH_ALLOWED = ["name", "category", "location_id", "quantity", "unit_price"]
