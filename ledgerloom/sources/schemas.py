"""Explicit schemas of the 18 ERP tables (DDL strings), used to read a
stored catalog without inferring anything. Money is exact DECIMAL; sums
carried as table columns (declared values, instalment and payment amounts)
have the wider DECIMAL(28,2) of a decimal SUM. ``tests`` pin these to the
derivations in ``views.py``."""

ERP_SCHEMAS: dict[str, str] = {
    "location": "id bigint, name string, type string",
    "erp_supplier": "id bigint, name string, phone string, status string, address string, notes string",
    "shipment": "id bigint, supplier_id bigint, date_received date, declared_value decimal(28,2), payment_status string, "
                "partial_delivery int, notes string, container_number string, estimated_arrival date, "
                "delivery_status string, image_url string, account_notes string",
    "shipment_installment": "id bigint, shipment_id bigint, amount decimal(28,2), due_date date, is_paid int, "
                            "paid_date date",
    "item": "id bigint, shipment_id bigint, location_id bigint, name string, category string, description string, "
            "purchase_value decimal(18,2), sale_price decimal(18,2), status string",
    "item_part": "id bigint, parent_item_id bigint, part_item_id bigint",
    "item_image": "id bigint, item_id bigint, url string",
    "item_transfer": "id bigint, item_id bigint, from_location_id bigint, to_location_id bigint, transfer_date date, "
                     "transport_cost decimal(18,2), transporter_id bigint, vehicle string, notes string",
    "erp_customer": "id bigint, name string, phone string, notes string",
    "sales_order": "id bigint, customer_id bigint, item_id bigint, location_id bigint, agreed_price decimal(18,2), "
                   "status string, is_backorder int, backorder_description string, expected_arrival date, "
                   "order_date date, discount decimal(18,2), delivery_status string, fulfillment_trigger string",
    "order_payment": "id bigint, order_id bigint, amount decimal(28,2), payment_date date, method string, "
                     "notes string",
    "person": "id bigint, name string, role string, rate decimal(18,2), phone string, employment_type string, "
              "payment_type string, contract_start date, contract_end date, status string",
    "person_location": "id bigint, person_id bigint, location_id bigint",
    "work_log": "id bigint, person_id bigint, location_id bigint, log_date date, log_type string, quantity bigint, "
                "amount_earned decimal(18,2), transfer_id bigint, notes string",
    "person_payment": "id bigint, person_id bigint, amount decimal(18,2), payment_date date, method string, notes string",
    "expense": "id bigint, description string, amount decimal(18,2), expense_date date, category string, "
               "location_id bigint, paid_by_person_id bigint, is_reimbursement int, notes string",
    "transaction_log": "id bigint, transaction_date date, type string, direction string, amount decimal(28,2), "
                       "location_id bigint, source_table string, source_id bigint, notes string",
    "inventory": "id bigint, name string, category string, location_id bigint, quantity int, "
                 "unit_price decimal(18,2), total_value decimal(18,2)",
}
