"""ERP tables derived from the driver's star schema (see FIXTURES.md).

Fixed values: the derivation rules below are the test-fixture definitions
from FIXTURES.md, kept as written there (only ``ledger_dirty`` lists its
nine columns instead of ``*``, so it also works over a stored ledger that
carries a partition column) so that Spark and the DuckDB oracle see the
same rows.  Names in braces are other views or driver tables; Spark binds
them to DataFrames (``spark.sql(text, **frames)``), the oracle turns them
into CTE names.  Ids come from keys, never from a global row number.
"""

from __future__ import annotations

import re

# name -> SQL, in registration order (each may only use earlier names).
VIEWS: dict[str, str] = {
    "location": """SELECT CAST(n_nationkey+1 AS BIGINT) AS id, n_name AS name,
 CASE WHEN n_nationkey%2=0 THEN 'gallery' ELSE 'warehouse' END AS type FROM {nation}""",

    "erp_supplier": """SELECT s_suppkey+1 AS id, s_name AS name,
 '01' || lpad(CAST((s_suppkey*104729011)%1000000000 AS STRING),9,'0') AS phone,
 CASE WHEN s_acctbal<0 THEN 'inactive' ELSE 'active' END AS status,
 CASE WHEN s_suppkey%6=5 THEN NULL ELSE 'Street ' || CAST(s_suppkey%90+1 AS STRING) END AS address,
 CASE WHEN s_suppkey%3=0 THEN 'Supplier note ' || CAST(s_suppkey AS STRING) END AS notes FROM {supplier}""",

    "erp_customer": """SELECT c_custkey+1 AS id, c_name AS name,
 '01' || lpad(CAST((c_custkey*104729011)%1000000000 AS STRING),9,'0') AS phone,
 c_mktsegment AS notes FROM {customer}""",

    "line": """SELECT l_orderkey, l_linenumber, MIN(l_partkey) AS partkey, MIN(l_suppkey) AS suppkey,
 SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS amt, MAX(CAST(l_shipdate AS DATE)) AS d,
 MIN(l_returnflag) AS flag FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",

    "sales_order": """SELECT o.o_orderkey+1 AS id, o.o_custkey+1 AS customer_id,
 CASE WHEN o.o_orderstatus='P' THEN NULL ELSE f.partkey+1 END AS item_id,
 CAST(c.c_nationkey+1 AS BIGINT) AS location_id,
 CAST(o.o_totalprice AS DECIMAL(18,2)) AS agreed_price,
 CASE WHEN o.o_orderkey%10=0 THEN 'cancelled' WHEN o.o_orderstatus='F' THEN 'fulfilled'
      WHEN o.o_orderstatus='P' THEN 'backorder' ELSE 'active' END AS status,
 CASE WHEN o.o_orderstatus='P' THEN 1 ELSE 0 END AS is_backorder,
 CASE WHEN o.o_orderstatus='P' THEN o.o_orderpriority END AS backorder_description,
 CASE WHEN o.o_orderstatus='P' AND o.o_orderkey%3<>0
      THEN CAST(CAST(o.o_orderdate AS DATE) + INTERVAL 30 DAY AS DATE) END AS expected_arrival,
 CAST(o.o_orderdate AS DATE) AS order_date,
 CASE WHEN o.o_orderkey%5=0 THEN CAST(100 AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END AS discount,
 CASE WHEN o.o_orderkey%2=0 THEN 'received' ELSE 'not_received' END AS delivery_status,
 CASE WHEN o.o_orderstatus<>'P' THEN NULL WHEN o.o_orderkey%53=0 THEN 'whenever' WHEN o.o_orderkey%3=0 THEN 'specific_order'
      WHEN o.o_orderkey%3=1 THEN 'assigned_on_arrival' ELSE 'customer_waiting' END AS fulfillment_trigger
 FROM {orders} o JOIN {customer} c ON c.c_custkey=o.o_custkey
 LEFT JOIN (SELECT l_orderkey, MIN(partkey) AS partkey FROM {line} GROUP BY l_orderkey) f
 ON f.l_orderkey=o.o_orderkey""",

    "order_payment": """SELECT (l_orderkey+1)*10+l_linenumber AS id, l_orderkey+1 AS order_id,
 amt AS amount, d AS payment_date,
 CASE l_linenumber%4 WHEN 0 THEN 'cash' WHEN 1 THEN 'instapay' WHEN 2 THEN 'visa' ELSE 'vodafone_cash' END AS method,
 CASE WHEN l_orderkey%4=0 THEN 'Receipt ' || CAST(l_orderkey AS STRING) END AS notes
 FROM {line} WHERE flag<>'R'""",

    "shipment": """SELECT id, supplier_id, date_received, declared_value, payment_status, partial_delivery, notes,
 CASE WHEN id%4=0 THEN 'MSKU' || CAST(id AS STRING) END AS container_number,
 CASE WHEN id%3=0 THEN date_received END AS estimated_arrival,
 CASE id%4 WHEN 0 THEN 'pending' WHEN 1 THEN 'in_transit' ELSE 'received' END AS delivery_status,
 CASE WHEN id%5=0 THEN '/ship/' || CAST(id AS STRING) || '.jpg' END AS image_url,
 CASE WHEN id%6=0 THEN 'Account ' || CAST(id AS STRING) END AS account_notes FROM (SELECT (l_suppkey+1)*1000+(year(l_shipdate)-1990)*12+month(l_shipdate) AS id,
 l_suppkey+1 AS supplier_id, MIN(CAST(l_shipdate AS DATE)) AS date_received,
 SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS declared_value, 'unpaid' AS payment_status,
 CASE WHEN (l_suppkey+month(l_shipdate))%4=0 THEN 1 ELSE 0 END AS partial_delivery,
 CASE WHEN (l_suppkey+month(l_shipdate))%3=0 THEN 'Delivery of month ' || CAST(month(l_shipdate) AS STRING) END AS notes
 FROM {lineitem} GROUP BY l_suppkey, year(l_shipdate), month(l_shipdate)) x""",

    "shipment_installment": """SELECT shipment_id*10+l_linenumber AS id, shipment_id, amount, due_date,
 CASE shipment_id%3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE l_linenumber%2 END AS is_paid,
 CASE WHEN (CASE shipment_id%3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE l_linenumber%2 END)=1 THEN due_date END AS paid_date
 FROM (SELECT (l_suppkey+1)*1000+(year(l_shipdate)-1990)*12+month(l_shipdate) AS shipment_id, l_linenumber,
 SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS amount, MAX(CAST(l_shipdate AS DATE)) AS due_date
 FROM {lineitem} GROUP BY 1, l_linenumber) x""",

    "item": """SELECT p.p_partkey+1 AS id, s.sid AS shipment_id, p.p_partkey%25+1 AS location_id,
 p.p_name AS name, p.p_type AS category, p.p_brand AS description,
 CAST(p.p_retailprice*0.6 AS DECIMAL(18,2)) AS purchase_value, CAST(p.p_retailprice AS DECIMAL(18,2)) AS sale_price,
 CASE p.p_partkey%5 WHEN 0 THEN 'on_display' WHEN 1 THEN 'in_storage' WHEN 2 THEN 'reserved'
      WHEN 3 THEN 'sold' ELSE 'in_transit' END AS status
 FROM {part} p LEFT JOIN (SELECT l_partkey,
 MAX((l_suppkey+1)*1000+(year(l_shipdate)-1990)*12+month(l_shipdate)) AS sid FROM {lineitem} GROUP BY l_partkey) s
 ON s.l_partkey=p.p_partkey""",

    "item_part": """SELECT p_partkey+1 AS id, p_partkey-p_partkey%10+1 AS parent_item_id, p_partkey+1 AS part_item_id
 FROM {part} WHERE p_partkey%10 IN (1,2)""",

    "item_image": """SELECT p_partkey*2+1 AS id, p_partkey+1 AS item_id, '/img/' || CAST(p_partkey AS STRING) || '-a.jpg' AS url
 FROM {part} WHERE p_partkey%4<>0
 UNION ALL SELECT p_partkey*2+2, p_partkey+1, '/img/' || CAST(p_partkey AS STRING) || '-b.jpg' FROM {part} WHERE p_partkey%4=1""",

    "inventory": """SELECT p_partkey+1 AS id, p_name AS name, p_type AS category,
 CASE WHEN p_partkey%11=0 THEN NULL ELSE p_partkey%25+1 END AS location_id, p_size AS quantity,
 CAST(p_retailprice AS DECIMAL(18,2)) AS unit_price,
 CAST(p_size*CAST(p_retailprice AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS total_value
 FROM {part} WHERE p_partkey%3=0""",

    "person": """SELECT user_id+1 AS id, 'Person#' || CAST(user_id AS STRING) AS name,
 CASE user_id%6 WHEN 0 THEN 'accountant' WHEN 1 THEN 'sales' WHEN 2 THEN 'transporter'
      WHEN 3 THEN 'cleaner' WHEN 4 THEN 'worker' ELSE 'other' END AS role,
 CAST(10+user_id%50 AS DECIMAL(18,2)) AS rate,
 '01' || lpad(CAST((user_id*104729011)%1000000000 AS STRING),9,'0') AS phone,
 CASE WHEN user_id%41=7 THEN 'seasonal' WHEN user_id%3=0 THEN 'permanent' WHEN user_id%3=1 THEN 'temporary' ELSE 'daily_hire' END AS employment_type,
 CASE user_id%4 WHEN 0 THEN 'monthly_salary' WHEN 1 THEN 'daily_wage' WHEN 2 THEN 'per_task' ELSE 'mixed' END AS payment_type,
 CASE WHEN user_id%3=1 THEN DATE '2023-01-01' END AS contract_start,
 CASE WHEN user_id%6=1 THEN DATE '2024-12-31' END AS contract_end,
 CASE WHEN user_id%37=5 THEN 'away' WHEN user_id%9=0 THEN 'inactive' WHEN user_id%9=1 THEN 'contract_ended' ELSE 'active' END AS status
 FROM (SELECT DISTINCT user_id FROM {events}) u""",

    "person_location": """SELECT DISTINCT (user_id+1)*100+(user_id*3+event_id%3)%25+1 AS id, user_id+1 AS person_id,
 (user_id*3+event_id%3)%25+1 AS location_id FROM {events} WHERE user_id%7<>0
 UNION ALL SELECT DISTINCT (user_id+1)*100+50, user_id+1, (user_id*3)%25+1 FROM {events} WHERE user_id%11=3""",

    "work_log": """SELECT event_id+1 AS id, user_id+1 AS person_id, event_id%25+1 AS location_id,
 CAST(ts AS DATE) AS log_date, CASE event_type WHEN 'click' THEN 'day_worked' ELSE 'task' END AS log_type,
 1+event_id%3 AS quantity, CAST((10+user_id%50)*(1+event_id%3) AS DECIMAL(18,2)) AS amount_earned,
 CASE WHEN event_id%6=0 THEN (event_id%1000+1)*10+1 END AS transfer_id,
 CASE WHEN event_id%5=0 THEN 'Log ' || CAST(event_id AS STRING) END AS notes
 FROM {events} WHERE event_type IN ('click','view') AND user_id%10<>9""",

    "person_payment": """SELECT event_id+1 AS id, user_id+1 AS person_id, CAST(value AS DECIMAL(18,2)) AS amount,
 CAST(ts AS DATE) AS payment_date, CASE event_id%2 WHEN 0 THEN 'cash' ELSE 'bank_transfer' END AS method,
 CASE WHEN event_id%3=0 THEN 'Salary ' || CAST(event_id AS STRING) END AS notes
 FROM {events} WHERE event_type='signup'""",

    "expense": """SELECT event_id+1 AS id, 'Expense ' || CAST(event_id AS STRING) AS description,
 CAST(value AS DECIMAL(18,2)) AS amount, CAST(ts AS DATE) AS expense_date,
 CASE event_id%5 WHEN 0 THEN 'packaging' WHEN 1 THEN 'cleaning' WHEN 2 THEN 'tools' WHEN 3 THEN 'repair' ELSE 'other' END AS category,
 CASE WHEN event_id%7=0 THEN NULL ELSE event_id%25+1 END AS location_id,
 CASE WHEN event_id%4=0 THEN user_id+1 END AS paid_by_person_id,
 CASE WHEN event_id%4=0 THEN 1 ELSE 0 END AS is_reimbursement,
 CASE WHEN event_id%6=0 THEN 'Bill ' || CAST(event_id AS STRING) END AS notes FROM {events} WHERE event_type='error'""",

    "item_transfer": """SELECT (l_orderkey+1)*10+l_linenumber AS id, partkey+1 AS item_id, partkey%25+1 AS from_location_id,
 (partkey+l_linenumber)%25+1 AS to_location_id, d AS transfer_date,
 CASE WHEN l_linenumber%3=0 THEN CAST(0 AS DECIMAL(18,2)) ELSE CAST(amt*0.01 AS DECIMAL(18,2)) END AS transport_cost,
 CASE WHEN l_linenumber%2=0 THEN (l_orderkey%10)+1 END AS transporter_id,
 CASE WHEN l_linenumber%3=1 THEN 'Van ' || CAST(l_orderkey%9 AS STRING) END AS vehicle,
 CASE WHEN l_orderkey%3=0 THEN 'Move ' || CAST(l_orderkey AS STRING) END AS notes FROM {line} WHERE flag='R'""",

    "transaction_log": """SELECT p.id*8 AS id, p.payment_date AS transaction_date, 'customer' AS type, 'inflow' AS direction,
 p.amount, o.location_id, 'ORDER_PAYMENT' AS source_table, p.id AS source_id, CAST(NULL AS STRING) AS notes
 FROM {order_payment} p JOIN {sales_order} o ON o.id=p.order_id
UNION ALL SELECT si.id*8+1, si.paid_date, 'supplier','outflow', si.amount, i.loc, 'SHIPMENT_INSTALLMENT', si.id,
 'Payment for shipment #' || CAST(si.shipment_id AS STRING) FROM {shipment_installment} si
 LEFT JOIN (SELECT shipment_id, MIN(location_id) AS loc FROM {item} WHERE shipment_id IS NOT NULL GROUP BY shipment_id) i
 ON i.shipment_id=si.shipment_id WHERE si.is_paid=1
UNION ALL SELECT id*8+2, payment_date,'payroll','outflow',amount,NULL,'PERSON_PAYMENT',id,notes FROM {person_payment}
UNION ALL SELECT id*8+3, transfer_date,'transport','outflow',transport_cost,to_location_id,'ITEM_TRANSFER',id,notes
 FROM {item_transfer} WHERE transport_cost>0
UNION ALL SELECT id*8+4, expense_date,'expense','outflow',amount,location_id,'EXPENSE',id,description FROM {expense}
UNION ALL SELECT (event_id+1)*8+5, CAST(ts AS DATE), CASE WHEN event_id%2=0 THEN 'customer' ELSE 'expense' END,
 CASE WHEN event_id%2=0 THEN 'inflow' ELSE 'outflow' END, CAST(value AS DECIMAL(18,2)), event_id%25+1, NULL, NULL,
 '[Party ' || CAST(user_id AS STRING) || '] manual' FROM {events} WHERE event_type='purchase'""",

    # --- dirty batches for rule and validation jobs (FIXTURES.md section 4) ---
    "order_batch": """SELECT id, CASE WHEN id%17=0 THEN NULL WHEN id%19=0 THEN 999999999 ELSE customer_id END AS customer_id,
 CASE WHEN id%41=0 THEN 999999999 ELSE item_id END AS item_id,
 CASE WHEN id%23=0 THEN NULL WHEN id%29=0 THEN 999999999 ELSE location_id END AS location_id,
 CASE WHEN id%31=0 THEN NULL ELSE agreed_price END AS agreed_price, is_backorder,
 CASE WHEN id%37=0 THEN '  ' ELSE backorder_description END AS backorder_description,
 CASE id%3 WHEN 0 THEN agreed_price WHEN 1 THEN CAST(100 AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END AS initial_payment
 FROM {sales_order}""",

    "payment_batch": """SELECT id, CASE WHEN id%23=0 THEN 999999999 ELSE order_id END AS order_id,
 CASE WHEN id%17=0 THEN CAST(0 AS DECIMAL(18,2)) ELSE amount END AS amount,
 CASE WHEN id%19=0 THEN NULL ELSE payment_date END AS payment_date, method FROM {order_payment}""",

    "staff_payment_batch": """SELECT id, CASE WHEN id%23=0 THEN 999999999 ELSE person_id END AS person_id,
 CASE WHEN id%17=0 THEN NULL ELSE amount END AS amount, CASE WHEN id%19=0 THEN NULL ELSE payment_date END AS payment_date,
 CASE WHEN id%13=0 THEN NULL ELSE method END AS method FROM {person_payment}""",

    "shipment_batch": """SELECT id, CASE WHEN id%17=0 THEN NULL WHEN id%19=0 THEN 999999999 ELSE supplier_id END AS supplier_id,
 CASE WHEN id%23=0 THEN NULL ELSE date_received END AS date_received,
 CASE WHEN id%29=0 THEN NULL ELSE declared_value END AS declared_value FROM {shipment}""",

    "installment_batch": """SELECT shipment_id, id AS inst_key, amount, due_date,
 CASE id%9 WHEN 0 THEN 'true' WHEN 1 THEN '1' WHEN 2 THEN 'false' WHEN 3 THEN '"true"' WHEN 4 THEN '"1"'
      WHEN 5 THEN ' TRUE ' WHEN 6 THEN 'TRUE' WHEN 7 THEN '0' END AS is_paid_raw,
 CASE WHEN id%8=0 THEN due_date END AS paid_date FROM {shipment_installment}""",

    # for Spark alone (named_struct): a payload per shipment, a slot for each of its line numbers (id = shipment_id*10 + it)
    "installment_payloads": """SELECT shipment_id, filter(array(MAX(CASE WHEN inst_key%10=0 THEN inst END),
 MAX(CASE WHEN inst_key%10=1 THEN inst END),
 MAX(CASE WHEN inst_key%10=2 THEN inst END),
 MAX(CASE WHEN inst_key%10=3 THEN inst END),
 MAX(CASE WHEN inst_key%10=4 THEN inst END),
 MAX(CASE WHEN inst_key%10=5 THEN inst END),
 MAX(CASE WHEN inst_key%10=6 THEN inst END),
 MAX(CASE WHEN inst_key%10=7 THEN inst END),
 MAX(CASE WHEN inst_key%10=8 THEN inst END),
 MAX(CASE WHEN inst_key%10=9 THEN inst END)), x -> x IS NOT NULL) AS installments
 FROM (SELECT shipment_id, inst_key, named_struct('inst_key', inst_key, 'amount', amount, 'due_date', due_date,
 'is_paid_raw', is_paid_raw, 'paid_date', paid_date) AS inst FROM {installment_batch}) b GROUP BY shipment_id""",

    "item_batch": """SELECT id, CASE WHEN id%17=0 THEN '' ELSE name END AS name,
 CASE WHEN id%19=0 THEN NULL WHEN id%23=0 THEN 999999999 ELSE location_id END AS location_id,
 CASE WHEN id%29=0 THEN 999999999 ELSE shipment_id END AS shipment_id,
 CASE WHEN id%31=0 THEN NULL ELSE purchase_value END AS purchase_value FROM {item}""",

    # trips, some back to where the item was stored and some twice to the same place
    "transfer_batch": """SELECT t.id, CASE WHEN t.id%29=0 THEN 999999999 ELSE t.item_id END AS item_id,
 CASE WHEN t.id%17=0 THEN NULL WHEN t.id%19=0 THEN i.location_id WHEN t.id%23=0 THEN 999999999 ELSE t.to_location_id END AS to_location_id,
 CASE WHEN t.id%31=0 THEN NULL ELSE t.transfer_date END AS transfer_date, t.transport_cost, t.transporter_id
 FROM {item_transfer} t JOIN {item} i ON i.id=t.item_id
 UNION ALL SELECT t.id+1000000000000, t.item_id, CASE WHEN t.id%2=0 THEN i.location_id ELSE t.to_location_id END,
 CASE WHEN t.id%3=0 THEN t.transfer_date ELSE DATE '2024-01-01' END, t.transport_cost, t.transporter_id
 FROM {item_transfer} t JOIN {item} i ON i.id=t.item_id WHERE t.id%5<3
 UNION ALL SELECT t.id+2000000000000, t.item_id, t.to_location_id, DATE '2024-01-02', t.transport_cost, t.transporter_id
 FROM {item_transfer} t JOIN {item} i ON i.id=t.item_id WHERE t.id%7=0""",

    "people_batch": """SELECT p.id, CASE WHEN p.id%17=0 THEN NULL ELSE p.name END AS name, p.role,
 CASE p.id%3 WHEN 0 THEN 'permanent' WHEN 1 THEN 'temporary' ELSE 'daily_hire' END AS employment_type,
 CASE p.id%4 WHEN 0 THEN 'monthly_salary' WHEN 1 THEN 'daily_wage' WHEN 2 THEN 'per_task' ELSE 'mixed' END AS payment_type,
 CASE WHEN p.id%13=0 THEN NULL ELSE p.rate END AS rate,
 CASE WHEN p.id%2=0 THEN DATE '2024-01-01' END AS contract_start, COALESCE(l.n,0) AS n_locations
 FROM {person} p LEFT JOIN (SELECT person_id, COUNT(*) AS n FROM {person_location} GROUP BY person_id) l ON l.person_id=p.id""",

    "work_batch": """SELECT id, CASE WHEN id%23=0 THEN 999999999 ELSE person_id END AS person_id,
 CASE WHEN id%17=0 THEN NULL ELSE location_id END AS location_id, CASE WHEN id%19=0 THEN NULL ELSE log_date END AS log_date,
 CASE WHEN id%29=0 THEN NULL ELSE log_type END AS log_type, CASE WHEN id%31=0 THEN NULL ELSE quantity END AS quantity
 FROM {work_log}""",

    "expense_batch": """SELECT id, CASE WHEN id%17=0 THEN '' ELSE description END AS description,
 CASE WHEN id%19=0 THEN NULL ELSE amount END AS amount, CASE WHEN id%23=0 THEN NULL ELSE expense_date END AS expense_date,
 CASE WHEN id%29=0 THEN NULL WHEN id%31=0 THEN 'luxury' ELSE category END AS category, location_id, paid_by_person_id
 FROM {expense}""",

    "manual_batch": """SELECT event_id+1 AS id, CASE WHEN event_id%17=0 THEN NULL ELSE CAST(value AS DECIMAL(18,2)) END AS amount,
 CASE WHEN event_id%19=0 THEN NULL WHEN event_id%2=0 THEN 'inflow' ELSE 'outflow' END AS direction,
 CASE WHEN event_id%2=0 THEN 'customer' ELSE 'expense' END AS type,
 CASE WHEN event_id%23=0 THEN '' ELSE 'Party ' || CAST(user_id AS STRING) END AS party,
 CASE WHEN event_id%5=0 THEN NULL ELSE 'manual' END AS notes,
 CASE WHEN event_id%7=0 THEN NULL ELSE CAST(ts AS DATE) END AS transaction_date, event_id%25+1 AS location_id,
 CASE WHEN event_id%3=0 THEN event_id*2+1 END AS source_id
 FROM {events} WHERE event_type='purchase'""",

    "assignments": """SELECT id AS order_id, CASE WHEN id%43=0 THEN 999999999 ELSE id%200+1 END AS item_id
 FROM {sales_order} WHERE is_backorder=1 OR id%50=0
 UNION ALL SELECT id, id%200+8 FROM {sales_order} WHERE is_backorder=1 AND id%4=0
 UNION ALL SELECT id, id%7+1 FROM {sales_order} WHERE is_backorder=1 AND id%6=0""",

    "item_patch": """SELECT id AS item_id, 1 AS seq, id%2=0 AS has_sale_price,
 CASE WHEN id%2=0 THEN CAST(123.45 AS DECIMAL(18,2)) END AS sale_price, id%5=0 AS has_description,
 CAST(NULL AS STRING) AS description, id AS forbidden_id FROM {item} WHERE id%3=0
 UNION ALL SELECT id, 2, id%4=0, CASE WHEN id%8=0 THEN CAST(9.99 AS DECIMAL(18,2)) END, true,
 'second ' || CAST(id AS STRING), id FROM {item} WHERE id%9=0""",

    "person_patch": """SELECT id AS person_id, 1 AS seq, id%2=0 AS has_rate,
 CASE WHEN id%4=0 THEN CAST(77.50 AS DECIMAL(18,2)) END AS rate, id%3=0 AS has_role, 'worker' AS role FROM {person}
 UNION ALL SELECT id, 2, true, CAST(id%90+10 AS DECIMAL(18,2)), false, 'other' FROM {person} WHERE id%5=0""",

    "order_patch": """SELECT id AS order_id, 1 AS seq, id%2=0 AS has_discount, CAST(25.50 AS DECIMAL(18,2)) AS discount,
 id%3=0 AS has_delivery_status, 'received' AS delivery_status FROM {sales_order} WHERE id%4<>1
 UNION ALL SELECT id, 2, true, CAST(0 AS DECIMAL(18,2)), id%6=0, 'not_received' FROM {sales_order} WHERE id%10=0""",

    # --- one batch per table that sets every patchable column and a forbidden one, a second patch for some rows ---
    "item_patch_all": """SELECT id AS item_id, 1 AS seq,
 id%2=0 AS has_name, 'Item ' || CAST(id AS STRING) AS name,
 id%3=1 AS has_category, 'chair' AS category,
 id%5=0 AS has_description, CAST(NULL AS STRING) AS description,
 id%7=0 AS has_purchase_value, CAST(50.25 AS DECIMAL(18,2)) AS purchase_value,
 id%4=2 AS has_sale_price, CAST(123.45 AS DECIMAL(18,2)) AS sale_price,
 id%6=4 AS has_status, 'on_display' AS status,
 id%5=2 AS has_location_id, CAST(id%25+1 AS BIGINT) AS location_id,
 id%9=1 AS has_shipment_id, CAST(NULL AS BIGINT) AS shipment_id,
 CAST(-1 AS BIGINT) AS id FROM {item} WHERE id%2=0
 UNION ALL SELECT id, 2, id%3=0, 'Second ' || CAST(id AS STRING),
 id%4=0, CAST(NULL AS STRING),
 id%5=1, 'later',
 id%3=1, CAST(id%90 AS DECIMAL(18,2)),
 id%8=0, CAST(NULL AS DECIMAL(18,2)),
 id%6=0, 'in_storage',
 id%7=1, CAST(3 AS BIGINT),
 id%9=2, CAST(1001 AS BIGINT),
 CAST(-1 AS BIGINT) FROM {item} WHERE id%5<3""",

    "person_patch_all": """SELECT id AS person_id, 1 AS seq,
 id%2=0 AS has_name, 'Person ' || CAST(id AS STRING) AS name,
 id%3=1 AS has_role, 'worker' AS role,
 id%5=0 AS has_phone, CAST(NULL AS STRING) AS phone,
 id%7=0 AS has_employment_type, 'daily_hire' AS employment_type,
 id%4=1 AS has_payment_type, 'mixed' AS payment_type,
 id%2=1 AS has_rate, CAST(77.50 AS DECIMAL(18,2)) AS rate,
 id%6=0 AS has_contract_start, DATE '2024-03-01' AS contract_start,
 id%6=1 AS has_contract_end, CAST(NULL AS DATE) AS contract_end,
 id%9=1 AS has_status, 'inactive' AS status,
 CAST(-1 AS BIGINT) AS id FROM {person} WHERE id%3<>2
 UNION ALL SELECT id, 2, id%3=0, 'Second ' || CAST(id AS STRING),
 id%4=0, 'sales',
 id%5=1, '01000000000',
 id%3=1, 'permanent',
 id%7=2, 'per_task',
 id%5=2, CAST(id%90+10 AS DECIMAL(18,2)),
 id%3=2, CAST(NULL AS DATE),
 id%4=3, DATE '2025-06-30',
 id%9=3, 'active',
 CAST(-1 AS BIGINT) FROM {person} WHERE id%5<3""",

    "order_patch_all": """SELECT id AS order_id, 1 AS seq,
 id%5=0 AS has_status, 'fulfilled' AS status,
 id%3=1 AS has_agreed_price, CAST(999.99 AS DECIMAL(18,2)) AS agreed_price,
 id%7=0 AS has_backorder_description, 'two tables' AS backorder_description,
 id%6=0 AS has_expected_arrival, DATE '2004-01-15' AS expected_arrival,
 id%8=0 AS has_fulfillment_trigger, 'customer_waiting' AS fulfillment_trigger,
 id%2=0 AS has_discount, CAST(25.50 AS DECIMAL(18,2)) AS discount,
 id%3=2 AS has_delivery_status, 'received' AS delivery_status,
 CAST(99 AS BIGINT) AS location_id FROM {sales_order} WHERE id%4<>1
 UNION ALL SELECT id, 2, id%3=0, 'cancelled',
 id%4=0, CAST(id%5000 AS DECIMAL(18,2)),
 id%5=1, CAST(NULL AS STRING),
 id%4=2, CAST(NULL AS DATE),
 id%7=1, 'specific_order',
 id%5=2, CAST(0 AS DECIMAL(18,2)),
 id%6=0, 'not_received',
 CAST(99 AS BIGINT) FROM {sales_order} WHERE id%5<3""",

    "shipment_patch_all": """SELECT id AS shipment_id, 1 AS seq,
 id%2=0 AS has_date_received, DATE '1999-09-09' AS date_received,
 id%4=1 AS has_declared_value, CAST(4321.09 AS DECIMAL(28,2)) AS declared_value,
 id%2=1 AS has_partial_delivery, CASE id%11 WHEN 0 THEN 'true' WHEN 1 THEN '1' WHEN 2 THEN 'false' WHEN 3 THEN '0' WHEN 4 THEN '""'
      WHEN 5 THEN '"0"' WHEN 6 THEN '"false"' WHEN 7 THEN '0.0' WHEN 8 THEN '2' WHEN 9 THEN '-0' END AS partial_delivery,
 id%5=1 AS has_notes, CAST(NULL AS STRING) AS notes,
 id%3=0 AS has_container_number, 'C-' || CAST(id AS STRING) AS container_number,
 id%7=2 AS has_estimated_arrival, DATE '1999-10-01' AS estimated_arrival,
 id%4=0 AS has_delivery_status, 'in_transit' AS delivery_status,
 id%6=5 AS has_image_url, '/s/' || CAST(id AS STRING) || '.jpg' AS image_url,
 id%8=3 AS has_account_notes, 'paid late' AS account_notes,
 'settled' AS payment_status, CAST(-1 AS BIGINT) AS supplier_id FROM {shipment} WHERE id%3<>1
 UNION ALL SELECT id, 2, id%5=0, DATE '2000-02-29',
 id%6=0, CAST(id%5000 AS DECIMAL(28,2)),
 id%7=0, 'true',
 id%4=0, 'checked',
 id%5=2, CAST(NULL AS STRING),
 id%8=0, CAST(NULL AS DATE),
 id%3=0, 'received',
 id%9=0, CAST(NULL AS STRING),
 id%7=4, 'closed',
 'settled', CAST(-1 AS BIGINT) FROM {shipment} WHERE id%5<3""",

    "supplier_patch_all": """SELECT id AS supplier_id, 1 AS seq,
 id%2=0 AS has_name, 'Supplier ' || CAST(id AS STRING) AS name,
 id%3=1 AS has_phone, '01000000000' AS phone,
 id%5=0 AS has_address, CAST(NULL AS STRING) AS address,
 id%2=1 AS has_notes, 'new terms' AS notes,
 id%3=0 AS has_status, 'inactive' AS status,
 CAST(-1 AS BIGINT) AS id FROM {erp_supplier} WHERE id%4<>3
 UNION ALL SELECT id, 2, id%3=0, 'Second ' || CAST(id AS STRING),
 id%5=2, '01111111111',
 id%5=1, 'Harbour Road',
 id%6=0, CAST(NULL AS STRING),
 id%4=2, 'active',
 CAST(-1 AS BIGINT) FROM {erp_supplier} WHERE id%5<3""",

    "customer_patch_all": """SELECT id AS customer_id, 1 AS seq,
 id%2=0 AS has_name, 'Customer ' || CAST(id AS STRING) AS name,
 id%3=2 AS has_phone, '01000000000' AS phone,
 id%5=0 AS has_notes, CAST(NULL AS STRING) AS notes,
 CAST(-1 AS BIGINT) AS id FROM {erp_customer} WHERE id%3<>1
 UNION ALL SELECT id, 2, id%3=0, 'Second ' || CAST(id AS STRING),
 id%4=0, '01111111111',
 id%5=1, 'calls back',
 CAST(-1 AS BIGINT) FROM {erp_customer} WHERE id%5<3""",

    "expense_patch_all": """SELECT id AS expense_id, 1 AS seq,
 id%2=0 AS has_description, 'Bill of ' || CAST(id AS STRING) AS description,
 id%3=2 AS has_amount, CAST(88.80 AS DECIMAL(18,2)) AS amount,
 id%5=0 AS has_expense_date, DATE '2024-02-29' AS expense_date,
 id%4=1 AS has_category, 'tools' AS category,
 id%7=0 AS has_location_id, CAST(NULL AS BIGINT) AS location_id,
 id%2=1 AS has_paid_by_person_id, CAST(id%50+1 AS BIGINT) AS paid_by_person_id,
 id%6=3 AS has_notes, CAST(NULL AS STRING) AS notes,
 1-id%2 AS is_reimbursement FROM {expense} WHERE id%3<>1
 UNION ALL SELECT id, 2, id%3=0, 'corrected',
 id%4=0, CAST(id%700 AS DECIMAL(18,2)),
 id%5=1, DATE '2024-03-31',
 id%6=0, 'other',
 id%5=2, CAST(5 AS BIGINT),
 id%8=0, CAST(NULL AS BIGINT),
 id%4=2, 'receipt kept',
 1-id%2 FROM {expense} WHERE id%5<3""",

    "inventory_patch_all": """SELECT id AS inventory_id, 1 AS seq,
 id%2=0 AS has_name, 'Stock ' || CAST(id AS STRING) AS name,
 id%3=1 AS has_category, 'chair' AS category,
 id%5=1 AS has_location_id, CAST(NULL AS BIGINT) AS location_id,
 id%4=1 AS has_quantity, CAST(id%40 AS INT) AS quantity,
 id%6=4 AS has_unit_price, CAST(19.95 AS DECIMAL(18,2)) AS unit_price,
 CAST(-1 AS DECIMAL(18,2)) AS total_value FROM {inventory} WHERE id%4<>3
 UNION ALL SELECT id, 2, id%5=0, 'Second ' || CAST(id AS STRING),
 id%4=0, CAST(NULL AS STRING),
 id%7=0, CAST(4 AS BIGINT),
 id%8=0, 0,
 id%4=2, CAST(id%300 AS DECIMAL(18,2)),
 CAST(-1 AS DECIMAL(18,2)) FROM {inventory} WHERE id%5<3""",

    "person_location_replacement": """SELECT id AS person_id, CASE WHEN id%4=0 THEN NULL ELSE id%25+1 END AS location_id
 FROM {person} WHERE id%2=0 UNION ALL SELECT id, id%24+2 FROM {person} WHERE id%6=0""",

    "image_replacement": """SELECT id AS item_id, 1 AS pos, '  /new/' || CAST(id AS STRING) || '.jpg ' AS url FROM {item} WHERE id%7=0
 UNION ALL SELECT id, 2, '   ' FROM {item} WHERE id%7=0""",

    "ledger_dirty": """SELECT id, transaction_date, type, direction, amount, location_id, source_table, source_id, notes
 FROM {transaction_log} WHERE id%97<>0
 UNION ALL SELECT id+6, transaction_date, type, direction, amount, location_id, source_table, source_id, notes
 FROM {transaction_log} WHERE source_table='SHIPMENT_INSTALLMENT' AND source_id%101=0
 UNION ALL SELECT id+2, transaction_date, type, direction, amount, location_id, source_table, 999999999, notes
 FROM {transaction_log} WHERE source_table='EXPENSE' AND source_id%89=0""",

    "payload_batch": """SELECT event_id+1 AS id,
 CASE WHEN event_id%17=0 THEN substr(props,1,length(props)-1) ELSE props END AS body FROM {events}""",

    "mark_batch": """SELECT id, 1 AS seq, CASE WHEN id%23=0 THEN 999999999 ELSE shipment_id END AS shipment_id,
 CASE WHEN id%19=0 THEN NULL WHEN id%2=0 THEN 1 ELSE 0 END AS is_paid,
 CASE WHEN id%4=0 THEN due_date END AS paid_date FROM {shipment_installment} WHERE id%3=0
 UNION ALL SELECT id, 2, CASE WHEN id%5=0 THEN shipment_id+1 ELSE shipment_id END, CASE WHEN id%7=0 THEN NULL ELSE id%2 END,
 CAST(NULL AS DATE) FROM {shipment_installment} WHERE id%6=0""",

    "delete_batch": """SELECT id*3-2 AS id FROM {item} UNION ALL SELECT 999999999""",
}

RAW_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

_REF = re.compile(r"\{(\w+)\}")


def dependencies(name: str) -> list[str]:
    return list(dict.fromkeys(_REF.findall(VIEWS[name])))


def as_plain_sql(name: str) -> str:
    """The view text with bare table names (for the DuckDB oracle)."""
    return _REF.sub(lambda m: m.group(1), VIEWS[name])
