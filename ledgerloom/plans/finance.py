"""Registered ledger and finance queries with their DuckDB oracle SQL."""

from ledgerloom.operators import finance as op
from ledgerloom.plans.oracle import M, Z
from ledgerloom.plans.params import (AS_OF, EMPTY_MONTH, GALLERY_ID, WAREHOUSE_ID, EMPTY_YEAR, LEDGER_SEARCH, PAGE, PER_PAGE, STAFF_FROM,
                                     STAFF_MONTH, STAFF_TO, STAFF_YEAR, TARGET, TRADE_FROM, TRADE_MONTH, TRADE_TO,
                                     TRADE_YEAR)

# Party oracle: the source kind of each row picks one of four keyed lookups,
# each a LEFT JOIN (independent of the Spark plan's single union lookup).
KIND = """CASE WHEN t.type = 'customer' AND t.source_table = 'ORDER_PAYMENT' THEN 'C'
 WHEN t.type = 'supplier' THEN 'S' WHEN t.type = 'payroll' AND t.source_table = 'PERSON_PAYMENT' THEN 'P'
 WHEN t.type = 'transport' AND t.source_table = 'ITEM_TRANSFER' THEN 'T' END"""

PARTY_JOINS = """LEFT JOIN (SELECT op.id AS k, cu.name AS nm FROM order_payment op JOIN sales_order so ON so.id = op.order_id
   JOIN erp_customer cu ON cu.id = so.customer_id) pc ON pc.k = t.source_id AND ({kind}) = 'C'
 LEFT JOIN (SELECT si.id AS k, su.name AS nm FROM shipment_installment si JOIN shipment sp ON sp.id = si.shipment_id
   JOIN erp_supplier su ON su.id = sp.supplier_id) ps ON ps.k = t.source_id AND ({kind}) = 'S'
 LEFT JOIN (SELECT pp.id AS k, pe.name AS nm FROM person_payment pp JOIN person pe ON pe.id = pp.person_id) pr
   ON pr.k = t.source_id AND ({kind}) = 'P'
 LEFT JOIN (SELECT it.id AS k, pe.name AS nm FROM item_transfer it LEFT JOIN person pe ON pe.id = it.transporter_id) pt
   ON pt.k = t.source_id AND ({kind}) = 'T'""".format(kind=KIND)

PARTY = f"""CASE ({KIND})
 WHEN 'C' THEN COALESCE(pc.nm, 'Unknown customer') WHEN 'S' THEN COALESCE(ps.nm, 'Unknown supplier')
 WHEN 'P' THEN COALESCE(pr.nm, 'Unknown person') WHEN 'T' THEN COALESCE(pt.nm, 'Transport')
 ELSE CASE WHEN t.type = 'expense' THEN COALESCE(NULLIF(t.notes, ''), 'Expense') ELSE '' END END"""


def rng(a, b, col="transaction_date"):
    return f"{col} >= DATE '{a}' AND {col} <= DATE '{b}'"


def daily(a, b):
    i = "SUM(CASE WHEN direction = 'inflow' THEN amount ELSE 0 END)"
    o = "SUM(CASE WHEN direction = 'inflow' THEN 0 ELSE amount END)"
    s = "SUM(CASE WHEN direction = 'inflow' AND type = 'customer' THEN amount ELSE 0 END)"
    e = "SUM(CASE WHEN direction <> 'inflow' AND type = 'expense' THEN amount ELSE 0 END)"
    return (f"SELECT DATE '{a}' AS date_from, DATE '{b}' AS date_to, {M('i')} AS total_in, {M('o')} AS total_out, "
            f"{M('s')} AS total_sales, {M('e')} AS daily_expenses, {M('s - e')} AS net_profit, {M('i - o')} AS net "
            f"FROM (SELECT {Z(i)} AS i, {Z(o)} AS o, {Z(s)} AS s, {Z(e)} AS e FROM transaction_log WHERE {rng(a, b)}) x")


def entries_sql(a, b):
    return (f"SELECT t.id, t.direction, t.type, {PARTY} AS party, {M('t.amount')} AS amount, t.source_id, "
            f"l.name AS location FROM transaction_log t LEFT JOIN location l ON l.id = t.location_id {PARTY_JOINS} "
            f"WHERE {rng(a, b, 't.transaction_date')}")


def monthly_totals(y, m):
    a, b = op.month_bounds(y, m)
    i = Z("SUM(CASE WHEN direction = 'inflow' THEN amount ELSE 0 END)")
    o = Z("SUM(CASE WHEN direction = 'inflow' THEN 0 ELSE amount END)")
    return (f"SELECT {y} AS year, {m} AS month, {M('i')} AS total_in, {M('o')} AS total_out, {M('i - o')} AS net FROM "
            f"(SELECT {i} AS i, {o} AS o FROM transaction_log WHERE {rng(a, b)}) x")


def by_location(y, m):
    a, b = op.month_bounds(y, m)
    return (f"SELECT t.location_id, l.name AS location, {M('SUM(t.amount)')} AS amount FROM transaction_log t "
            f"JOIN location l ON l.id = t.location_id WHERE t.direction = 'inflow' AND {rng(a, b, 't.transaction_date')} "
            "GROUP BY t.location_id, l.name")


def by_type(y, m):
    a, b = op.month_bounds(y, m)
    return (f"SELECT type, {M('SUM(amount)')} AS amount FROM transaction_log WHERE direction = 'outflow' "
            f"AND {rng(a, b)} GROUP BY type")


def month_daily(y, m):
    a, b = op.month_bounds(y, m)
    i = Z("SUM(CASE WHEN direction = 'inflow' THEN amount ELSE 0 END)")
    o = Z("SUM(CASE WHEN direction = 'outflow' THEN amount ELSE 0 END)")
    return (f"SELECT transaction_date AS date, {M(i)} AS \"in\", {M(o)} AS \"out\", {M(i + ' - ' + o)} AS net "
            f"FROM transaction_log WHERE {rng(a, b)} GROUP BY transaction_date")


def gallery(a, b, loc=None):
    def cs(cond):
        return Z(f"SUM(CASE WHEN {cond} THEN t.amount ELSE 0 END)")
    return f"""SELECT l.id AS location_id, l.name AS location_name, DATE '{a}' AS date_from, DATE '{b}' AS date_to,
 {M(Z('f.rev'))} AS revenue, {', '.join(f'{M(Z("f.c_" + x))} AS cost_{x}' for x in op.COST_TYPES)},
 {M(Z('f.tot'))} AS costs_total, {M(Z('f.rev') + ' - ' + Z('f.tot'))} AS net, {M(Z('s.stock'))} AS stock_value
FROM location l
LEFT JOIN (SELECT t.location_id, {cs("t.direction = 'inflow'")} AS rev,
  {', '.join(cs(f"t.direction = 'outflow' AND t.type = '{x}'") + f' AS c_{x}' for x in op.COST_TYPES)},
  {cs("t.direction = 'outflow'")} AS tot
  FROM transaction_log t WHERE {rng(a, b, 't.transaction_date')} GROUP BY t.location_id) f ON f.location_id = l.id
LEFT JOIN (SELECT location_id, SUM(purchase_value) AS stock FROM item WHERE status != 'sold' GROUP BY location_id) s
 ON s.location_id = l.id
WHERE l.type = 'gallery'""" + (f" AND l.id = {loc}" if loc is not None else "")


LEDGER_SEL = (f"t.id, t.transaction_date, t.type, t.direction, {M('t.amount')} AS amount, t.location_id, t.source_table, "
              "t.source_id, t.notes, l.name AS location_name")


def search(where, page, per_page):
    w = f"WHERE {where}" if where else ""
    return (f"SELECT {LEDGER_SEL}, k.total_count FROM (SELECT * FROM transaction_log {w} "
            f"ORDER BY transaction_date DESC, id DESC LIMIT {per_page} OFFSET {(page - 1) * per_page}) t "
            f"LEFT JOIN location l ON l.id = t.location_id CROSS JOIN (SELECT COUNT(*) AS total_count "
            f"FROM transaction_log {w}) k")


KEYSET_DATE, KEYSET_ID = TRADE_TO, 80000000

OBLIG = f"""SELECT {M(Z('(SELECT SUM(i.amount) FROM shipment_installment i WHERE i.is_paid = 0 AND EXISTS '
                      '(SELECT 1 FROM shipment y JOIN erp_supplier u ON u.id = y.supplier_id WHERE y.id = i.shipment_id))'))}
 AS total_owed_to_suppliers,
 {M(Z('(SELECT SUM(b) FROM (SELECT ' + Z('(SELECT SUM(w.amount_earned) FROM work_log w WHERE w.person_id = pe.id)')
      + ' - ' + Z('(SELECT SUM(q.amount) FROM person_payment q WHERE q.person_id = pe.id)')
      + ' AS b FROM person pe) z WHERE b > 0)'))} AS total_owed_to_staff,
 {M(Z('(SELECT SUM(r) FROM (SELECT o.agreed_price - ' + Z('(SELECT SUM(op.amount) FROM order_payment op WHERE op.order_id = o.id)')
      + ' AS r FROM sales_order o WHERE o.status <> \'cancelled\' AND EXISTS (SELECT 1 FROM erp_customer c WHERE c.id = o.customer_id)) z '
      'WHERE r > 0)'))} AS total_owed_by_customers"""


def target(y, m):
    return (f"SELECT {TARGET} AS target, total_in AS achieved, CAST(CASE WHEN {TARGET} = 0 THEN 0 ELSE "
            f"least(floor(total_in / {float(TARGET)} * 100 + 0.5), 100) END AS BIGINT) AS percent, "
            f"{float(TARGET)} - total_in AS remaining FROM ({monthly_totals(y, m)}) x")


ENTRIES = {
    "ledger_party": (
        lambda c: op.ledger_party(c).select("id", "party"),
        f"SELECT t.id, {PARTY} AS party FROM transaction_log t {PARTY_JOINS}"),
    "finance_daily": (lambda c: op.finance_daily(c, STAFF_FROM, STAFF_TO), daily(STAFF_FROM, STAFF_TO)),
    "finance_daily_trade": (lambda c: op.finance_daily(c, TRADE_FROM, TRADE_TO), daily(TRADE_FROM, TRADE_TO)),
    "finance_daily_entries": (lambda c: op.finance_daily_entries(c.holding("line", "shipment_installment"), TRADE_FROM, TRADE_TO),
                              entries_sql(TRADE_FROM, TRADE_TO)),
    "finance_daily_entries_staff": (lambda c: op.finance_daily_entries(c.holding("line", "shipment_installment"), STAFF_FROM, STAFF_TO),
                                    entries_sql(STAFF_FROM, STAFF_TO)),
    "finance_monthly_totals": (lambda c: op.finance_monthly_totals(c, TRADE_YEAR, TRADE_MONTH),
                               monthly_totals(TRADE_YEAR, TRADE_MONTH)),
    "finance_monthly_totals_staff": (lambda c: op.finance_monthly_totals(c, STAFF_YEAR, STAFF_MONTH),
                                     monthly_totals(STAFF_YEAR, STAFF_MONTH)),
    "finance_monthly_totals_empty": (lambda c: op.finance_monthly_totals(c, EMPTY_YEAR, EMPTY_MONTH),
                                     monthly_totals(EMPTY_YEAR, EMPTY_MONTH)),
    "finance_monthly_revenue_by_location": (
        lambda c: op.finance_monthly_revenue_by_location(c, TRADE_YEAR, TRADE_MONTH), by_location(TRADE_YEAR, TRADE_MONTH)),
    "finance_monthly_costs_by_type": (
        lambda c: op.finance_monthly_costs_by_type(c, STAFF_YEAR, STAFF_MONTH), by_type(STAFF_YEAR, STAFF_MONTH)),
    "finance_monthly_daily": (
        lambda c: op.finance_monthly_daily(c, TRADE_YEAR, TRADE_MONTH), month_daily(TRADE_YEAR, TRADE_MONTH)),
    "gallery_pnl": (lambda c: op.gallery_pnl(c, TRADE_FROM, TRADE_TO), gallery(TRADE_FROM, TRADE_TO)),
    "gallery_pnl_staff": (lambda c: op.gallery_pnl(c, STAFF_FROM, STAFF_TO), gallery(STAFF_FROM, STAFF_TO)),
    "gallery_pnl_warehouse": (  # a warehouse is not a gallery: no row
        lambda c: op.gallery_pnl(c, TRADE_FROM, TRADE_TO, location_id=WAREHOUSE_ID),
        gallery(TRADE_FROM, TRADE_TO, WAREHOUSE_ID)),
    "gallery_pnl_one": (
        lambda c: op.gallery_pnl(c, TRADE_FROM, TRADE_TO, location_id=GALLERY_ID),
        gallery(TRADE_FROM, TRADE_TO, GALLERY_ID)),
    "obligations_totals": (lambda c: op.obligations_totals(c, AS_OF), OBLIG),
    "dashboard_overview": (
        lambda c: op.dashboard_overview(c),
        "SELECT {i} AS total_in, {o} AS total_out, {n} AS net_profit FROM (SELECT {si} AS i, {so} AS o FROM transaction_log) x"
        .format(i=M("i"), o=M("o"), n=M("i - o"),
                si=Z("SUM(CASE WHEN direction = 'inflow' THEN amount ELSE 0 END)"),
                so=Z("SUM(CASE WHEN direction = 'outflow' THEN amount ELSE 0 END)"))),
    "dashboard_expenses": (
        lambda c: op.dashboard_expenses(c, STAFF_TO),
        f"SELECT category, {M('SUM(amount)')} AS total FROM expense WHERE {rng('1970-01-01', STAFF_TO, 'expense_date')} "
        "GROUP BY category"),
    "dashboard_month_inflow": (
        lambda c: op.dashboard_month_inflow(c, AS_OF),
        f"SELECT {M(Z('SUM(amount)'))} AS current_month_inflow, 50000 AS monthly_target FROM transaction_log "
        f"WHERE direction = 'inflow' AND transaction_date >= DATE '{AS_OF.replace(day=1)}'"),
    "dashboard_type_distribution": (
        lambda c: op.dashboard_type_distribution(c),
        f"SELECT type, {M('SUM(amount)')} AS total FROM transaction_log GROUP BY type"),
    "target_progress": (lambda c: op.target_progress(c, TARGET, TRADE_YEAR, TRADE_MONTH), target(TRADE_YEAR, TRADE_MONTH)),
    "target_progress_staff": (lambda c: op.target_progress(c, TARGET, STAFF_YEAR, STAFF_MONTH),
                              target(STAFF_YEAR, STAFF_MONTH)),
    "expense_list": (
        lambda c: op.expense_list(c, date_from=STAFF_FROM, date_to=STAFF_TO),
        f"SELECT e.id, e.description, {M('e.amount')} AS amount, e.expense_date, e.category, e.location_id, "
        f"e.paid_by_person_id, l.name AS location_name, k.total FROM expense e LEFT JOIN location l ON l.id = e.location_id "
        f"CROSS JOIN (SELECT {M(Z('SUM(amount)'))} AS total FROM expense WHERE {rng(STAFF_FROM, STAFF_TO, 'expense_date')}) k "
        f"WHERE {rng(STAFF_FROM, STAFF_TO, 'e.expense_date')}"),
    "expense_list_category": (
        lambda c: op.expense_list(c, category="tools", location_id=GALLERY_ID),
        f"SELECT e.id, e.description, {M('e.amount')} AS amount, e.expense_date, e.category, e.location_id, "
        f"e.paid_by_person_id, l.name AS location_name, k.total FROM expense e LEFT JOIN location l ON l.id = e.location_id "
        f"CROSS JOIN (SELECT {M(Z('SUM(amount)'))} AS total FROM expense WHERE category = 'tools' AND location_id = 3) k "
        f"WHERE e.category = 'tools' AND e.location_id = 3"),
    "expense_categories": (lambda c: op.expense_categories(c),
                           "SELECT DISTINCT category FROM expense WHERE category IS NOT NULL"),
    "transaction_search": (
        lambda c: op.transaction_search(c, search=LEDGER_SEARCH, page=1, per_page=PER_PAGE),
        search(f"notes ILIKE '%{LEDGER_SEARCH}%'", 1, PER_PAGE)),
    "transaction_search_page": (
        lambda c: op.transaction_search(c, direction="outflow", date_from=TRADE_FROM, date_to=TRADE_TO, page=PAGE,
                                        per_page=PER_PAGE),
        search(f"direction = 'outflow' AND {rng(TRADE_FROM, TRADE_TO)}", PAGE, PER_PAGE)),
    "transaction_search_typed": (
        lambda c: op.transaction_search(c, type_="supplier", location_id=GALLERY_ID, page=2, per_page=PER_PAGE),
        search(f"type = 'supplier' AND location_id = {GALLERY_ID}", 2, PER_PAGE)),
    "transaction_page_keyset": (
        lambda c: op.transaction_page_keyset(c, KEYSET_DATE, KEYSET_ID, PER_PAGE),
        f"SELECT {LEDGER_SEL} FROM (SELECT * FROM transaction_log WHERE transaction_date < DATE '{KEYSET_DATE}' OR "
        f"(transaction_date = DATE '{KEYSET_DATE}' AND id < {KEYSET_ID}) ORDER BY transaction_date DESC, id DESC "
        f"LIMIT {PER_PAGE}) t LEFT JOIN location l ON l.id = t.location_id"),
    "recent_transactions": (
        lambda c: op.recent_transactions(c, 10),
        f"SELECT {LEDGER_SEL} FROM (SELECT * FROM transaction_log ORDER BY transaction_date DESC, id DESC LIMIT 10) t "
        "LEFT JOIN location l ON l.id = t.location_id"),
    "inflow_outflow_split": (
        lambda c: op.inflow_outflow_split(c, 10),
        f"SELECT t.direction AS side, t.id, t.transaction_date, t.type, {M('t.amount')} AS amount, l.name AS location_name "
        "FROM (SELECT * FROM transaction_log ORDER BY transaction_date DESC, id DESC LIMIT 10) t "
        "LEFT JOIN location l ON l.id = t.location_id WHERE t.direction IN ('inflow', 'outflow')"),
}
