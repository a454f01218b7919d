"""Registered streaming jobs, checked against their batch twins."""

from ledgerloom.plans.oracle import M, Z
from ledgerloom.streaming import replay


def _dedup_stored(c):
    return replay.stream_ledger_dedup(c, stored=c.transaction_log.filter("source_id % 2 = 0"))


ENTRIES = {
    "stream_ledger_daily": (
        lambda c: replay.stream_ledger_daily(c),
        "SELECT transaction_date AS date, {i} AS \"in\", {o} AS \"out\", {n} AS net FROM transaction_log "
        "GROUP BY transaction_date".format(
            i=M(Z("SUM(CASE WHEN direction = 'inflow' THEN amount ELSE 0 END)")),
            o=M(Z("SUM(CASE WHEN direction = 'outflow' THEN amount ELSE 0 END)")),
            n=M(Z("SUM(CASE WHEN direction = 'inflow' THEN amount ELSE 0 END)") + " - "
                + Z("SUM(CASE WHEN direction = 'outflow' THEN amount ELSE 0 END)")))),
    "stream_ledger_dedup": (
        lambda c: replay.stream_ledger_dedup(c.holding("line")),
        "SELECT DISTINCT source_table, source_id, CAST(NULL AS BIGINT) AS manual_id FROM ledger_dirty "
        "WHERE source_table IS NOT NULL UNION ALL SELECT NULL, NULL, id FROM ledger_dirty WHERE source_table IS NULL"),
    # half of the sources are in the stored ledger already
    "stream_ledger_dedup_stored": (
        lambda c: _dedup_stored(c.holding("line", "transaction_log")),
        "SELECT DISTINCT d.source_table, d.source_id, CAST(NULL AS BIGINT) AS manual_id FROM ledger_dirty d "
        "WHERE d.source_table IS NOT NULL AND NOT EXISTS (SELECT 1 FROM transaction_log t WHERE t.source_id % 2 = 0 "
        "AND t.source_table = d.source_table AND t.source_id = d.source_id) "
        "UNION ALL SELECT NULL, NULL, id FROM ledger_dirty WHERE source_table IS NULL"),
    "stream_order_fulfilment": (
        lambda c: replay.stream_order_fulfilment(c),
        f"SELECT o.id AS order_id, {M('o.agreed_price')} AS agreed_price FROM sales_order o "
        "JOIN (SELECT order_id, SUM(amount) AS paid FROM order_payment GROUP BY order_id) p ON p.order_id = o.id "
        "WHERE o.status = 'active' AND p.paid >= o.agreed_price"),
}
