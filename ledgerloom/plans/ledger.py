"""Registered ledger jobs. The oracle for ``post_ledger`` is the fixture's
own ledger derivation; the others restate each rule in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerloom import fixed as fx
from ledgerloom.operators import finance as fin
from ledgerloom.operators import ledger as op
from ledgerloom.operators import rules as rl
from ledgerloom.plans.edge import edge
from ledgerloom.plans.oracle import M
from ledgerloom.plans.params import AS_OF, TRADE_MONTH, TRADE_YEAR
from ledgerloom.session import ensure_checkpoint_dir

COLS = ("id, transaction_date, type, direction, {amt} AS amount, location_id, source_table, source_id, notes")
LCOLS = COLS.format(amt=M("amount"))

MANUAL = f"""SELECT id * 8 + 5 AS id, COALESCE(transaction_date, DATE '{AS_OF}') AS transaction_date, type, direction,
 {M('amount')} AS amount, CASE WHEN location_id = 0 THEN NULL ELSE location_id END AS location_id,
 CAST(NULL AS VARCHAR) AS source_table, source_id,
 '[' || party || '] ' || COALESCE(notes, '') AS notes
FROM manual_batch WHERE amount IS NOT NULL AND amount <> 0 AND COALESCE(direction, '') <> ''
 AND COALESCE(type, '') <> '' AND COALESCE(party, '') <> ''"""

# the mark with the highest seq among those that name the instalment's own shipment and have a flag
MARKED = f"""SELECT si.id, si.shipment_id, si.amount, si.due_date,
 CASE WHEN m.id IS NULL THEN si.is_paid WHEN m.is_paid <> 0 THEN 1 ELSE 0 END AS is_paid,
 CASE WHEN m.id IS NULL THEN si.paid_date WHEN m.is_paid <> 0 THEN COALESCE(m.paid_date, DATE '{AS_OF}') END AS paid_date
FROM shipment_installment si LEFT JOIN (SELECT k.*, ROW_NUMBER() OVER (PARTITION BY k.id ORDER BY k.seq DESC) AS rn
 FROM mark_batch k JOIN shipment_installment own ON own.id = k.id AND own.shipment_id = k.shipment_id
 WHERE k.is_paid IS NOT NULL) m ON m.id = si.id AND m.rn = 1"""

EXPENSE_LEFT = "SELECT e.id FROM expense e WHERE e.id NOT IN (SELECT id FROM delete_batch WHERE id > 0)"


def _marked(c):
    return rl.installment_mark_paid(c, c.mark_batch, AS_OF)


def _expenses_left(c):
    return rl.surviving_rows(c.expense, rl.apply_deletes(c.expense, c.delete_batch))


def _reconcile(c):
    return op.ledger_reconcile(op.post_ledger(c), c.ledger_dirty)


def _sink_path(c):
    return f"{ensure_checkpoint_dir(c.spark).rstrip('/')}/ledger-{uuid.uuid4().hex[:12]}"


def _sink_roundtrip(c):
    """Post the ledger in two batches that share their months, the second
    with half of the first one again, and read one month: the plan prunes to
    one ``tx_month``."""
    path, c = _sink_path(c), c.holding("line", "transaction_log")
    op.sink_ledger(c.transaction_log.filter("id % 2 = 0"), path, may_move=False)
    op.sink_ledger(c.transaction_log.filter("id % 2 <> 0 OR id % 4 = 0"), path, may_move=False)
    led = op.read_ledger(c.spark, path)
    return edge(fin.ledger_range(led, *fin.month_bounds(TRADE_YEAR, TRADE_MONTH)).select(*op.LEDGER_COLS))


def _sink_corrections(c):
    """A stored ledger takes a batch of corrected expenses (some change their
    month) and the ids of reversed postings; the whole new version."""
    path, c = _sink_path(c), c.holding("line", "shipment_installment", "transaction_log")
    first = op.sink_ledger(c.transaction_log, path, mode="replace")
    stored = op.read_ledger(c.spark, path, first)
    edited = c.expense_batch.select(F.col("id").alias("e_id"))
    changed = op.ledger_expense_sync(stored.filter(F.col("source_table") == fx.EXPENSE).join(
        edited, F.col("source_id") == F.col("e_id"), "left_semi"), c.expense_batch)
    left = op.ledger_reversals(stored, _marked(c), c.expense)
    reversed_ = stored.select("id").join(left.select("id"), "id", "left_anti")
    op.sink_ledger(changed, path, deletes=reversed_)
    return edge(op.read_ledger(c.spark, path).select(*op.LEDGER_COLS))


a, b = fin.month_bounds(TRADE_YEAR, TRADE_MONTH)

ENTRIES = {
    "post_ledger": (lambda c: edge(op.post_ledger(c)),
                    f"SELECT {LCOLS} FROM transaction_log WHERE source_table IS NOT NULL"),
    "manual_transactions": (lambda c: edge(op.manual_transactions(c.manual_batch, AS_OF)), MANUAL),
    "post_ledger_full": (
        lambda c: edge(op.post_ledger(c, manual=op.manual_transactions(c.manual_batch, AS_OF))),
        f"SELECT {LCOLS} FROM transaction_log WHERE source_table IS NOT NULL UNION ALL {MANUAL}"),
    "ledger_reconcile": (
        lambda c: _reconcile(c.holding("line", "shipment_installment")),
        """SELECT COALESCE(x.source_table, a.source_table) AS source_table, COALESCE(x.source_id, a.source_id) AS source_id,
 CASE WHEN a.source_table IS NULL THEN 'missing' WHEN x.source_table IS NULL THEN 'orphan'
      WHEN a.n > 1 THEN 'duplicate' WHEN a.lo <> x.amount OR a.hi <> x.amount THEN 'amount_mismatch' END AS issue,
 COALESCE(a.n, 0) AS ledger_rows, CAST(x.amount AS DOUBLE) AS expected_amount, CAST(a.hi AS DOUBLE) AS ledger_amount
FROM (SELECT source_table, source_id, amount FROM transaction_log WHERE source_table IS NOT NULL) x
FULL OUTER JOIN (SELECT source_table, source_id, COUNT(*) AS n, MIN(amount) AS lo, MAX(amount) AS hi FROM ledger_dirty
                 WHERE source_table IS NOT NULL GROUP BY source_table, source_id) a
 ON a.source_table = x.source_table AND a.source_id = x.source_id
WHERE a.source_table IS NULL OR x.source_table IS NULL OR a.n > 1 OR a.lo <> x.amount OR a.hi <> x.amount"""),
    "ledger_reversals": (
        lambda c: edge(op.ledger_reversals(c.transaction_log, _marked(c), _expenses_left(c))),
        f"""SELECT {LCOLS} FROM transaction_log t
WHERE CASE WHEN t.source_table = 'SHIPMENT_INSTALLMENT' THEN t.source_id IN (SELECT id FROM ({MARKED}) m WHERE is_paid = 1)
           WHEN t.source_table = 'EXPENSE' THEN t.source_id IN ({EXPENSE_LEFT})
           ELSE TRUE END"""),
    "ledger_expense_sync": (
        lambda c: edge(op.ledger_expense_sync(c.transaction_log, c.expense_batch)),
        f"""SELECT t.id, CASE WHEN e.id IS NOT NULL THEN e.expense_date ELSE t.transaction_date END AS transaction_date,
 t.type, t.direction, {M('CASE WHEN e.id IS NOT NULL THEN e.amount ELSE t.amount END')} AS amount,
 CASE WHEN e.id IS NOT NULL THEN e.location_id ELSE t.location_id END AS location_id, t.source_table, t.source_id,
 CASE WHEN e.id IS NOT NULL THEN e.description ELSE t.notes END AS notes
FROM transaction_log t LEFT JOIN expense_batch e ON t.source_table = 'EXPENSE' AND t.source_id = e.id"""),
    "sink_ledger": (
        _sink_roundtrip,
        f"SELECT {LCOLS} FROM transaction_log WHERE transaction_date >= DATE '{a}' AND transaction_date <= DATE '{b}'"),
    "sink_ledger_corrections": (
        _sink_corrections,
        f"""SELECT t.id, CASE WHEN e.id IS NOT NULL THEN e.expense_date ELSE t.transaction_date END AS transaction_date,
 t.type, t.direction, {M('CASE WHEN e.id IS NOT NULL THEN e.amount ELSE t.amount END')} AS amount,
 CASE WHEN e.id IS NOT NULL THEN e.location_id ELSE t.location_id END AS location_id, t.source_table, t.source_id,
 CASE WHEN e.id IS NOT NULL THEN e.description ELSE t.notes END AS notes
FROM transaction_log t LEFT JOIN expense_batch e ON t.source_table = 'EXPENSE' AND t.source_id = e.id
WHERE COALESCE(t.source_table, '') <> 'SHIPMENT_INSTALLMENT'
 OR t.source_id IN (SELECT id FROM ({MARKED}) m WHERE is_paid = 1)"""),
    "installment_mark_paid": (
        lambda c: edge(_marked(c)),
        f"SELECT id, shipment_id, {M('amount')} AS amount, due_date, is_paid, paid_date FROM ({MARKED}) m"),
    "installment_mark_paid_status": (
        lambda c: rl.payment_status_of(c.shipment, _marked(c)),
        f"""SELECT sh.id, CASE WHEN COALESCE(p.paid, 0) >= sh.declared_value THEN 'settled' WHEN COALESCE(p.paid, 0) > 0
 THEN 'partial' ELSE 'unpaid' END AS payment_status, {M('COALESCE(p.paid, 0)')} AS amount_paid
FROM shipment sh LEFT JOIN (SELECT shipment_id, SUM(amount) AS paid FROM ({MARKED}) m WHERE is_paid = 1
 GROUP BY shipment_id) p ON p.shipment_id = sh.id"""),
}

