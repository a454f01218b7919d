"""Write-side rules of the reference applied to whole tables or change
batches (SURVEY 2.7). Each job returns the rows to write; nothing is
mutated in place. Per-key conflicts are settled with aggregates
(``min``/``max_by``), not row_number windows, so a hot key never lands
in a single window partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import first_reason, missing, money, union_all, zero_if_null
from ledgerloom.functions.graph import components, written
from ledgerloom.operators.sales import paid_by_order
from ledgerloom.operators.validation import transfers_in_turn
from ledgerloom.sources.catalog import Catalog

# ---------------------------------------------------------------- orders

def order_intake(c: Catalog, batch: DataFrame, accepted: DataFrame) -> DataFrame:
    """Status of each accepted new order: ``backorder``; ``fulfilled`` when
    the initial payment covers the price; else ``active``. Also the item
    status to set and the opening balance."""
    b = batch.join(accepted.select(F.col("id").alias("a_id")), batch.id == F.col("a_id"), "left_semi")
    is_back = F.col("is_backorder") == 1
    status = (F.when(is_back, "backorder")
              .when(F.col("initial_payment") >= F.col("agreed_price"), "fulfilled").otherwise("active"))
    paid = F.when(F.col("initial_payment") > 0, F.col("initial_payment")).otherwise(F.lit(0).cast("decimal(18,2)"))
    return b.select(
        "id", status.alias("status"),
        F.when(missing("item_id"), F.lit(None)).when(status == "fulfilled", "sold").otherwise("reserved").alias("item_status"),
        money(paid).alias("total_paid"), money(F.col("agreed_price") - paid).alias("remaining_balance"),
        (F.col("initial_payment") > 0).cast("int").alias("posts_ledger"))


def _fully_paid_active(c: Catalog) -> DataFrame:
    """Orders that are active and fully paid: ``coalesce(paid,0) >= price``
    (a zero-price order without payments counts, Q18)."""
    o = c.sales_order
    p = paid_by_order(c)
    return (o.join(p, o.id == p.order_id, "left")
            .filter((F.col("status") == "active") & (zero_if_null("total_paid") >= F.col("agreed_price")))
            .select(F.col("id").alias("paid_order_id"), F.col("item_id").alias("paid_item_id")))


def order_status_reconcile(c: Catalog) -> DataFrame:
    """Repair job: active orders fully paid become ``fulfilled``."""
    o = c.sales_order
    hit = _fully_paid_active(c)
    j = o.join(hit, o.id == hit.paid_order_id, "left")
    return j.select("id", F.col("status").alias("status_before"),
                    F.when(F.col("paid_order_id").isNotNull(), "fulfilled").otherwise(F.col("status")).alias("status"))


def item_status_reconcile(c: Catalog) -> DataFrame:
    """Repair job, same snapshot: items of those orders become ``sold``."""
    hit = _fully_paid_active(c).filter(F.col("paid_item_id").isNotNull()).select("paid_item_id").distinct()
    i = c.item
    j = i.join(hit, i.id == hit.paid_item_id, "left")
    return j.select("id", F.col("status").alias("status_before"),
                    F.when(F.col("paid_item_id").isNotNull(), "sold").otherwise(F.col("status")).alias("status"))


def delivery_status_items(c: Catalog) -> DataFrame:
    """Items of orders whose delivery is ``received`` become ``sold`` (Q20)."""
    rec = (c.sales_order.filter((F.col("delivery_status") == "received") & F.col("item_id").isNotNull())
           .select(F.col("item_id").alias("rec_item")).distinct())
    i = c.item
    j = i.join(rec, i.id == rec.rec_item, "left")
    return j.select("id", F.when(F.col("rec_item").isNotNull(), "sold").otherwise(F.col("status")).alias("status"))


#: Claims that one task settles, one after the other.
CLAIMS_IN_TASK = 262_144


def _settled(claims: DataFrame) -> DataFrame:
    """Claims that stand, of partitions that each hold whole components, taken
    in order of (order, item): one stands if neither its order nor its item has
    been served."""
    def settle(batches):  # defined here, so that it travels to the executors by value
        orders, items = set(), set()
        for b in batches:
            stands = []
            for order, item in zip(b["order_id"].tolist(), b["item_id"].tolist(), strict=True):
                free = order not in orders and item not in items
                if free:
                    orders.add(order)
                    items.add(item)
                stands.append(free)
            yield b.loc[stands, ["order_id", "item_id"]]

    return (claims.sortWithinPartitions("order_id", "item_id").select("order_id", "item_id")
            .mapInPandas(settle, "order_id bigint, item_id bigint"))


def _without(claims: DataFrame, won: DataFrame) -> DataFrame:
    """Claims whose order and item are both unserved."""
    return (claims.join(won.select("order_id"), "order_id", "left_anti")
            .join(won.select("item_id"), "item_id", "left_anti"))


def standing_claims(claims: DataFrame, in_task: int = CLAIMS_IN_TASK) -> DataFrame:
    """Distinct claims (order_id, item_id) that stand when taken one after the
    other, order and item serving once.

    Claims hang together only through shared orders and items, so each
    component of that graph can be settled by itself: components of up to
    ``in_task`` claims go whole to one task each (so do all claims, if they
    are no more than that). A larger one first loses, by partial aggregates,
    the claims that are the first of both their order and their item, with all
    that these shut out; that takes apart what hangs together by a hot item or
    order. Then its first claims, about ``in_task`` of them, are settled in a
    task: they depend on nothing behind them. What is left is labelled anew."""
    left = written(claims.select("order_id", "item_id").distinct(), "claims")
    n = left.count()
    if n <= in_task:
        return written(_settled(left.coalesce(1)), "standing")
    won = None
    while n:
        # orders and items as nodes of one graph
        label = components(left.select((F.col("order_id") * 2).alias("a"), (F.col("item_id") * 2 + 1).alias("b")))
        own = written(left.join(label.select((F.col("node") / 2).cast("bigint").alias("order_id"), "label")
                                .filter(F.col("node") % 2 == 0), "order_id"), "labelled")
        sizes = own.groupBy("label").count()
        small = own.join(sizes.filter(F.col("count") <= in_task).select("label"), "label", "left_semi")
        found = [_settled(small.repartition("label"))]
        large = written(own.join(sizes.filter(F.col("count") > in_task).select("label"), "label", "left_semi")
                        .select("label", "order_id", "item_id"), "large")
        n = large.count()
        if n:
            by_order = large.groupBy("order_id").agg(F.min("item_id").alias("item_id"))
            by_item = large.groupBy("item_id").agg(F.min("order_id").alias("order_id"))
            firsts = written(by_order.join(by_item, ["order_id", "item_id"]), "firsts")
            rest = written(_without(large, firsts).repartition("order_id", "item_id"), "rest")
            share = F.least(F.lit(1.0), F.lit(float(in_task)) / F.count(F.lit(1)))
            counts = rest.groupBy("label").agg(share.alias("share"))
            cut = (rest.join(counts, "label").groupBy("label", "share")
                   .agg(F.percentile_approx("order_id", F.array([F.lit(i / 256) for i in range(1, 257)]), 20_000).alias("q"))
                   .select("label", F.element_at("q", F.greatest(F.lit(1), F.floor(F.col("share") * 256).cast("int"))).alias("cut")))
            head = rest.join(cut, "label").filter(F.col("order_id") <= F.col("cut")).drop("cut")
            held = head.groupBy("label").count().filter(F.col("count") <= 4 * in_task)  # else one order has most of them
            head = written(_settled(head.join(held.select("label"), "label", "left_semi").repartition("label")), "heads")
            found += [firsts.select("order_id", "item_id"), head]
            left = written(_without(rest, head).select("order_id", "item_id").repartition("order_id", "item_id"), "claims")
            n = left.count()
        step = written(union_all(found), "standing")
        won = step if won is None else won.unionByName(step)
    return won


def backorder_assign(c: Catalog, assignments: DataFrame, in_task: int = CLAIMS_IN_TASK) -> DataFrame:
    """Apply (order, item) assignments, as if one after the other by
    (order_id, item_id). Reasons in the reference's order: unknown order, not
    a backorder, already fulfilled (a cancelled one passes, Q19; so is an
    order that an earlier claim served), item missing, unknown item, item
    reserved or sold (``item_taken`` when by an earlier claim). Claims that
    could all stand alone are settled by ``standing_claims``."""
    o = c.sales_order.select(F.col("id").alias("o_id"), "is_backorder", F.col("status").alias("o_status"))
    i = c.item.select(F.col("id").alias("i_id"), F.col("status").alias("i_status"))
    a = (assignments.join(o, assignments.order_id == o.o_id, "left")
         .join(i, assignments.item_id == i.i_id, "left"))
    reason = first_reason(
        (F.col("o_id").isNull(), "order_not_found"),
        (F.coalesce(F.col("is_backorder"), F.lit(0)) != 1, "not_backorder"),
        (F.col("o_status") == "fulfilled", "already_fulfilled"),
        (missing("item_id"), "item_required"),
        (F.col("i_id").isNull(), "item_not_found"),
        (F.col("i_status").isin("reserved", "sold"), "item_unavailable"))
    # Spread the claims by their own key: the joins above may leave them
    # partitioned by item, which the per-item aggregates would reuse.
    a = written(a.withColumn("reason", reason).select("order_id", "item_id", "reason").repartition("order_id", "item_id"),
                "reasons")
    rejected = a.filter(F.col("reason").isNotNull()).select("order_id", "item_id", F.col("reason").alias("outcome"))
    valid = a.filter(F.col("reason").isNull()).select("order_id", "item_id").distinct()
    won = standing_claims(valid, in_task)
    served = won.select(F.col("order_id").alias("s_order"), F.col("item_id").alias("s_item"))
    out = valid.join(served, valid.order_id == served.s_order, "left")
    outcome = (F.when(F.col("s_item") == F.col("item_id"), "assigned")
               .when(F.col("s_item") < F.col("item_id"), "already_fulfilled").otherwise("item_taken"))
    out = rejected.unionByName(out.select("order_id", "item_id", outcome.alias("outcome")))
    hit = F.col("outcome") == "assigned"
    return out.select("order_id", "item_id", "outcome", F.when(hit, "fulfilled").alias("order_status"),
                      F.when(hit, "reserved").alias("item_status"))


# ---------------------------------------------------------------- shipments

def installment_rows(batch: DataFrame, date_received: DataFrame) -> DataFrame:
    """Instalment rows of new shipments. Paid when the raw JSON value is
    ``true``, ``1`` or the string ``"true"``, exactly (a string ``"1"``
    keeps its quotes and is not); paid date defaults to the shipment's
    receipt date when paid."""
    d = date_received.select(F.col("id").alias("d_id"), "date_received")
    s = batch.join(d, batch.shipment_id == d.d_id, "left")
    paid = F.coalesce(F.col("is_paid_raw").isin("true", "1", '"true"'), F.lit(False))
    return s.select("shipment_id", "inst_key", money("amount").alias("amount"), "due_date",
                    paid.cast("int").alias("is_paid"),
                    F.coalesce(F.col("paid_date"), F.when(paid, F.col("date_received"))).alias("paid_date"))


def installment_expand(shipments: DataFrame, date_received: DataFrame) -> DataFrame:
    """Shipment payloads with nested ``installments`` to rows."""
    flat = shipments.select("shipment_id", F.inline("installments"))
    return installment_rows(flat, date_received)


def shipment_form_payloads(forms: DataFrame) -> DataFrame:
    """The new-shipment form: an initial payment > 0 becomes the payload's
    only instalment, paid, due and paid on the receipt date; otherwise the
    payload has no instalments."""
    inst = F.struct(F.lit(None).cast("bigint").alias("inst_key"), F.col("initial_payment").alias("amount"),
                    F.col("date_received").alias("due_date"), F.lit("true").alias("is_paid_raw"),
                    F.col("date_received").alias("paid_date"))
    empty = F.array().cast(T_INSTALLMENTS)
    return forms.select("shipment_id", F.when(F.col("initial_payment") > 0, F.array(inst)).otherwise(empty)
                        .alias("installments"))


T_INSTALLMENTS = ("array<struct<inst_key:bigint,amount:decimal(18,2),due_date:date,is_paid_raw:string,"
                  "paid_date:date>>")


def installment_mark_paid(c: Catalog, marks: DataFrame, as_of) -> DataFrame:
    """Apply paid/unpaid marks in the order (seq, is_paid, paid_date): the
    flag is required and the instalment must belong to the given shipment;
    a mark that fails is rejected and leaves earlier ones in force. Paid date
    defaults to ``as_of`` and is cleared on reversal. The last mark that
    holds wins (``max_by``, a partial aggregate)."""
    si = c.shipment_installment
    own = si.select(F.col("id").alias("s_id"), F.col("shipment_id").alias("s_shipment"))
    seq = F.col("seq") if "seq" in marks.columns else F.lit(0)
    held = (marks.filter(F.col("is_paid").isNotNull())
            .join(own, (marks.id == own.s_id) & (marks.shipment_id == own.s_shipment)))
    last = held.groupBy(F.col("id").alias("m_id")).agg(
        F.max_by(F.struct("is_paid", "paid_date"), F.struct(seq, "is_paid", "paid_date")).alias("m"))
    j = si.join(last, si.id == last.m_id, "left")
    hit = F.col("m_id").isNotNull()
    new_paid = F.when(F.col("m.is_paid") != 0, 1).otherwise(0)
    paid_date = F.when(new_paid == 1, F.coalesce(F.col("m.paid_date"), F.lit(as_of)))
    return j.select("id", "shipment_id", "amount", "due_date",
                    F.when(hit, new_paid).otherwise(F.col("is_paid")).alias("is_paid"),
                    F.when(hit, paid_date).otherwise(F.col("paid_date")).alias("paid_date"))


def payment_status_of(shipments: DataFrame, installments: DataFrame) -> DataFrame:
    """Payment status and paid amount of shipments over a given instalment state."""
    paid = (installments.filter(F.col("is_paid") == 1).groupBy(F.col("shipment_id").alias("p_sid"))
            .agg(F.sum("amount").alias("paid")))
    j = shipments.join(paid, shipments.id == paid.p_sid, "left")
    p = zero_if_null("paid")
    st = F.when(p >= F.col("declared_value"), "settled").when(p > 0, "partial").otherwise("unpaid")
    return j.select("id", st.alias("payment_status"), money(p).alias("amount_paid"))


# ---------------------------------------------------------------- people

def work_log_earnings(c: Catalog, batch: DataFrame) -> DataFrame:
    """Earned = round(rate x quantity) (Q1) for entries of known people."""
    p = c.person.select(F.col("id").alias("p_id"), "rate")
    j = batch.join(p, batch.person_id == p.p_id)
    return j.select("id", "person_id", "quantity", money("rate").alias("rate"),
                    money(F.col("rate") * F.coalesce(F.col("quantity"), F.lit(0))).alias("amount_earned"))


def trip_work_log(c: Catalog, transfers: DataFrame | None = None) -> DataFrame:
    """One ``trip`` row per transfer with a transporter: quantity 1, earning
    exactly the person's rate, 0 if the person is unknown (Q22)."""
    t = (c.item_transfer if transfers is None else transfers).filter(~missing("transporter_id"))
    p = c.person.select(F.col("id").alias("p_id"), "rate")
    j = t.join(p, t.transporter_id == p.p_id, "left")
    return j.select(F.col("id").alias("transfer_id"), F.col("transporter_id").alias("person_id"),
                    F.col("to_location_id").alias("location_id"), F.col("transfer_date").alias("log_date"),
                    F.lit("trip").alias("log_type"), F.lit(1).alias("quantity"),
                    money(zero_if_null("rate")).alias("amount_earned"))


# ---------------------------------------------------------------- items

def transfer_apply(c: Catalog, transfers: DataFrame) -> DataFrame:
    """New location and status of every item after a batch of transfers, as
    if one came after the other by (date, id): each is checked against the
    place where the ones before it left the item (``transfers_in_turn``). The
    last accepted one decides the place and forces ``in_storage`` (Q21)."""
    # spread by transfer id so the per-item step does not inherit an item layout
    ok = transfers_in_turn(c, transfers).filter(F.col("reason").isNull()).repartition("id")
    last = ok.groupBy(F.col("item_id").alias("t_item")).agg(
        F.max_by(F.struct("to_location_id", "id"), F.struct("transfer_date", "id", "to_location_id")).alias("t"))
    it = c.item
    j = it.join(last, it.id == last.t_item, "left")
    moved = F.col("t_item").isNotNull()
    return j.select("id", F.when(moved, F.col("t.to_location_id")).otherwise(F.col("location_id")).alias("location_id"),
                    F.when(moved, "in_storage").otherwise(F.col("status")).alias("status"),
                    F.col("t.id").alias("last_transfer_id"))


def patch_map(patches: DataFrame, key: str, fields: list[str], seq: str | None = None) -> DataFrame:
    """Fixture adapter: ``has_<f>`` flags + values to ``map<string,string>``
    (a key present with a NULL value sets the column to NULL)."""
    entries = [F.when(F.col(f"has_{f}"), F.struct(F.lit(f).alias("k"), F.col(f).cast("string").alias("v")))
               for f in fields]
    extra = [F.struct(F.lit(n).alias("k"), F.col(n).cast("string").alias("v"))
             for n in patches.columns if n not in fields and n not in (key, seq) and not n.startswith("has_")]
    arr = F.filter(F.array(*entries, *extra), lambda x: x.isNotNull())
    return patches.select(F.col(key).alias("patch_id"), F.map_from_entries(arr).alias("patch"),
                          *([F.col(seq)] if seq else []))


def apply_patch(table: DataFrame, patches: DataFrame, allowed: list[str], key: str = "id",
                seq: str | None = None, convert: dict | None = None, derived: dict | None = None) -> DataFrame:
    """Apply ``map<string,string>`` patches: only whitelisted columns and only
    keys present in a patch change; values are cast to the column type
    (``try_cast``: a bad value becomes NULL instead of failing the job) or
    read by the column's function in ``convert``. A column of ``derived`` is
    computed anew (its function gives the expression over the patched
    columns) for rows that a patch changes.
    Patches of one id apply in turn: per (id, column) the last by ``seq``
    holds. Without ``seq``, patches of one id count as one moment and the
    greatest value of a column holds."""
    convert, derived = convert or {}, derived or {}
    order = F.col(seq) if seq else F.lit(0)
    each = patches.select("patch_id", order.alias("seq"), F.explode("patch").alias("k", "v"))
    merged = (each.filter(F.col("k").isin(*allowed)).groupBy("patch_id", "k")
              .agg(F.max_by(F.struct("v"), F.struct("seq", "v")).alias("last"))
              .groupBy("patch_id").agg(F.map_from_entries(F.collect_list(F.struct("k", F.col("last.v")))).alias("patch")))
    j = table.join(merged, table[key] == merged.patch_id, "left")  # a map has at most len(allowed) entries
    types = dict(table.dtypes)
    cols = []
    for col in table.columns:
        if col in allowed and col != key:
            v = F.col("patch")[col]
            newv = convert[col](v) if col in convert else v.try_cast(types[col]) if types[col] != "string" else v
            cols.append(F.when(F.coalesce(F.map_contains_key("patch", F.lit(col)), F.lit(False)), newv)
                        .otherwise(F.col(col)).alias(col))
        else:
            cols.append(F.col(col))
    if not derived:
        return j.select(*cols)
    changed = F.col("patch_id").isNotNull()
    return j.select(*cols, "patch_id").select(*[
        F.when(changed, derived[col]().cast(types[col])).otherwise(F.col(col)).alias(col) if col in derived else F.col(col)
        for col in table.columns])


def truthy(raw):
    """1 for a raw JSON value that JavaScript takes as true, else 0: false are
    null, ``false``, every form of the number 0 and the empty string (a text
    keeps its quotes: ``"0"`` and ``"false"`` are true)."""
    return F.when(raw.isNull() | raw.isin("false", "null", '""', "") | F.coalesce(raw.try_cast("double") == 0, F.lit(False)),
                  0).otherwise(1)


def replace_children(children: DataFrame, replacements: DataFrame, parent: str, value: str) -> DataFrame:
    """Replace a child collection per parent: parents named in the batch lose
    all their children (``left_anti``) and get the new values, texts
    trimmed, blanks and NULLs dropped. A parent named with nothing but NULLs
    or blanks (an empty list) keeps none. Other parents keep theirs."""
    parents = replacements.select(F.col(parent).alias("r_parent"))  # anti join: no distinct needed
    kept = (children.join(parents, children[parent] == parents.r_parent, "left_anti")
            .select(parent, "id", value, F.lit("kept").alias("origin")))
    if dict(replacements.dtypes)[value] == "string":
        replacements = replacements.withColumn(value, F.nullif(F.trim(F.col(value)), F.lit("")))
    new = (replacements.filter(F.col(value).isNotNull())
           .select(parent, F.lit(None).cast("bigint").alias("id"), value, F.lit("new").alias("origin")))
    return kept.unionByName(new)


def apply_deletes(table: DataFrame, ids: DataFrame, guard=None) -> DataFrame:
    """Outcome per requested id: ``invalid`` (<= 0, Q30), ``not_found``,
    ``blocked`` by the guard, or ``deleted``."""
    req = ids.select(F.col("id").alias("req_id")).distinct()
    t = table.select(F.col("id").alias("t_id"), (guard if guard is not None else F.lit(False)).alias("blocked"))
    j = req.join(t, req.req_id == t.t_id, "left")
    outcome = (F.when(F.coalesce(F.col("req_id"), F.lit(0)) <= 0, "invalid")
               .when(F.col("t_id").isNull(), "not_found")
               .when(F.col("blocked"), "blocked").otherwise("deleted"))
    return j.select(F.col("req_id").alias("id"), outcome.alias("outcome"))


def surviving_rows(table: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The table without the rows whose delete outcome is ``deleted``."""
    gone = outcomes.filter(F.col("outcome") == "deleted").select(F.col("id").alias("g_id"))
    return table.join(gone, table.id == gone.g_id, "left_anti")


def entity_lookup(table: DataFrame, ids: DataFrame, cols: list[str]) -> DataFrame:
    """Batch get-by-id: the record or a ``not_found``/``invalid`` flag."""
    req = ids.select(F.col("id").alias("req_id")).distinct()
    t = table.select(F.col("id").alias("t_id"), *cols)
    j = req.join(t, req.req_id == t.t_id, "left")
    flag = (F.when(F.coalesce(F.col("req_id"), F.lit(0)) <= 0, "invalid")
            .when(F.col("t_id").isNull(), "not_found").otherwise("found"))
    return j.select(F.col("req_id").alias("id"), flag.alias("lookup"), *cols)

