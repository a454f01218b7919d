"""Request validation as batch jobs, plus enum and foreign-key audits
(SURVEY 2.7). Each validator splits a batch into accepted and rejected with
the first failing reason in the reference's order: existence checks are
left joins to the key columns, the reason is an ordered ``when`` chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.fixed import CUSTOMER_PHONE, ENUMS, FOREIGN_KEYS, SUPPLIER_PHONE, SUPPLIER_STATUS
from ledgerloom.functions import blank, first_reason, missing, missing_text, union_all
from ledgerloom.functions.running import last_before
from ledgerloom.sources.catalog import Catalog


def _keys(df: DataFrame, alias: str, extra: tuple[str, ...] = ()) -> DataFrame:
    return df.select(F.col("id").alias(alias), *[F.col(e).alias(f"{alias}_{e}") for e in extra])


def _result(df: DataFrame, reason, kind: str | None = None, extra=()) -> DataFrame:
    cols = ([F.lit(kind).alias("kind")] if kind else []) + [
        "id", reason.isNull().alias("accepted"), reason.alias("reason"), *extra]
    return df.select(*cols)


def validate_orders(c: Catalog, batch: DataFrame | None = None) -> DataFrame:
    """New orders: required fields, known customer, location and item, backorder
    text, item free. An accepted order takes its item, so among orders of
    the batch that want one item the lowest id gets it (``min`` per item, a
    partial aggregate; joined back on the order, a key without hot values)."""
    b = c.order_batch if batch is None else batch
    b = (b.join(_keys(c.erp_customer, "cu"), b.customer_id == F.col("cu"), "left")
         .join(_keys(c.location, "lo"), b.location_id == F.col("lo"), "left")
         .join(_keys(c.item, "it", ("status",)), b.item_id == F.col("it"), "left"))
    reason = first_reason(
        (missing("customer_id"), "customer_id_required"),
        (missing("location_id"), "location_id_required"),
        (F.col("agreed_price").isNull(), "agreed_price_required"),
        (F.col("cu").isNull(), "customer_not_found"),
        (F.col("lo").isNull(), "location_not_found"),
        ((F.col("is_backorder") == 1) & blank("backorder_description"), "backorder_description_required"),
        (~missing("item_id") & F.col("it").isNull(), "item_not_found"),
        (~missing("item_id") & F.col("it_status").isin("reserved", "sold"), "item_unavailable"))
    b = b.withColumn("reason", reason).repartition("id")
    claims = ~missing("item_id") & F.col("reason").isNull()
    first = b.filter(claims).groupBy(F.col("item_id").alias("w_item")).agg(F.min("id").alias("w_id"))
    b = b.join(first, (b.id == first.w_id) & (b.item_id == first.w_item), "left")
    return _result(b, F.when(claims & F.col("w_id").isNull(), "item_unavailable").otherwise(F.col("reason")))


def validate_payments(c: Catalog) -> DataFrame:
    """Order payments: parent order, amount, date. Staff payments: parent
    person, amount, date, method. The parent lookup comes first (404)."""
    op_ = c.payment_batch
    op_ = op_.join(_keys(c.sales_order, "o"), op_.order_id == F.col("o"), "left")
    r1 = first_reason((F.col("o").isNull(), "order_not_found"), (missing("amount"), "amount_required"),
                      (F.col("payment_date").isNull(), "payment_date_required"))
    sp = c.staff_payment_batch
    sp = sp.join(_keys(c.person, "p"), sp.person_id == F.col("p"), "left")
    r2 = first_reason((F.col("p").isNull(), "person_not_found"), (missing("amount"), "amount_required"),
                      (F.col("payment_date").isNull(), "payment_date_required"),
                      (missing_text("method"), "method_required"))
    return _result(op_, r1, "order").unionByName(_result(sp, r2, "staff"))


def validate_shipments(c: Catalog) -> DataFrame:
    """Shipments: supplier, receipt date, declared value, known supplier.
    Instalments added to a shipment: known shipment, amount, due date."""
    s = c.shipment_batch
    s = s.join(_keys(c.erp_supplier, "su"), s.supplier_id == F.col("su"), "left")
    r1 = first_reason((missing("supplier_id"), "supplier_id_required"),
                      (F.col("date_received").isNull(), "date_received_required"),
                      (F.col("declared_value").isNull(), "declared_value_required"),
                      (F.col("su").isNull(), "supplier_not_found"))
    i = c.installment_batch.withColumnRenamed("inst_key", "id")
    i = i.join(_keys(c.shipment, "sh"), i.shipment_id == F.col("sh"), "left")
    r2 = first_reason((F.col("sh").isNull(), "shipment_not_found"), (missing("amount"), "amount_required"),
                      (F.col("due_date").isNull(), "due_date_required"))
    return _result(s, r1, "shipment").unionByName(_result(i, r2, "installment"))


def validate_items(c: Catalog) -> DataFrame:
    """Items: name, location, purchase value; known location and (if given)
    shipment. Bulk stock rows: name only."""
    b = c.item_batch
    b = (b.join(_keys(c.location, "lo"), b.location_id == F.col("lo"), "left")
         .join(_keys(c.shipment, "sh"), b.shipment_id == F.col("sh"), "left"))
    r1 = first_reason((missing_text("name"), "name_required"), (missing("location_id"), "location_id_required"),
                      (F.col("purchase_value").isNull(), "purchase_value_required"),
                      (F.col("lo").isNull(), "location_not_found"),
                      (~missing("shipment_id") & F.col("sh").isNull(), "shipment_not_found"))
    inv = c.inventory
    r2 = first_reason((missing_text("name"), "name_required"))
    return _result(b, r1, "item").unionByName(_result(inv, r2, "bulk"))


def transfers_in_turn(c: Catalog, transfers: DataFrame) -> DataFrame:
    """The transfers with the place their item is at when their turn comes
    (by date, id) and the reason why they are refused, if any. A transfer
    that is refused changes nothing, one to the same place neither, so the
    place is the last destination of those before that could stand: a scan
    over the ordered events, safe for an item with most of them."""
    t = (transfers.join(_keys(c.item, "it", ("status", "location_id")), transfers.item_id == F.col("it"), "left")
         .join(_keys(c.location, "lo"), transfers.to_location_id == F.col("lo"), "left"))
    could = first_reason(
        (F.col("it").isNull(), "item_not_found"),
        (F.col("it_status") == "sold", "item_sold"),
        (missing("to_location_id"), "to_location_id_required"),
        (F.col("transfer_date").isNull(), "transfer_date_required"))
    t = t.withColumn("_reason", could).withColumn(
        "_place", F.when(F.col("_reason").isNull() & F.col("lo").isNotNull(), F.col("to_location_id")))
    t = last_before(t, "item_id", ["transfer_date", "id", "to_location_id"], "_place", "_before")
    at = F.coalesce("_before", "it_location_id")
    reason = F.coalesce("_reason", first_reason((F.col("to_location_id") == at, "same_location"),
                                                (F.col("lo").isNull(), "location_not_found")))
    return t.select(*transfers.columns, at.alias("place_before"), reason.alias("reason"))


def validate_transfers(c: Catalog) -> DataFrame:
    """Transfers in turn: known unsold item, destination and date given, a
    known place other than the one the item is at by then."""
    return _result(transfers_in_turn(c, c.transfer_batch), F.col("reason"))


def validate_people(c: Catalog) -> DataFrame:
    """People: required fields, at least one location, temporary staff need a contract start."""
    p = c.people_batch
    reason = first_reason(
        (missing_text("name"), "name_required"), (missing_text("role"), "role_required"),
        (missing_text("employment_type"), "employment_type_required"),
        (missing_text("payment_type"), "payment_type_required"),
        (F.col("rate").isNull(), "rate_required"),
        (F.coalesce(F.col("n_locations"), F.lit(0)) == 0, "location_ids_required"),
        ((F.col("employment_type") == "temporary") & F.col("contract_start").isNull(), "contract_start_required"))
    return _result(p, reason)


def validate_work_logs(c: Catalog) -> DataFrame:
    """Work log entries: known person, then date, type, location and quantity."""
    w = c.work_batch
    w = w.join(_keys(c.person, "p"), w.person_id == F.col("p"), "left")
    reason = first_reason(
        (F.col("p").isNull(), "person_not_found"), (F.col("log_date").isNull(), "log_date_required"),
        (missing_text("log_type"), "log_type_required"), (missing("location_id"), "location_id_required"),
        (F.col("quantity").isNull(), "quantity_required"))
    return _result(w, reason)


def validate_expenses(c: Catalog) -> DataFrame:
    """Expenses: description, amount, date and category; reimbursement flag from the payer."""
    e = c.expense_batch
    reason = first_reason(
        (missing_text("description"), "description_required"), (F.col("amount").isNull(), "amount_required"),
        (F.col("expense_date").isNull(), "expense_date_required"), (missing_text("category"), "category_required"))
    return _result(e, reason, extra=[(~missing("paid_by_person_id")).cast("int").alias("is_reimbursement")])


def validate_contacts(c: Catalog) -> DataFrame:
    """Contact forms. Supplier: name 3-100 characters, phone pattern, address
    <= 200 and notes <= 500 (when the table has them), status enum.
    Customer: name, phone pattern."""
    s = c.erp_supplier
    n = F.length(F.coalesce(F.col("name"), F.lit("")))
    checks = [(missing_text("name"), "name_required"), ((n < 3) | (n > 100), "name_length"),
              (missing_text("phone"), "phone_required"), (~F.col("phone").rlike(SUPPLIER_PHONE), "phone_format")]
    for col, limit in (("address", 200), ("notes", 500)):
        if col in s.columns:
            checks.append((F.length(F.coalesce(F.col(col), F.lit(""))) > limit, f"{col}_length"))
    checks.append((~F.coalesce(F.col("status"), F.lit("active")).isin(*SUPPLIER_STATUS), "status_invalid"))
    r1 = first_reason(*checks)
    cu = c.erp_customer
    r2 = first_reason(
        (missing_text("name"), "name_required"), (missing_text("phone"), "phone_required"),
        (~F.col("phone").rlike(CUSTOMER_PHONE), "phone_format"))
    return _result(s, r1, "supplier").unionByName(_result(cu, r2, "customer"))


def enum_audit(c: Catalog) -> DataFrame:
    """Rows breaking an enum constraint, counted per table and column
    (NULLs pass a CHECK, as in SQL). One scan per table: every checked
    column of that table is a conditional count in the same aggregate,
    then the counts are unpivoted to rows."""
    by_table: dict[str, list] = {}
    for t, col, allowed in ENUMS:
        by_table.setdefault(t, []).append((col, allowed))
    parts = []
    for t, cols in by_table.items():
        counts = [F.count_if(F.col(col).isNotNull() & ~F.col(col).isin(*allowed)).alias(f"bad_{i}")
                  for i, (col, allowed) in enumerate(cols)]
        rows = F.array(*[F.struct(F.lit(col).alias("column_name"), F.col(f"bad_{i}").alias("bad_rows"))
                         for i, (col, _) in enumerate(cols)])
        parts.append(c[t].agg(*counts).select(F.lit(t).alias("table_name"), F.inline(rows)))
    return union_all(parts)


def fk_audit(c: Catalog) -> DataFrame:
    """Orphans per foreign key, with one scan per child table and one join.

    Each child table is read once and unpivoted into (fk, key) references;
    references are pre-aggregated to (fk, key) -> multiplicity (map-side
    partial aggregation, so a key used by a third of all rows becomes one
    row per task, then one row), anti-joined against the distinct parent
    keys (both sides unique per key: no skew), and the multiplicities of
    orphan keys are summed. FKs without orphans report 0."""
    by_child: dict[str, list] = {}
    for i, (t, col, ref) in enumerate(FOREIGN_KEYS):
        by_child.setdefault(t, []).append((i, col, ref))
    refs = []
    for t, fks in by_child.items():
        arr = F.array(*[F.struct(F.lit(i).alias("fk"), F.lit(ref).alias("ref"), F.col(col).cast("bigint").alias("key"))
                        for i, col, ref in fks])
        refs.append(c[t].select(F.inline(arr)))
    keyed = (union_all(refs).filter(F.col("key").isNotNull())
             .groupBy("fk", "ref", "key").agg(F.count(F.lit(1)).alias("n")))
    parents = union_all([c[r].select(F.lit(r).alias("p_ref"), F.col("id").cast("bigint").alias("p_key"))
                         for r in dict.fromkeys(ref for _, _, ref in FOREIGN_KEYS)])
    # no distinct(): duplicate parent keys cannot change an anti join's result
    # left join + "no match" filter rather than left_anti: the optimizer may
    # push a semi/anti join below the aggregate and into every union branch
    # (copying the parents into each); an outer join stays one join
    orphans = (keyed.join(parents, (keyed.ref == parents.p_ref) & (keyed.key == parents.p_key), "left")
               .filter(F.col("p_key").isNull())
               .groupBy("fk").agg(F.sum("n").alias("orphans")))
    fks = c.spark.createDataFrame([(i, t, col, ref) for i, (t, col, ref) in enumerate(FOREIGN_KEYS)],
                                  "fk int, table_name string, column_name string, ref_table string")
    return (fks.join(orphans, "fk", "left")
            .select("table_name", "column_name", "ref_table",
                    F.coalesce("orphans", F.lit(0)).cast("bigint").alias("orphans")))


def parse_payloads(raw: DataFrame, schema: str = "k BIGINT") -> DataFrame:
    """JSON request bodies to columns: ``from_json`` in PERMISSIVE mode, so a
    malformed body yields NULL fields (the reference reads it as ``{}`` and
    then fails validation) and is flagged through the corrupt-record column."""
    full = f"{schema}, _corrupt STRING"
    parsed = raw.withColumn("p", F.from_json("body", full, {"mode": "PERMISSIVE",
                                                             "columnNameOfCorruptRecord": "_corrupt"}))
    fields = [f.strip().split()[0] for f in schema.split(",")]
    return parsed.select("id", *[F.col(f"p.{f}").alias(f) for f in fields],
                         (F.col("p._corrupt").isNotNull() | F.col("p").isNull()).alias("malformed"))
