"""Registered stock queries (items, inventory, locations, stock value)."""

from ledgerloom.operators import stock as op
from ledgerloom.plans.oracle import M, Z
from ledgerloom.plans.params import GALLERY_ID, ITEM_SEARCH

ITEMS = (f"SELECT i.id, i.name, i.category, i.status, i.location_id, l.name AS location_name, "
         f"{M('i.purchase_value')} AS purchase_value, {M('i.sale_price')} AS sale_price, i.shipment_id "
         "FROM item i JOIN location l ON l.id = i.location_id")
THUMBS = "(SELECT item_id, arg_min(url, id) AS thumbnail_url FROM item_image GROUP BY item_id)"
ITEM_LIST = (f"SELECT x.*, th.thumbnail_url FROM ({ITEMS}) x LEFT JOIN {THUMBS} th ON th.item_id = x.id")
STOCK = """SELECT l.id, l.name, {bulk} AS bulk, {prod} AS prod FROM location l
LEFT JOIN (SELECT location_id, SUM(total_value) AS bulk FROM inventory GROUP BY location_id) b ON b.location_id = l.id
LEFT JOIN (SELECT location_id, SUM(sale_price) AS prod FROM item WHERE status != 'sold' GROUP BY location_id) p
ON p.location_id = l.id""".format(bulk=Z("b.bulk"), prod=Z("p.prod"))

ENTRIES = {
    "location_list": (lambda c: op.location_list(c), "SELECT id, name, type FROM location"),
    "item_list": (lambda c: op.item_list(c, search=ITEM_SEARCH),
                  ITEM_LIST + f" WHERE x.name ILIKE '%{ITEM_SEARCH}%'"),
    "item_list_all": (lambda c: op.item_list(c), ITEM_LIST),
    "item_list_filtered": (
        lambda c: op.item_list(c, location_id=GALLERY_ID, status="reserved"),
        ITEM_LIST + f" WHERE x.location_id = {GALLERY_ID} AND x.status = 'reserved'"),
    "inventory_list_location": (
        lambda c: op.inventory_list(c, location_id=GALLERY_ID),
        f"SELECT i.id, i.name, i.category, i.location_id, i.quantity, {M('i.unit_price')} AS unit_price, "
        f"{M('i.total_value')} AS total_value, l.name AS location_name FROM inventory i "
        f"LEFT JOIN location l ON l.id = i.location_id WHERE i.location_id = {GALLERY_ID}"),
    "available_items": (lambda c: op.available_items(c), ITEM_LIST + " WHERE x.status = 'in_storage'"),
    "location_inventory": (lambda c: op.location_inventory(c), ITEMS),
    "shipment_manifest": (lambda c: op.shipment_manifest(c), ITEMS + " WHERE i.shipment_id IS NOT NULL"),
    "inventory_list": (
        lambda c: op.inventory_list(c, search=ITEM_SEARCH),
        f"SELECT i.id, i.name, i.category, i.location_id, i.quantity, {M('i.unit_price')} AS unit_price, "
        f"{M('i.total_value')} AS total_value, l.name AS location_name FROM inventory i "
        f"LEFT JOIN location l ON l.id = i.location_id WHERE i.name ILIKE '%{ITEM_SEARCH}%'"),
    "stock_value": (
        lambda c: op.stock_value(c),
        f"SELECT id, name, {M('bulk')} AS bulk_value, {M('prod')} AS product_value, {M('bulk + prod')} AS total_value "
        f"FROM ({STOCK}) s"),
    "stock_value_total": (lambda c: op.stock_value_total(c),
                          f"SELECT {M(Z('SUM(bulk + prod)'))} AS total FROM ({STOCK}) s"),
    "inventory_valuation": (
        lambda c: op.inventory_valuation(c),
        f"SELECT id, quantity, {M('unit_price')} AS unit_price, {M('quantity * unit_price')} AS total_value FROM inventory"),
    "item_detail": (
        lambda c: op.item_detail(c),
        f"""SELECT x.*, k.child_kind, k.child_id, k.child_url FROM ({ITEMS}) x LEFT JOIN (
 SELECT parent_item_id AS item_id, 'part' AS child_kind, part_item_id AS child_id, CAST(NULL AS VARCHAR) AS child_url FROM item_part
 UNION ALL SELECT item_id, 'image', id, url FROM item_image) k ON k.item_id = x.id"""),
    "item_transfers": (
        lambda c: op.item_transfers(c),
        f"SELECT t.id, t.item_id, t.from_location_id, t.to_location_id, t.transfer_date, "
        f"{M('t.transport_cost')} AS transport_cost, t.transporter_id, fl.name AS from_location_name, "
        "tl.name AS to_location_name FROM item_transfer t JOIN location fl ON fl.id = t.from_location_id "
        "JOIN location tl ON tl.id = t.to_location_id"),
    "deletable_items": (lambda c: op.deletable_items(c), "SELECT id, name, status FROM item WHERE status != 'sold'"),
}
