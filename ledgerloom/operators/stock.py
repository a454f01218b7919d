"""Items, bulk inventory, locations and stock value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import like_contains, money, zero_if_null
from ledgerloom.sources.catalog import Catalog

ITEM_COLS = ("id", "name", "category", "status", "location_id", "location_name", "purchase_value",
             "sale_price", "shipment_id")


def _loc_names(c: Catalog, prefix: str = "") -> DataFrame:
    return c.location.select(F.col("id").alias(f"{prefix}l_id"), F.col("name").alias(f"{prefix}location_name"))


def _items_with_location(c: Catalog, items: DataFrame | None = None) -> DataFrame:
    i = c.item if items is None else items
    lo = _loc_names(c)
    return (i.join(lo, i.location_id == lo.l_id)
            .select(*[money(n).alias(n) if n in ("purchase_value", "sale_price") else F.col(n) for n in ITEM_COLS]))


def location_list(c: Catalog) -> DataFrame:
    """Locations ordered by id."""
    return c.location.select("id", "name", "type").orderBy("id")


def thumbnails(c: Catalog) -> DataFrame:
    """item_id -> url of its lowest-id image. ``min_by`` replaces the
    correlated ``ORDER BY id LIMIT 1``: a constant-size partial aggregate,
    so an item with millions of images costs no memory."""
    return c.item_image.groupBy("item_id").agg(F.min_by("url", "id").alias("thumbnail_url"))


def item_list(c: Catalog, location_id: int | None = None, status: str | None = None,
              category: str | None = None, search: str | None = None) -> DataFrame:
    """Items with location name and thumbnail; optional location, status, category and name filters."""
    i = c.item
    if location_id is not None:
        i = i.filter(F.col("location_id") == location_id)
    if status:
        i = i.filter(F.col("status") == status)
    if category:
        i = i.filter(F.col("category") == category)
    if search:
        i = i.filter(like_contains("name", search))
    df = _items_with_location(c, i)
    th = thumbnails(c)
    return (df.join(th, df.id == th.item_id, "left").drop("item_id").orderBy("id"))


def available_items(c: Catalog) -> DataFrame:
    """Items that can be sold or assigned to a backorder."""
    return item_list(c, status="in_storage")


def location_inventory(c: Catalog, location_id: int | None = None) -> DataFrame:
    """Items at a location (or at every location) with the location name."""
    i = c.item if location_id is None else c.item.filter(F.col("location_id") == location_id)
    return _items_with_location(c, i).orderBy("location_id", "id")


def shipment_manifest(c: Catalog, shipment_id: int | None = None) -> DataFrame:
    """Items of a shipment (or of every shipment) with the location name."""
    i = c.item.filter(F.col("shipment_id").isNotNull())
    if shipment_id is not None:
        i = i.filter(F.col("shipment_id") == shipment_id)
    return _items_with_location(c, i).orderBy("shipment_id", "id")


def inventory_list(c: Catalog, location_id: int | None = None, category: str | None = None,
                   search: str | None = None) -> DataFrame:
    """Bulk stock; location may be NULL (left join). Ordered by name."""
    inv = c.inventory
    if location_id is not None:
        inv = inv.filter(F.col("location_id") == location_id)
    if category:
        inv = inv.filter(F.col("category") == category)
    if search:
        inv = inv.filter(like_contains("name", search))
    lo = _loc_names(c)
    return (inv.join(lo, inv.location_id == lo.l_id, "left")
            .select("id", "name", "category", "location_id", "quantity", money("unit_price").alias("unit_price"),
                    money("total_value").alias("total_value"), "location_name")
            .orderBy("name", "id"))


def _stock_exact(c: Catalog, location_id: int | None = None) -> DataFrame:
    lo = c.location
    inv = c.inventory
    it = c.item.filter(F.col("status") != "sold")
    if location_id is not None:
        lo = lo.filter(F.col("id") == location_id)
        inv = inv.filter(F.col("location_id") == location_id)
        it = it.filter(F.col("location_id") == location_id)
    bulk = inv.groupBy(F.col("location_id").alias("b_loc")).agg(F.sum("total_value").alias("bulk"))
    prod = it.groupBy(F.col("location_id").alias("p_loc")).agg(F.sum("sale_price").alias("prod"))
    df = lo.join(bulk, lo.id == bulk.b_loc, "left").join(prod, lo.id == prod.p_loc, "left")
    return df.select("id", "name", zero_if_null("bulk").alias("bulk"), zero_if_null("prod").alias("prod"))


def stock_value(c: Catalog, location_id: int | None = None) -> DataFrame:
    """Per location: bulk value (inventory), unsold product value at sale
    price (Q13) and their sum. Both sides are aggregated per location first,
    so the join is location-sized."""
    df = _stock_exact(c, location_id)
    return df.select("id", "name", money("bulk").alias("bulk_value"), money("prod").alias("product_value"),
                     money(F.col("bulk") + F.col("prod")).alias("total_value"))


def stock_value_total(c: Catalog) -> DataFrame:
    """Grand total over locations (0 when there are none)."""
    df = _stock_exact(c)
    return df.agg(money(zero_if_null(F.sum(F.col("bulk") + F.col("prod")))).alias("total"))


def inventory_valuation(c: Catalog) -> DataFrame:
    """total_value = round(quantity x unit_price) (Q1)."""
    inv = c.inventory
    return inv.select("id", "quantity", money("unit_price").alias("unit_price"),
                      money(F.col("quantity") * F.col("unit_price")).alias("total_value"))


def item_detail(c: Catalog, item_id: int | None = None) -> DataFrame:
    """Items with their parts and images as child rows (kind 'part' or
    'image'; items without children keep one row with NULL kind). Flat, so
    an item with any number of children is spread over tasks; see
    :func:`item_detail_nested` for the API document of one item."""
    i = c.item if item_id is None else c.item.filter(F.col("id") == item_id)
    head = _items_with_location(c, i)
    parts = c.item_part.select(F.col("parent_item_id").alias("item_id"), F.lit("part").alias("child_kind"),
                               F.col("part_item_id").alias("child_id"), F.lit(None).cast("string").alias("child_url"))
    imgs = c.item_image.select("item_id", F.lit("image").alias("child_kind"), F.col("id").alias("child_id"),
                               F.col("url").alias("child_url"))
    kids = parts.unionByName(imgs)
    return head.join(kids, head.id == kids.item_id, "left").drop("item_id")


def item_detail_nested(c: Catalog, item_id: int) -> DataFrame:
    """Point lookup with ``part_ids[]`` and ``images[]`` (bounded by one item)."""
    flat = item_detail(c, item_id)
    return flat.groupBy(*ITEM_COLS).agg(
        F.array_sort(F.collect_list(F.when(F.col("child_kind") == "part", F.col("child_id")))).alias("part_ids"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("child_kind") == "image",
                                                       F.struct("child_id", "child_url")))),
                    lambda s: s["child_url"]).alias("images"))


def item_transfers(c: Catalog, item_id: int | None = None) -> DataFrame:
    """Transfers with both location names (two roles of one dimension)."""
    t = c.item_transfer if item_id is None else c.item_transfer.filter(F.col("item_id") == item_id)
    fl, tl = _loc_names(c, "from_"), _loc_names(c, "to_")
    return (t.join(fl, t.from_location_id == fl.from_l_id).join(tl, t.to_location_id == tl.to_l_id)
            .select("id", "item_id", "from_location_id", "to_location_id", "transfer_date",
                    money("transport_cost").alias("transport_cost"), "transporter_id",
                    "from_location_name", "to_location_name")
            .orderBy("item_id", F.col("transfer_date").desc(), "id"))


def deletable_items(c: Catalog) -> DataFrame:
    """Items whose delete guard passes: only ``sold`` blocks (Q29)."""
    return c.item.filter(F.col("status") != "sold").select("id", "name", "status")
