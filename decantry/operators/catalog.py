"""Catalogue, prices and stock (O-C*): listings, stock depletion and change batches.

Change batches replace the reference's one-row admin writes: a frame of changes
``(catalog_id, seq, ...)`` is validated column-wise, resolved per key with
aggregates (``max_by`` / ``min``: map-side combinable, so a hot key is absorbed by
partial aggregation), and applied with one left join onto the snapshot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decantry.functions import exprs as X
from decantry.operators.orders import typed_items

PRICE_COLS = ["price_2ml", "price_3ml", "price_5ml", "price_10ml"]
JOURNEY_COLS = ["accords", "notes", "journey_theme", "journey_title", "journey_copy"]


# ---------------------------------------------------------------- O-C1 / C2 / C3 / C12 / C13
def public_catalog(catalog: DataFrame, collation: str | None = None) -> DataFrame:
    """All rows; deleted ones are emitted as hidden/inactive so clients can suppress them.
    ``collation`` orders names by a collation instead of binary order."""
    deleted = F.col("deleted_at").isNotNull()
    rank = (F.when(deleted, 3).when(F.col("availability_status") == "upcoming", 0)
            .when(F.col("availability_status") == "published", 1).otherwise(2))
    return (catalog.select(
        "id", "name", "brand",
        F.when(deleted, F.lit(False)).otherwise(F.col("active")).alias("active"),
        F.when(deleted, F.lit("hidden")).otherwise(F.col("availability_status")).alias("availability_status"),
        "display_order", *PRICE_COLS, "image_url", "description", *[c for c in JOURNEY_COLS if c in catalog.columns],
        rank.alias("sort_group"), "created_at")
        .orderBy("sort_group", "display_order", "created_at", X.text_key("name", collation)))


def sold_ml_by_name(orders: DataFrame, items: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Millilitres sold per trimmed perfume name over **delivered** orders.

    The correlated per-product subquery of the reference, decorrelated: one pass over
    delivered orders' items and a partial+final hash aggregate. Orders are reduced to
    their ids before the semi-join, and the status filter reaches the scan.

    With ``names`` (item_key -> name) the items carry only ``item_key``: they are summed
    per key *before* the name lookup (eager aggregation), so the big side is never
    joined or shuffled for the name; the key-level partial sums are then re-summed by
    name (several keys may share a trimmed name).
    """
    delivered = orders.filter(F.col("status") == "delivered").select(F.col("id").alias("order_id"))
    cols = ["order_id", "item_key" if names is not None else "name", "size", "qty"]
    its = typed_items(items.join(delivered, "order_id", "left_semi").select(*cols)).filter(~F.col("quarantine"))
    if names is None:
        return its.groupBy("perfume").agg(F.sum(F.col("ml") * F.col("qty_n")).alias("sold_ml_raw"))
    per_key = its.groupBy("item_key").agg(F.sum(F.col("ml") * F.col("qty_n")).alias("_k"))
    return (per_key.join(names, "item_key").groupBy(F.trim("name").alias("perfume"))
            .agg(F.sum("_k").alias("sold_ml_raw")))


def catalog_with_stock(catalog: DataFrame, orders: DataFrame, items: DataFrame,
                       names: DataFrame | None = None, collation: str | None = None) -> DataFrame:
    """Admin stock list: sold ml, available ml (clamped at 0, null when no stock set)."""
    sold = sold_ml_by_name(orders, items, names)
    live = catalog.filter(F.col("deleted_at").isNull())
    sold_ml = F.coalesce(F.col("sold_ml_raw"), F.lit(0))
    avail = F.when(F.col("stock_initial_ml").isNull(), F.lit(None)).otherwise(
        F.greatest(F.lit(0), F.col("stock_initial_ml") - sold_ml))
    return (live.join(sold, live.name == sold.perfume, "left")
            .select("id", "name", "brand", "active", "availability_status", "display_order",
                    *PRICE_COLS, "image_url", "stock_initial_ml", "low_stock_threshold_ml",
                    sold_ml.cast(X.OUT_ML).alias("sold_ml"),
                    avail.cast(X.OUT_ML).alias("stock_available_ml"),
                    X.catalog_rank_admin("availability_status").alias("sort_group"))
            .orderBy("sort_group", "display_order", X.text_key("name", collation)))


def backfill_status(catalog: DataFrame) -> DataFrame:
    """Null availability_status -> published when active, else hidden."""
    fill = F.when(F.col("active"), F.lit("published")).otherwise(F.lit("hidden"))
    return catalog.withColumn("availability_status", F.coalesce(F.col("availability_status"), fill))


def storefront(catalog: DataFrame, sort_by: str = "price", collation: str | None = None) -> DataFrame:
    """Public shop: hidden and deleted dropped, upcoming first (even when inactive).

    ``sort_by``: price (the 2 ml price **[choice]**), brand or name. Never filters on ``active``.
    """
    key = {"price": "price_2ml", "brand": "brand", "name": "name"}[sort_by]
    shown = catalog.filter((F.col("availability_status") != "hidden") & F.col("deleted_at").isNull())
    upcoming = (F.col("availability_status") == "upcoming")
    return (shown.select("id", "name", "brand", "availability_status", *PRICE_COLS, "image_url",
                         upcoming.alias("is_upcoming"))
            .orderBy(F.col("is_upcoming").desc(), X.text_key(key, collation if key != "price_2ml" else None)
                     .asc_nulls_last(), X.text_key("name", collation)))


def low_stock(stock: DataFrame) -> DataFrame:
    """Products whose available ml is at or below the threshold **[choice]**."""
    return stock.filter(F.col("stock_available_ml").isNotNull()
                        & (F.col("stock_available_ml") <= F.col("low_stock_threshold_ml")))


# ---------------------------------------------------------------- change batches
def _last_valid(changes: DataFrame, valid: F.Column, value: F.Column, key: str = "catalog_id") -> DataFrame:
    """Latest valid change value per key (by seq), as ``_v``; plus count of valid changes."""
    return (changes.filter(valid).groupBy(key)
            .agg(F.max_by(value, F.col("seq")).alias("_v"), F.count(F.lit(1)).alias("_n")))


def _rejects(changes: DataFrame, reason: F.Column) -> DataFrame:
    return changes.select("catalog_id", "seq", reason.alias("reject_reason")).filter(F.col("reject_reason").isNotNull())


def _live_ids(catalog: DataFrame) -> DataFrame:
    return catalog.select(F.col("id").alias("catalog_id"), F.col("deleted_at").isNull().alias("_live"))


def apply_price_changes(catalog: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All four prices required and > 0 (nulls tested first: ``least`` skips nulls), rounded to 2,
    only on live (not deleted) products. The last valid change per product wins."""
    ch = changes.join(_live_ids(catalog), "catalog_id", "left")
    cents = [F.round(X.amount(c), 2) for c in PRICE_COLS]   # what would be stored: 0.004 is no price
    any_null = F.lit(False)
    for c in PRICE_COLS:
        any_null = any_null | F.col(c).isNull()
    reason = (F.when(F.col("_live").isNull(), F.lit("not_found"))
              .when(~F.col("_live"), F.lit("deleted"))
              .when(any_null, F.lit("prices_incomplete"))
              .when(F.least(*cents) <= 0, F.lit("price_not_positive"))
              .when(F.greatest(*cents) >= 10 ** 8, F.lit("price_out_of_range")))
    rounded = F.struct(*[X.money_once(c).alias(c) for c in PRICE_COLS])
    last = _last_valid(ch, reason.isNull(), rounded)
    cat = catalog.join(last, catalog.id == last.catalog_id, "left")
    new = cat.select(*[F.coalesce(F.col(f"_v.{c}"), F.col(c)).alias(c) if c in PRICE_COLS else F.col(c)
                       for c in catalog.columns])
    return new, _rejects(ch, reason)


def apply_status_changes(catalog: DataFrame, status_changes: DataFrame,
                         price_changes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Normalise lower(trim()); must be one of 3; product live; publishing needs four prices,
    either in the snapshot or from a valid price change earlier in the same batch.

    The "earlier valid price change" test is a per-product ``min(seq)`` aggregate joined
    back (not a window), so one hot product never lands whole in one window task.
    """
    norm = F.lower(F.trim(F.coalesce(F.col("new_status"), F.lit(""))))
    snap = catalog.select(F.col("id").alias("catalog_id"), F.col("deleted_at").isNull().alias("_live"),
                          F.greatest(*[F.col(c).isNull() for c in PRICE_COLS]).alias("_missing"))
    ch = status_changes.withColumn("_norm", norm).join(snap, "catalog_id", "left")
    if price_changes is not None:
        _, prej = apply_price_changes(catalog, price_changes)
        valid_prices = price_changes.join(prej.select("catalog_id", "seq"), ["catalog_id", "seq"], "left_anti")
        first_price = valid_prices.groupBy("catalog_id").agg(F.min("seq").alias("_first_price_seq"))
        ch = ch.join(first_price, "catalog_id", "left")
    else:
        ch = ch.withColumn("_first_price_seq", F.lit(None).cast("bigint"))
    has_prices = ~F.col("_missing") | (F.col("_first_price_seq") < F.col("seq"))
    reason = (F.when(~F.col("_norm").isin(*X.CATALOG_STATUSES), F.lit("invalid_status"))
              .when(F.col("_live").isNull() | ~F.col("_live"), F.lit("not_found"))
              .when((F.col("_norm") == "published") & ~F.coalesce(has_prices, F.lit(False)), F.lit("prices_required")))
    last = _last_valid(ch, reason.isNull(), F.col("_norm"))
    cat = catalog.join(last, catalog.id == last.catalog_id, "left")
    status = F.coalesce(F.col("_v"), F.col("availability_status"))
    new = cat.select(*[status.alias(c) if c == "availability_status"
                       else F.when(F.col("_v").isNotNull(), F.col("_v") != "hidden").otherwise(F.col("active")).alias(c)
                       if c == "active" else F.col(c) for c in catalog.columns])
    return new, _rejects(ch, reason)


def apply_stock_counts(catalog: DataFrame, changes: DataFrame, orders: DataFrame,
                       items: DataFrame, names: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """User gives *available* ml; store initial = round(available + sold to date, 2) and the
    threshold (rounded). Negatives rejected. Deleted products are still counted (no test)."""
    sold = sold_ml_by_name(orders, items, names)
    names = catalog.select(F.col("id").alias("catalog_id"), "name")
    ch = changes.join(names, "catalog_id", "left")
    reason = (F.when(F.col("name").isNull(), F.lit("not_found"))
              .when((F.col("available_ml") < 0) | (F.col("threshold_ml") < 0)
                    | (F.col("available_ml") >= 10 ** 7) | (F.col("threshold_ml") >= 10 ** 8), F.lit("invalid_stock")))
    last = _last_valid(ch, reason.isNull(),
                       F.struct(X.amount("available_ml").alias("a"),
                                X.money_once("threshold_ml").alias("t")))
    cat = (catalog.join(last, catalog.id == last.catalog_id, "left")
           .join(sold, catalog.name == sold.perfume, "left"))
    initial = F.round(F.col("_v.a") + F.coalesce(F.col("sold_ml_raw"), F.lit(0)), 2).try_cast("decimal(10,2)")
    new = cat.select(*[F.when(F.col("_v").isNotNull(), initial).otherwise(F.col(c)).alias(c) if c == "stock_initial_ml"
                       else F.coalesce(F.col("_v.t"), F.col(c)).alias(c) if c == "low_stock_threshold_ml"
                       else F.col(c) for c in catalog.columns])
    return new, _rejects(ch, reason)


def soft_delete(catalog: DataFrame, deletes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mark deleted (deleted_at = change_ts, inactive, hidden); the first delete of a live
    product wins, the rest (and deletes of already-deleted or unknown ids) are rejected."""
    ch = deletes.join(_live_ids(catalog), "catalog_id", "left")
    first = (ch.filter(F.col("_live")).groupBy("catalog_id")
             .agg(F.min("seq").alias("_first"), F.min_by("change_ts", F.col("seq")).alias("_ts")))
    ch = ch.join(first, "catalog_id", "left")
    reason = (F.when(F.col("_live").isNull(), F.lit("not_found"))
              .when(~F.col("_live") | (F.col("seq") != F.col("_first")), F.lit("already_deleted")))
    cat = catalog.join(first, catalog.id == first.catalog_id, "left")
    hit = F.col("_first").isNotNull()
    new = cat.select(*[F.when(hit, F.col("_ts").cast("timestamp_ntz")).otherwise(F.col(c)).alias(c) if c == "deleted_at"
                       else F.when(hit, F.lit(False)).otherwise(F.col(c)).alias(c) if c == "active"
                       else F.when(hit, F.lit("hidden")).otherwise(F.col(c)).alias(c) if c == "availability_status"
                       else F.col(c) for c in catalog.columns])
    return new, _rejects(ch, reason)


def apply_image_changes(catalog: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blank url -> null; only live products; last change wins."""
    ch = changes.join(_live_ids(catalog), "catalog_id", "left")
    reason = F.when(F.col("_live").isNull() | ~F.col("_live"), F.lit("not_found"))
    last = _last_valid(ch, reason.isNull(), F.struct(X.blank_to_null("image_url").alias("u")))
    cat = catalog.join(last, catalog.id == last.catalog_id, "left")
    new = cat.select(*[F.when(F.col("_v").isNotNull(), F.col("_v.u")).otherwise(F.col(c)).alias(c) if c == "image_url"
                       else F.col(c) for c in catalog.columns])
    return new, _rejects(ch, reason)


def apply_active_flags(catalog: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sets only ``active`` (availability_status untouched, so the two may disagree).
    No deleted test in the reference: any existing product can be flagged."""
    ch = changes.join(_live_ids(catalog), "catalog_id", "left")
    reason = F.when(F.col("_live").isNull(), F.lit("not_found"))
    last = _last_valid(ch, reason.isNull(), F.col("active_flag"))
    cat = catalog.join(last, catalog.id == last.catalog_id, "left")
    new = cat.select(*[F.coalesce(F.col("_v"), F.col(c)).alias(c) if c == "active" else F.col(c)
                       for c in catalog.columns])
    return new, _rejects(ch, reason)


def create_products(catalog: DataFrame, requests: DataFrame) -> DataFrame:
    """Validate new-product requests; returns each request with ``reject_reason`` and the row
    that would be inserted. Rules: name/brand non-blank; status in 3 (default upcoming);
    published needs four positive prices; any given price must be > 0; the name must be new
    (deleted rows keep their name) and unique within the batch (the first valid request by seq
    wins). Prices are judged as they would be stored, rounded to two places."""
    status = F.lower(F.trim(F.coalesce(F.col("new_status"), F.lit("upcoming"))))
    name = F.trim("name")
    prices = [F.round(X.amount(c), 2) for c in PRICE_COLS]   # what would be stored
    any_null = F.greatest(*[p.isNull() for p in prices])
    existing = catalog.select(F.col("name").alias("_ename")).withColumn("_exists", F.lit(True))
    req = requests.withColumn("_tname", name).withColumn("_status", status)
    wrong = (F.when(X.is_blank("name") | X.is_blank("brand"), F.lit("name_brand_required"))
              .when(~F.col("_status").isin(*X.CATALOG_STATUSES), F.lit("invalid_status"))
              .when((F.col("_status") == "published") & (any_null | (F.least(*prices) <= 0)), F.lit("prices_required"))
              .when(F.least(*[F.coalesce(p, F.lit(1)) for p in prices]) <= 0, F.lit("price_not_positive"))
              .when(F.greatest(*[F.coalesce(p, F.lit(1)) for p in prices]) >= 10 ** 8, F.lit("price_out_of_range")))
    # A rejected request inserts nothing, so it does not take the name from a later valid one.
    req = req.withColumn("_wrong", wrong)
    first = req.filter(F.col("_wrong").isNull()).groupBy("_tname").agg(F.min("seq").alias("_first_seq"))
    req = req.join(first, "_tname", "left").join(existing, F.col("_tname") == F.col("_ename"), "left")
    reason = (F.when(F.col("_wrong").isNotNull(), F.col("_wrong"))
              .when(F.col("_exists") | (F.col("seq") != F.col("_first_seq")), F.lit("duplicate_name")))
    return req.select(
        "seq", F.col("_tname").alias("name"), F.trim("brand").alias("brand"),
        X.blank_to_null("image_url").alias("image_url"),
        *[X.money_once(c).alias(c) for c in PRICE_COLS],
        F.col("_status").alias("availability_status"),
        (F.col("_status") != "hidden").alias("active"),
        reason.alias("reject_reason"))


def seed_if_absent(snapshot: DataFrame, seed: DataFrame, keys: list[str]) -> DataFrame:
    """``insert ... on conflict do nothing``: seed rows whose key is absent, appended."""
    missing = seed.join(snapshot.select(*keys), keys, "left_anti")
    return snapshot.unionByName(missing, allowMissingColumns=True)


def seed_fill_blank(snapshot: DataFrame, seed: DataFrame, key: str, col: str) -> DataFrame:
    """Conditional seed: insert absent keys, and on conflict overwrite ``col`` only where the
    snapshot holds '' (``on conflict do update ... where col = ''``)."""
    s = seed.select(key, F.col(col).alias("_seed_val"))
    merged = snapshot.join(s, key, "left")
    updated = merged.select(*[F.when((F.col(c) == "") & F.col("_seed_val").isNotNull(), F.col("_seed_val"))
                              .otherwise(F.col(c)).alias(c) if c == col else F.col(c) for c in snapshot.columns])
    missing = seed.join(snapshot.select(key), key, "left_anti")
    return updated.unionByName(missing, allowMissingColumns=True)


def museum_rows_for_new_products(museum: DataFrame, created: DataFrame) -> DataFrame:
    """Every accepted new product upserts its museum work: new works start unpublished with an
    empty artwork and text; an existing work only gets the new brand. Later requests for the
    same name were rejected as duplicates, so there is one accepted row per name."""
    ok = created.filter(F.col("reject_reason").isNull()).select(F.col("name").alias("perfume_name"),
                                                                F.col("brand").alias("_brand"))
    merged = museum.join(ok, "perfume_name", "full")
    return merged.select(
        "perfume_name",
        F.coalesce(F.col("_brand"), F.col("brand")).alias("brand"),
        F.coalesce(F.col("artwork_path"), F.lit("")).alias("artwork_path"),
        F.coalesce(F.col("description"), F.lit("")).alias("description"),
        F.coalesce(F.col("published"), F.lit(False)).alias("published"))
