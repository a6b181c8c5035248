"""Catalogue queries (O-C*) over the driver views."""

from __future__ import annotations

from pyspark.sql import functions as F

from decantry.operators import catalog as C
from decantry.plans.registry import query
from decantry.sources import driver as D

_PRICES = "price_2ml, price_3ml, price_5ml, price_10ml"

SOLD_CTE = """
SELECT trim(i.name) AS perfume,
       sum(coalesce(TRY_CAST(nullif(regexp_replace(i.size, '[^0-9.]', '', 'g'), '') AS DECIMAL(18,4)), CAST(0 AS DECIMAL(18,4)))
           * coalesce(TRY_CAST(nullif(i.qty, '') AS DECIMAL(18,4)), CAST(1 AS DECIMAL(18,4)))) AS sold_ml_raw
FROM f_items i
WHERE i.order_id IN (SELECT id FROM f_orders WHERE status = 'delivered')
GROUP BY trim(i.name)"""

STOCK_CTE = f"""
SELECT c.id, c.name, c.brand, c.active, c.availability_status, c.display_order, {_PRICES}, c.image_url,
       c.stock_initial_ml, c.low_stock_threshold_ml,
       CAST(coalesce(s.sold_ml_raw, 0) AS DECIMAL(18,2)) AS sold_ml,
       CAST(CASE WHEN c.stock_initial_ml IS NULL THEN NULL
                 ELSE greatest(0, c.stock_initial_ml - coalesce(s.sold_ml_raw, 0)) END AS DECIMAL(18,2)) AS stock_available_ml,
       CASE WHEN c.availability_status = 'upcoming' THEN 0 WHEN c.availability_status = 'published' THEN 1 ELSE 2 END AS sort_group
FROM f_catalog c LEFT JOIN sold s ON c.name = s.perfume
WHERE c.deleted_at IS NULL"""

STOCK_VIEWS = {"sold": SOLD_CTE, "stock": STOCK_CTE}


def _stock(spark, d):
    return C.catalog_with_stock(D.f_catalog(spark, d), D.f_orders_core(spark, d), D.f_items_core(spark, d),
                                D.item_names(spark, d))


@query("catalog_with_stock", "O-C2", oracle="SELECT * FROM stock", extra_views=STOCK_VIEWS)
def catalog_with_stock(spark, d):
    return _stock(spark, d)


@query("public_catalog", "O-C1", oracle=f"""
SELECT id, name, brand,
       CASE WHEN deleted_at IS NULL THEN active ELSE false END AS active,
       CASE WHEN deleted_at IS NULL THEN availability_status ELSE 'hidden' END AS availability_status,
       display_order, {_PRICES}, image_url, description, array_to_string(accords, ', ') AS accords, array_to_string(notes, ', ') AS notes,
       journey_theme, journey_title, journey_copy,
       CASE WHEN deleted_at IS NOT NULL THEN 3 WHEN availability_status = 'upcoming' THEN 0
            WHEN availability_status = 'published' THEN 1 ELSE 2 END AS sort_group,
       created_at
FROM f_catalog""")
def public_catalog(spark, d):
    out = C.public_catalog(D.f_catalog(spark, d))
    return out.withColumns({c: F.array_join(c, ", ") for c in ("accords", "notes")})


@query("backfill_status", "O-C3", oracle=f"""
SELECT id, name, active,
       coalesce(CASE WHEN description IN ('SMALL', 'MEDIUM') THEN NULL ELSE availability_status END,
                CASE WHEN active THEN 'published' ELSE 'hidden' END) AS availability_status
FROM f_catalog""")
def backfill_status(spark, d):
    # Legacy rows (types SMALL/MEDIUM) arrive without a status, as before the column existed.
    cat = D.f_catalog(spark, d)
    legacy = cat.withColumn("availability_status",
                            F.when(F.col("description").isin("SMALL", "MEDIUM"), F.lit(None))
                            .otherwise(F.col("availability_status")))
    return C.backfill_status(legacy).select("id", "name", "active", "availability_status")


@query("storefront_by_price", "O-C12", oracle=f"""
SELECT id, name, brand, availability_status, {_PRICES}, image_url,
       availability_status = 'upcoming' AS is_upcoming
FROM f_catalog WHERE availability_status <> 'hidden' AND deleted_at IS NULL""")
def storefront_by_price(spark, d):
    return C.storefront(D.f_catalog(spark, d), "price")


@query("low_stock", "O-C13", oracle="SELECT * FROM stock WHERE stock_available_ml IS NOT NULL AND stock_available_ml <= low_stock_threshold_ml",
       extra_views=STOCK_VIEWS)
def low_stock(spark, d):
    return C.low_stock(_stock(spark, d))


# ---------------------------------------------------------------- change feed (events)
def catalog_changes(spark, d):
    """Admin catalogue changes, one per event: the target product comes from the event's ``k``
    (a hundredth of the catalogue each; some lie beyond it); the kind from the event type
    (error: delete below 30, else active)."""
    e = D.read(spark, d, "events")
    wide = D.row_count(spark, d, "part") // 100
    v = F.col("value")
    money = v.cast("decimal(12,2)")
    kind = (F.when(F.col("event_type") == "view", "status").when(F.col("event_type") == "click", "prices")
            .when(F.col("event_type") == "purchase", "stock").when(F.col("event_type") == "signup", "image")
            .when(v < 30, "delete").otherwise("active"))
    status = (F.when(v < 15, " Published ").when(v < 35, "upcoming").when(v < 70, "HIDDEN")
              .when(v < 90, "bogus").otherwise("published"))
    dec = lambda f: F.lit(f).cast("decimal(3,2)")
    return e.select(
        (F.get_json_object("props", "$.k").cast("bigint") * wide + F.col("event_id") % (wide + 2)).alias("catalog_id"),
        F.col("event_id").alias("seq"), F.col("ts").alias("change_ts"), kind.alias("kind"),
        status.alias("new_status"),
        F.when(v < 3, F.lit(0).cast("decimal(15,4)")).otherwise(money * dec("0.01")).alias("price_2ml"),
        (money * dec("0.02")).alias("price_3ml"), (money * dec("0.03")).alias("price_5ml"),
        F.when(v > 100, F.lit(None).cast("decimal(15,4)")).otherwise(money * dec("0.05")).alias("price_10ml"),
        (money * F.lit(10) - F.lit(500)).alias("available_ml"), (money * dec("0.10")).alias("threshold_ml"),
        F.when(v < 10, F.lit("   ")).otherwise(F.concat(F.lit("img/new-"), F.col("event_id").cast("string"), F.lit(".webp"))).alias("image_url"),
        (F.floor(v) % 2 == 0).alias("active_flag"))


CHANGES_SQL = """
SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) * (SELECT count(*) // 100 FROM part) + event_id % (SELECT count(*) // 100 + 2 FROM part) AS catalog_id,
       event_id AS seq, ts AS change_ts,
       CASE event_type WHEN 'view' THEN 'status' WHEN 'click' THEN 'prices' WHEN 'purchase' THEN 'stock'
            WHEN 'signup' THEN 'image' ELSE CASE WHEN value < 30 THEN 'delete' ELSE 'active' END END AS kind,
       CASE WHEN value < 15 THEN ' Published ' WHEN value < 35 THEN 'upcoming' WHEN value < 70 THEN 'HIDDEN'
            WHEN value < 90 THEN 'bogus' ELSE 'published' END AS new_status,
       CASE WHEN value < 3 THEN CAST(0 AS DECIMAL(15,4)) ELSE CAST(value AS DECIMAL(12,2)) * CAST(0.01 AS DECIMAL(3,2)) END AS price_2ml,
       CAST(value AS DECIMAL(12,2)) * CAST(0.02 AS DECIMAL(3,2)) AS price_3ml,
       CAST(value AS DECIMAL(12,2)) * CAST(0.03 AS DECIMAL(3,2)) AS price_5ml,
       CASE WHEN value > 100 THEN NULL ELSE CAST(value AS DECIMAL(12,2)) * CAST(0.05 AS DECIMAL(3,2)) END AS price_10ml,
       CAST(value AS DECIMAL(12,2)) * 10 - 500 AS available_ml,
       CAST(value AS DECIMAL(12,2)) * CAST(0.10 AS DECIMAL(3,2)) AS threshold_ml,
       CASE WHEN value < 10 THEN '   ' ELSE 'img/new-' || CAST(event_id AS VARCHAR) || '.webp' END AS image_url,
       floor(value) % 2 = 0 AS active_flag
FROM events"""

CH_VIEWS = {"changes": CHANGES_SQL}


def _changes(spark, d, kind):
    return catalog_changes(spark, d).filter(F.col("kind") == kind)


_PRICE_OK = """(ch.price_2ml IS NOT NULL AND ch.price_3ml IS NOT NULL AND ch.price_5ml IS NOT NULL AND ch.price_10ml IS NOT NULL
  AND least(ch.price_2ml, ch.price_3ml, ch.price_5ml, ch.price_10ml) > 0
  AND greatest(ch.price_2ml, ch.price_3ml, ch.price_5ml, ch.price_10ml) < 100000000)"""

VALID_PRICES_SQL = f"""
SELECT ch.* FROM changes ch JOIN f_catalog c ON c.id = ch.catalog_id
WHERE ch.kind = 'prices' AND c.deleted_at IS NULL AND {_PRICE_OK}"""


@query("apply_price_changes", "O-C6", oracle="""
SELECT c.id, coalesce(l.p2, c.price_2ml) AS price_2ml, coalesce(l.p3, c.price_3ml) AS price_3ml,
       coalesce(l.p5, c.price_5ml) AS price_5ml, coalesce(l.p10, c.price_10ml) AS price_10ml
FROM f_catalog c LEFT JOIN (
  SELECT catalog_id, arg_max(CAST(round(price_2ml, 2) AS DECIMAL(10,2)), seq) AS p2, arg_max(CAST(round(price_3ml, 2) AS DECIMAL(10,2)), seq) AS p3,
         arg_max(CAST(round(price_5ml, 2) AS DECIMAL(10,2)), seq) AS p5, arg_max(CAST(round(price_10ml, 2) AS DECIMAL(10,2)), seq) AS p10
  FROM valid_prices GROUP BY catalog_id) l ON l.catalog_id = c.id""",
       extra_views={**CH_VIEWS, "valid_prices": VALID_PRICES_SQL})
def apply_price_changes(spark, d):
    new, _ = C.apply_price_changes(D.f_catalog(spark, d), _changes(spark, d, "prices"))
    return new.select("id", *C.PRICE_COLS)


@query("price_change_rejects", "O-C6", oracle=f"""
SELECT ch.catalog_id, ch.seq,
       CASE WHEN c.id IS NULL THEN 'not_found' WHEN c.deleted_at IS NOT NULL THEN 'deleted'
            WHEN ch.price_2ml IS NULL OR ch.price_3ml IS NULL OR ch.price_5ml IS NULL OR ch.price_10ml IS NULL THEN 'prices_incomplete'
            WHEN least(ch.price_2ml, ch.price_3ml, ch.price_5ml, ch.price_10ml) <= 0 THEN 'price_not_positive'
            ELSE 'price_out_of_range' END AS reject_reason
FROM changes ch LEFT JOIN f_catalog c ON c.id = ch.catalog_id
WHERE ch.kind = 'prices' AND NOT (c.id IS NOT NULL AND c.deleted_at IS NULL AND {_PRICE_OK})""", extra_views=CH_VIEWS)
def price_change_rejects(spark, d):
    _, rej = C.apply_price_changes(D.f_catalog(spark, d), _changes(spark, d, "prices"))
    return rej


@query("apply_status_changes", "O-C5", oracle="""
, st AS (
  SELECT ch.catalog_id, ch.seq, lower(trim(coalesce(ch.new_status, ''))) AS norm,
         c.id IS NOT NULL AND c.deleted_at IS NULL AS live,
         (c.price_2ml IS NOT NULL AND c.price_3ml IS NOT NULL AND c.price_5ml IS NOT NULL AND c.price_10ml IS NOT NULL) AS has_prices,
         (SELECT min(v.seq) FROM valid_prices v WHERE v.catalog_id = ch.catalog_id) AS first_price_seq
  FROM changes ch LEFT JOIN f_catalog c ON c.id = ch.catalog_id WHERE ch.kind = 'status'),
ok AS (
  SELECT * FROM st WHERE norm IN ('published', 'upcoming', 'hidden') AND live
    AND (norm <> 'published' OR has_prices OR coalesce(first_price_seq < seq, false)))
SELECT c.id, coalesce(l.norm, c.availability_status) AS availability_status,
       CASE WHEN l.norm IS NOT NULL THEN l.norm <> 'hidden' ELSE c.active END AS active
FROM f_catalog c LEFT JOIN (SELECT catalog_id, arg_max(norm, seq) AS norm FROM ok GROUP BY catalog_id) l ON l.catalog_id = c.id""",
       extra_views={**CH_VIEWS, "valid_prices": VALID_PRICES_SQL})
def apply_status_changes(spark, d):
    new, _ = C.apply_status_changes(D.f_catalog(spark, d), _changes(spark, d, "status"), _changes(spark, d, "prices"))
    return new.select("id", "availability_status", "active")


@query("apply_stock_counts", "O-C7", oracle="""
SELECT c.id,
       CASE WHEN l.a IS NOT NULL THEN CAST(round(l.a + coalesce(s.sold_ml_raw, 0), 2) AS DECIMAL(10,2)) ELSE c.stock_initial_ml END AS stock_initial_ml,
       coalesce(l.t, c.low_stock_threshold_ml) AS low_stock_threshold_ml
FROM f_catalog c
LEFT JOIN (SELECT catalog_id, arg_max(available_ml, seq) AS a, arg_max(CAST(round(threshold_ml, 2) AS DECIMAL(10,2)), seq) AS t
           FROM changes WHERE kind = 'stock' AND available_ml >= 0 AND threshold_ml >= 0
             AND available_ml < 10000000 AND threshold_ml < 100000000
             AND catalog_id IN (SELECT id FROM f_catalog) GROUP BY catalog_id) l ON l.catalog_id = c.id
LEFT JOIN sold s ON s.perfume = c.name""", extra_views={**CH_VIEWS, **STOCK_VIEWS})
def apply_stock_counts(spark, d):
    new, _ = C.apply_stock_counts(D.f_catalog(spark, d), _changes(spark, d, "stock"),
                                  D.f_orders_core(spark, d), D.f_items_core(spark, d), D.item_names(spark, d))
    return new.select("id", "stock_initial_ml", "low_stock_threshold_ml")


@query("soft_delete", "O-C8", oracle="""
SELECT c.id,
       CASE WHEN f.first_seq IS NOT NULL THEN f.ts ELSE c.deleted_at END AS deleted_at,
       CASE WHEN f.first_seq IS NOT NULL THEN false ELSE c.active END AS active,
       CASE WHEN f.first_seq IS NOT NULL THEN 'hidden' ELSE c.availability_status END AS availability_status
FROM f_catalog c LEFT JOIN (
  SELECT ch.catalog_id, min(ch.seq) AS first_seq, arg_min(ch.change_ts, ch.seq) AS ts
  FROM changes ch JOIN f_catalog c2 ON c2.id = ch.catalog_id
  WHERE ch.kind = 'delete' AND c2.deleted_at IS NULL GROUP BY ch.catalog_id) f ON f.catalog_id = c.id""", extra_views=CH_VIEWS)
def soft_delete(spark, d):
    new, _ = C.soft_delete(D.f_catalog(spark, d), _changes(spark, d, "delete"))
    return new.select("id", "deleted_at", "active", "availability_status")


@query("soft_delete_rejects", "O-C8", oracle="""
SELECT ch.catalog_id, ch.seq,
       CASE WHEN c.id IS NULL THEN 'not_found' ELSE 'already_deleted' END AS reject_reason
FROM changes ch LEFT JOIN f_catalog c ON c.id = ch.catalog_id
WHERE ch.kind = 'delete' AND (c.id IS NULL OR c.deleted_at IS NOT NULL OR ch.seq <> (
  SELECT min(x.seq) FROM changes x WHERE x.kind = 'delete' AND x.catalog_id = ch.catalog_id))""", extra_views=CH_VIEWS)
def soft_delete_rejects(spark, d):
    _, rej = C.soft_delete(D.f_catalog(spark, d), _changes(spark, d, "delete"))
    return rej


@query("apply_image_changes", "O-C9", oracle="""
SELECT c.id, CASE WHEN l.catalog_id IS NOT NULL THEN l.v.u ELSE c.image_url END AS image_url
FROM f_catalog c LEFT JOIN (
  SELECT ch.catalog_id, arg_max(struct_pack(u := nullif(trim(ch.image_url), '')), ch.seq) AS v
  FROM changes ch JOIN f_catalog c2 ON c2.id = ch.catalog_id
  WHERE ch.kind = 'image' AND c2.deleted_at IS NULL GROUP BY ch.catalog_id) l ON l.catalog_id = c.id""", extra_views=CH_VIEWS)
def apply_image_changes(spark, d):
    new, _ = C.apply_image_changes(D.f_catalog(spark, d), _changes(spark, d, "image"))
    return new.select("id", "image_url")


@query("apply_active_flags", "O-C10", oracle="""
SELECT c.id, coalesce(l.a, c.active) AS active, c.availability_status
FROM f_catalog c LEFT JOIN (SELECT catalog_id, arg_max(active_flag, seq) AS a FROM changes WHERE kind = 'active'
                            GROUP BY catalog_id) l ON l.catalog_id = c.id""", extra_views=CH_VIEWS)
def apply_active_flags(spark, d):
    new, _ = C.apply_active_flags(D.f_catalog(spark, d), _changes(spark, d, "active"))
    return new.select("id", "active", "availability_status")


def product_requests(spark, d):
    """New-product requests (every 'purchase' event): recurring names, blank brands, odd
    statuses, missing or negative prices, and names that already exist in the catalogue."""
    e = D.read(spark, d, "events").filter(F.col("event_type") == "purchase")
    cat = D.f_catalog(spark, d).select(F.col("id").alias("_pk"), F.col("name").alias("_existing"))
    v = F.col("value")
    money = v.cast("decimal(12,2)")
    dec = lambda f: F.lit(f).cast("decimal(3,2)")
    no_price = F.col("event_id") % 3 == 0
    parts = D.row_count(spark, d, "part")
    base = e.select(F.col("event_id").alias("seq"), (F.col("event_id") % parts).alias("_pk"), v.alias("_v"),
                    F.concat(F.lit("New "), (F.col("event_id") % (parts // 5)).cast("string")).alias("_new"),
                    F.when(v > 200, F.lit(" ")).otherwise(F.concat(F.lit("Brand#"), F.col("user_id").cast("string"))).alias("brand"),
                    F.when(v < 70, F.lit("published")).when(v < 90, F.lit(" Upcoming ")).when(v < 110, F.lit("hidden"))
                     .when(v < 120, F.lit("secret")).otherwise(F.lit(None).cast("string")).alias("new_status"),
                    F.when(no_price, F.lit(None)).otherwise(money * dec("0.01")).alias("price_2ml"),
                    F.when(no_price, F.lit(None)).otherwise(money * dec("0.02")).alias("price_3ml"),
                    F.when(no_price, F.lit(None)).when((v > 95) & (v < 100), -money).otherwise(money * dec("0.03")).alias("price_5ml"),
                    F.when(no_price, F.lit(None)).otherwise(money * dec("0.05")).alias("price_10ml"),
                    F.concat(F.lit(" img/p"), F.col("event_id").cast("string"), F.lit(".webp ")).alias("image_url"))
    return (base.join(cat, "_pk", "left")
            .withColumn("name", F.when(F.col("_v") > 150, F.col("_existing")).otherwise(F.col("_new")))
            .drop("_pk", "_v", "_new", "_existing"))


CREATE_CTES = """
, req AS (
  SELECT e.event_id AS seq, e.value AS v,
         CASE WHEN e.value > 150 THEN c.name ELSE 'New ' || CAST(e.event_id % (SELECT count(*) // 5 FROM part) AS VARCHAR) END AS name,
         CASE WHEN e.value > 200 THEN ' ' ELSE 'Brand#' || CAST(e.user_id AS VARCHAR) END AS brand,
         CASE WHEN e.value < 70 THEN 'published' WHEN e.value < 90 THEN ' Upcoming ' WHEN e.value < 110 THEN 'hidden'
              WHEN e.value < 120 THEN 'secret' END AS new_status,
         CASE WHEN e.event_id % 3 = 0 THEN NULL ELSE CAST(e.value AS DECIMAL(12,2)) * CAST(0.01 AS DECIMAL(3,2)) END AS p2,
         CASE WHEN e.event_id % 3 = 0 THEN NULL ELSE CAST(e.value AS DECIMAL(12,2)) * CAST(0.02 AS DECIMAL(3,2)) END AS p3,
         CASE WHEN e.event_id % 3 = 0 THEN NULL WHEN e.value > 95 AND e.value < 100 THEN -CAST(e.value AS DECIMAL(12,2))
              ELSE CAST(e.value AS DECIMAL(12,2)) * CAST(0.03 AS DECIMAL(3,2)) END AS p5,
         CASE WHEN e.event_id % 3 = 0 THEN NULL ELSE CAST(e.value AS DECIMAL(12,2)) * CAST(0.05 AS DECIMAL(3,2)) END AS p10,
         ' img/p' || CAST(e.event_id AS VARCHAR) || '.webp ' AS image_url
  FROM events e LEFT JOIN f_catalog c ON c.id = e.event_id % (SELECT count(*) FROM part)
  WHERE e.event_type = 'purchase'),
n AS (SELECT *, lower(trim(coalesce(new_status, 'upcoming'))) AS st, trim(name) AS tname FROM req),
judged AS (
SELECT n.*, round(p2, 2) AS r2, round(p3, 2) AS r3, round(p5, 2) AS r5, round(p10, 2) AS r10,
       CASE WHEN coalesce(n.tname, '') = '' OR coalesce(trim(n.brand), '') = '' THEN 'name_brand_required'
            WHEN n.st NOT IN ('published', 'upcoming', 'hidden') THEN 'invalid_status'
            WHEN n.st = 'published' AND (p2 IS NULL OR p3 IS NULL OR p5 IS NULL OR p10 IS NULL OR least(r2, r3, r5, r10) <= 0) THEN 'prices_required'
            WHEN least(coalesce(r2, 1), coalesce(r3, 1), coalesce(r5, 1), coalesce(r10, 1)) <= 0 THEN 'price_not_positive'
       END AS wrong
FROM n),
firsts AS (SELECT tname AS ftname, min(seq) AS first_seq FROM judged WHERE wrong IS NULL GROUP BY tname),
created AS (
SELECT j.seq, j.tname AS name, trim(j.brand) AS brand, nullif(trim(j.image_url), '') AS image_url,
       TRY_CAST(r2 AS DECIMAL(10,2)) AS price_2ml, TRY_CAST(r3 AS DECIMAL(10,2)) AS price_3ml,
       TRY_CAST(r5 AS DECIMAL(10,2)) AS price_5ml, TRY_CAST(r10 AS DECIMAL(10,2)) AS price_10ml,
       j.st AS availability_status, j.st <> 'hidden' AS active,
       CASE WHEN j.wrong IS NOT NULL THEN j.wrong
            WHEN j.tname IN (SELECT name FROM f_catalog) OR j.seq <> f.first_seq THEN 'duplicate_name' END AS reject_reason
FROM judged j LEFT JOIN firsts f ON f.ftname = j.tname)"""

CREATE_SQL = CREATE_CTES + "\nSELECT * FROM created"


@query("create_products", "O-C4", oracle=CREATE_SQL)
def create_products(spark, d):
    return C.create_products(D.f_catalog(spark, d), product_requests(spark, d))


@query("seed_museum_blank_brands", "O-C11", oracle="""
, snap AS (SELECT perfume_name, CASE WHEN artwork_path = '' THEN '' ELSE brand END AS brand, artwork_path, published FROM f_museum),
seed AS (SELECT name AS perfume_name, brand FROM f_catalog
         UNION ALL SELECT n_name || ' #N' || CAST(n_nationkey AS VARCHAR), 'Brand#N' || CAST(n_nationkey AS VARCHAR) FROM nation)
SELECT s.perfume_name, CASE WHEN s.brand = '' AND k.brand IS NOT NULL THEN k.brand ELSE s.brand END AS brand,
       s.artwork_path, s.published
FROM snap s LEFT JOIN seed k ON k.perfume_name = s.perfume_name
UNION ALL
SELECT k.perfume_name, k.brand, NULL, NULL FROM seed k WHERE k.perfume_name NOT IN (SELECT perfume_name FROM snap)""")
def seed_museum_blank_brands(spark, d):
    """Museum works without an artwork arrive without a brand; seeding from the catalogue
    (plus one new work per nation) fills blank brands only and inserts missing works."""
    m = D.f_museum(spark, d)
    snap = m.select("perfume_name", F.when(F.col("artwork_path") == "", F.lit("")).otherwise(F.col("brand")).alias("brand"),
                    "artwork_path", "published")
    n = D.read(spark, d, "nation")
    seed = (D.f_catalog(spark, d).select(F.col("name").alias("perfume_name"), "brand")
            .unionByName(n.select(F.concat(F.col("n_name"), F.lit(" #N"), F.col("n_nationkey").cast("string")).alias("perfume_name"),
                                  F.concat(F.lit("Brand#N"), F.col("n_nationkey").cast("string")).alias("brand"))))
    return C.seed_fill_blank(snap, seed, "perfume_name", "brand")


@query("seed_catalog_if_absent", "O-C11", oracle="""
SELECT id, name, brand FROM f_catalog
UNION ALL
SELECT 100000000 + n_nationkey, n_name || ' #N' || CAST(n_nationkey AS VARCHAR), 'Brand#N' || CAST(n_nationkey AS VARCHAR) FROM nation""")
def seed_catalog_if_absent(spark, d):
    """``insert ... on conflict (name) do nothing``: catalogue names re-seeded are skipped,
    one new product per nation is added."""
    cat = D.f_catalog(spark, d).select("id", "name", "brand")
    n = D.read(spark, d, "nation")
    seed = (cat.unionByName(n.select((F.lit(100000000) + F.col("n_nationkey")).cast("bigint").alias("id"),
                                     F.concat(F.col("n_name"), F.lit(" #N"), F.col("n_nationkey").cast("string")).alias("name"),
                                     F.concat(F.lit("Brand#N"), F.col("n_nationkey").cast("string")).alias("brand"))))
    return C.seed_if_absent(cat, seed, ["name"])



@query("create_products_museum", "O-C4", oracle=CREATE_CTES + """
SELECT coalesce(m.perfume_name, c.name) AS perfume_name, coalesce(c.brand, m.brand) AS brand,
       coalesce(m.artwork_path, '') AS artwork_path, coalesce(m.description, '') AS description,
       coalesce(m.published, false) AS published
FROM f_museum m FULL JOIN (SELECT name, brand FROM created WHERE reject_reason IS NULL) c ON c.name = m.perfume_name""")
def create_products_museum(spark, d):
    """Museum after the batch of new products: new works unpublished, existing ones re-branded."""
    created = C.create_products(D.f_catalog(spark, d), product_requests(spark, d))
    return C.museum_rows_for_new_products(D.f_museum(spark, d).drop("accords", "notes", "updated_at"), created)
