"""Queries over stored tables: change batches merged into a snapshot, numbering and balances
carried from batch to batch (§2.3 sinks, O-C5..O-C10, O-A2, O-B3)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from decantry.operators import catalog as C
from decantry.operators import ledger as LG
from decantry.operators import lifecycle as L
from decantry.operators import orders as O
from decantry.plans.q_catalog import _PRICE_OK, CH_VIEWS, STOCK_VIEWS, _changes
from decantry.plans.q_lifecycle import _events
from decantry.plans.registry import query
from decantry.session import cut_lineage, ensure_checkpoint_dir
from decantry.sources import driver as D
from decantry.sources import store as ST


def _folder(spark, name):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/store-{name}-{uuid.uuid4().hex[:12]}"


_STORED_VIEWS = {
    **CH_VIEWS, **STOCK_VIEWS,
    "cat1": f"""
SELECT c.* REPLACE (coalesce(l.p2, c.price_2ml) AS price_2ml, coalesce(l.p3, c.price_3ml) AS price_3ml,
                    coalesce(l.p5, c.price_5ml) AS price_5ml, coalesce(l.p10, c.price_10ml) AS price_10ml)
FROM f_catalog c LEFT JOIN (
  SELECT ch.catalog_id, arg_max(CAST(round(ch.price_2ml, 2) AS DECIMAL(10,2)), ch.seq) AS p2, arg_max(CAST(round(ch.price_3ml, 2) AS DECIMAL(10,2)), ch.seq) AS p3,
         arg_max(CAST(round(ch.price_5ml, 2) AS DECIMAL(10,2)), ch.seq) AS p5, arg_max(CAST(round(ch.price_10ml, 2) AS DECIMAL(10,2)), ch.seq) AS p10
  FROM changes ch JOIN f_catalog k ON k.id = ch.catalog_id
  WHERE ch.kind = 'prices' AND k.deleted_at IS NULL AND {_PRICE_OK} GROUP BY ch.catalog_id) l ON l.catalog_id = c.id""",
    "cat2": """
SELECT c.* REPLACE (coalesce(l.norm, c.availability_status) AS availability_status,
                    CASE WHEN l.norm IS NOT NULL THEN l.norm <> 'hidden' ELSE c.active END AS active)
FROM cat1 c LEFT JOIN (
  SELECT ch.catalog_id, arg_max(lower(trim(ch.new_status)), ch.seq) AS norm FROM changes ch JOIN cat1 k ON k.id = ch.catalog_id
  WHERE ch.kind = 'status' AND lower(trim(ch.new_status)) IN ('published', 'upcoming', 'hidden') AND k.deleted_at IS NULL
    AND (lower(trim(ch.new_status)) <> 'published'
         OR (k.price_2ml IS NOT NULL AND k.price_3ml IS NOT NULL AND k.price_5ml IS NOT NULL AND k.price_10ml IS NOT NULL))
  GROUP BY ch.catalog_id) l ON l.catalog_id = c.id""",
    "cat3": """
SELECT c.* REPLACE (CASE WHEN l.a IS NOT NULL THEN CAST(round(l.a + coalesce(s.sold_ml_raw, 0), 2) AS DECIMAL(10,2)) ELSE c.stock_initial_ml END AS stock_initial_ml,
                    coalesce(l.t, c.low_stock_threshold_ml) AS low_stock_threshold_ml)
FROM cat2 c LEFT JOIN (
  SELECT catalog_id, arg_max(available_ml, seq) AS a, arg_max(CAST(round(threshold_ml, 2) AS DECIMAL(10,2)), seq) AS t
  FROM changes WHERE kind = 'stock' AND available_ml >= 0 AND threshold_ml >= 0 AND available_ml < 10000000 AND threshold_ml < 100000000
  GROUP BY catalog_id) l ON l.catalog_id = c.id LEFT JOIN sold s ON s.perfume = c.name""",
    "cat4": """
SELECT c.* REPLACE (CASE WHEN f.ts IS NOT NULL THEN f.ts ELSE c.deleted_at END AS deleted_at,
                    CASE WHEN f.ts IS NOT NULL THEN false ELSE c.active END AS active,
                    CASE WHEN f.ts IS NOT NULL THEN 'hidden' ELSE c.availability_status END AS availability_status)
FROM cat3 c LEFT JOIN (SELECT ch.catalog_id, arg_min(ch.change_ts, ch.seq) AS ts FROM changes ch JOIN cat3 k ON k.id = ch.catalog_id
                       WHERE ch.kind = 'delete' AND k.deleted_at IS NULL GROUP BY ch.catalog_id) f ON f.catalog_id = c.id""",
    "cat5": """
SELECT c.* REPLACE (CASE WHEN l.catalog_id IS NOT NULL THEN l.v.u ELSE c.image_url END AS image_url)
FROM cat4 c LEFT JOIN (SELECT ch.catalog_id, arg_max(struct_pack(u := nullif(trim(ch.image_url), '')), ch.seq) AS v
                       FROM changes ch JOIN cat4 k ON k.id = ch.catalog_id
                       WHERE ch.kind = 'image' AND k.deleted_at IS NULL GROUP BY ch.catalog_id) l ON l.catalog_id = c.id""",
}


@query("stored_catalog_changes", "2.3-Sinks+O-C5+O-C6+O-C7+O-C8+O-C9+O-C10", oracle="""
SELECT c.* EXCLUDE (accords, notes) REPLACE (coalesce(l.a, c.active) AS active)
FROM cat5 c LEFT JOIN (SELECT catalog_id, arg_max(active_flag, seq) AS a FROM changes WHERE kind = 'active' GROUP BY catalog_id) l
  ON l.catalog_id = c.id""", extra_views=_STORED_VIEWS)
def stored_catalog_changes(spark, d):
    """The catalogue as a store, six change batches merged one after another (each twice: the
    replay changes nothing), and the last version read back."""
    path = _folder(spark, "catalog")
    ST.create_store(D.f_catalog(spark, d), path, "id", buckets=16)
    orders = (D.f_orders_core(spark, d), D.f_items_core(spark, d), D.item_names(spark, d))
    steps = {"prices": C.apply_price_changes, "status": C.apply_status_changes,
             "stock": lambda cat, ch: C.apply_stock_counts(cat, ch, *orders), "delete": C.soft_delete,
             "image": C.apply_image_changes, "active": C.apply_active_flags}
    for kind, step in steps.items():
        changes = _changes(spark, d, kind)
        for _ in range(2):
            ST.merge_batch(spark, path, kind, changes.select(F.col("catalog_id").alias("id")),
                           lambda cat, step=step, changes=changes: step(cat, changes)[0])
    return ST.read_store(spark, path).drop("accords", "notes")


@query("number_orders_in_batches", "O-A2", oracle="""
SELECT id, seq, 'P-' || CASE WHEN length(CAST(seq AS VARCHAR)) >= 5 THEN CAST(seq AS VARCHAR) ELSE lpad(CAST(seq AS VARCHAR), 5, '0') END AS order_number
FROM (SELECT id, row_number() OVER (ORDER BY id % 3, created_at, id) AS seq FROM f_orders)""")
def number_orders_in_batches(spark, d):
    """Three batches of new orders, one of them sent twice, numbered from the store's mark on."""
    path = _folder(spark, "orders")
    core = D.f_orders_core(spark, d).select("id", "created_at")
    ST.create_store(O.number_orders(core.limit(0)).select("id", "created_at", "seq", "order_number"), path, "id", buckets=16)
    for k in (0, 1, 1, 2):
        ST.append_numbered(spark, path, f"batch-{k}", core.filter(F.col("id") % 3 == k),
                           lambda rows, start: O.number_orders(rows, start=start), "orders")
    return ST.read_store(spark, path).select("id", "seq", "order_number")


def balance_overrides(spark, d):
    """Balances set by the admin ('signup' events): the event's value, whole for bookmarks."""
    e = D.read(spark, d, "events").filter(F.col("event_type") == "signup")
    return e.select(F.col("user_id").alias("customer_id"), "ts", F.col("event_id").alias("seq"),
                    F.col("value").cast("decimal(12,2)").alias("total_value"), F.floor("value").cast("bigint").alias("marks_value"))


@query("ledger_in_batches", "O-B3", oracle="""
, deltas AS (
  SELECT o.customer_id, t.ts, t.seq, CASE WHEN t.entered THEN 1 ELSE -1 END * o.order_total AS dt,
         CASE WHEN t.entered THEN 1 ELSE -1 END * CAST(floor(o.order_total) AS BIGINT) AS dm
  FROM f_transitions t JOIN f_lifecycle_orders o ON o.id = t.order_id),
steps AS (
  SELECT customer_id, ts, seq, dt, dm, 0 AS is_set FROM deltas
  UNION ALL SELECT user_id, ts, event_id, CAST(value AS DECIMAL(12,2)), CAST(floor(value) AS BIGINT), 1 FROM events WHERE event_type = 'signup'),
ordered AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY ts, seq, is_set) AS k FROM steps),
walk AS (
  SELECT customer_id, k, CAST(CASE WHEN is_set = 1 THEN dt ELSE greatest(0, dt) END AS DECIMAL(22,2)) AS bt,
         CASE WHEN is_set = 1 THEN dm ELSE greatest(0, dm) END AS bm FROM ordered WHERE k = 1
  UNION ALL
  SELECT w.customer_id, o.k, CAST(CASE WHEN o.is_set = 1 THEN o.dt ELSE greatest(0, w.bt + o.dt) END AS DECIMAL(22,2)),
         CASE WHEN o.is_set = 1 THEN o.dm ELSE greatest(0, w.bm + o.dm) END
  FROM walk w JOIN ordered o ON o.customer_id = w.customer_id AND o.k = w.k + 1)
SELECT w.customer_id, w.bt AS total_spent, w.bm AS bookmarks
FROM walk w JOIN (SELECT customer_id, max(k) AS mk FROM ordered GROUP BY customer_id) m ON m.customer_id = w.customer_id AND w.k = m.mk""")
def ledger_in_batches(spark, d):
    """Balances (total and bookmarks) from summaries kept in a store: ten batches in time, each
    reading its own deltas and overrides only."""
    ev = _events(spark, d)
    tr = L.transitions(ev).filter(F.col("entered") | F.col("left")).select("order_id", "customer_id", "ts", "seq", "entered")
    orders = D.f_lifecycle_orders(spark, d).select(F.col("id").alias("order_id"), "customer_id", "order_total")
    sign = F.when(F.col("entered"), 1).otherwise(-1)
    deltas = cut_lineage(tr.join(orders, ["order_id", "customer_id"]).select(
        "customer_id", "ts", "seq", (sign * F.col("order_total")).cast("decimal(12,2)").alias("total_delta"),
        (sign * F.floor("order_total")).cast("bigint").alias("marks_delta")))
    over = balance_overrides(spark, d)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    bounds = over.select(at.cast("double").alias("t")).approxQuantile("t", [k / 10 for k in range(1, 10)], 0.01)
    paths = {}
    for name, kind, total in (("total", "decimal(12,2)", "decimal(22,2)"), ("marks", "bigint", "bigint")):
        paths[name] = _folder(spark, f"ledger-{name}")
        ST.create_store(spark.createDataFrame([], f"customer_id long, start {kind}, total {total}, low {total}"), paths[name], "customer_id", buckets=16)
    for k, (low, high) in enumerate(zip([None, *bounds], [*bounds, None])):
        def part(df, low=low, high=high):
            df = df if low is None else df.filter(at > F.lit(low))
            return df if high is None else df.filter(at <= F.lit(high))
        for name, path in paths.items():
            batch = cut_lineage(LG.summarise(part(deltas), part(over), f"{name}_delta", f"{name}_value"))
            ST.merge_batch(spark, path, f"batch-{k}", batch.select("customer_id"), lambda c, batch=batch: LG.merged(c, batch))
    both = [ST.read_store(spark, p).select("customer_id", LG.balance().alias(n)) for n, p in paths.items()]
    return both[0].join(both[1], "customer_id").select("customer_id", F.col("total").cast("decimal(22,2)").alias("total_spent"),
                                                       F.col("marks").cast("bigint").alias("bookmarks"))
