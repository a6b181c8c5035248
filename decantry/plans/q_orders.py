"""Order queries (O-A*) over the driver views."""

from __future__ import annotations

from pyspark.sql import functions as F

from decantry.operators import orders as O
from decantry.plans.registry import query
from decantry.sources import driver as D

# Flat text of an items array (arrays are compared as text across engines).
_ITEMS_TEXT_SQL = """(SELECT order_id,
        string_agg(qty || ' x ' || name || ' (' || size || ')', ', ' ORDER BY line, name, size, qty) AS items_text,
        count(*) AS n_items
 FROM f_items GROUP BY order_id)"""


def _items_text(col="items"):
    return F.concat_ws(", ", F.transform(col, lambda i: F.concat(i["qty"], F.lit(" x "), i["name"],
                                                                 F.lit(" ("), i["size"], F.lit(")"))))


@query("explode_items", "O-A6", oracle="""
SELECT i.order_id, i.name, i.size, i.qty, trim(i.name) AS perfume,
       coalesce(TRY_CAST(nullif(regexp_replace(i.size, '[^0-9.]', '', 'g'), '') AS DECIMAL(18,4)), CAST(0 AS DECIMAL(18,4))) AS ml,
       coalesce(TRY_CAST(nullif(i.qty, '') AS DECIMAL(18,4)), CAST(1 AS DECIMAL(18,4))) AS qty_n,
       (nullif(regexp_replace(i.size, '[^0-9.]', '', 'g'), '') IS NOT NULL
          AND TRY_CAST(nullif(regexp_replace(i.size, '[^0-9.]', '', 'g'), '') AS DECIMAL(18,4)) IS NULL)
       OR (nullif(i.qty, '') IS NOT NULL AND TRY_CAST(nullif(i.qty, '') AS DECIMAL(18,4)) IS NULL) AS quarantine
FROM f_items i WHERE i.order_id IN (SELECT id FROM f_orders)""")
def explode_items(spark, d):
    nested = D.nest_items(D.f_orders_core(spark, d).select("id"), D.f_items(spark, d))
    return O.explode_items(nested).withColumnRenamed("id", "order_id")


STORED_ITEMS_SQL = """
SELECT order_id, line, name, CASE WHEN order_id % 97 = 5 AND line % 4 = 2 THEN '1.2.3 ml' ELSE size END AS size,
       CASE WHEN order_id % 89 = 7 AND line % 4 = 1 THEN 'two' ELSE qty END AS qty FROM f_items"""


@query("explode_stored_items", "O-A6+2.3-Sinks", oracle="""
SELECT order_id, trim(name) AS perfume,
       coalesce(TRY_CAST(nullif(regexp_replace(size, '[^0-9.]', '', 'g'), '') AS DECIMAL(18,4)), CAST(0 AS DECIMAL(18,4))) AS ml,
       coalesce(TRY_CAST(nullif(qty, '') AS DECIMAL(18,4)), CAST(1 AS DECIMAL(18,4))) AS qty_n,
       size = '1.2.3 ml' OR qty = 'two' AS quarantine,
       CASE WHEN size = '1.2.3 ml' OR qty = 'two'
            THEN '{"name":"' || name || '","size":"' || size || '","qty":"' || qty || '"}' END AS rescued
FROM sent WHERE order_id IN (SELECT id FROM f_orders)""", extra_views={"sent": STORED_ITEMS_SQL})
def explode_stored_items(spark, d):
    """Orders with their items as sent (some sizes and quantities do not parse) stored once,
    typed, and their items read back from the store."""
    import uuid

    from decantry.session import ensure_checkpoint_dir
    from decantry.sources import store as ST
    k, line = F.col("order_id"), F.col("line")
    sent = (D.f_items(spark, d).withColumn("size", F.when((k % 97 == 5) & (line % 4 == 2), F.lit("1.2.3 ml")).otherwise(F.col("size")))
            .withColumn("qty", F.when((k % 89 == 7) & (line % 4 == 1), F.lit("two")).otherwise(F.col("qty"))))
    raw = D.nest_items(D.f_orders_core(spark, d).select("id", "status", "created_at"), sent)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/store-order-items-{uuid.uuid4().hex[:12]}"
    ST.create_store(O.with_stored_items(raw.withColumn("items_json", F.to_json("items")).drop("items")), path, "id", buckets=16)
    return O.explode_stored_items(ST.read_store(spark, path)).withColumnRenamed("id", "order_id")


@query("list_orders", "O-A3", oracle=f"""
SELECT o.id, o.order_number, o.customer_id, o.customer_name, o.customer_phone, o.delivery_zone, o.notes,
       coalesce(t.items_text, '') AS items_text, array_to_string(o.reward_ids, ',') AS reward_ids_text,
       o.order_total, o.status, o.accounted_at, o.delivered_at, o.created_at, o.updated_at
FROM f_orders o LEFT JOIN {_ITEMS_TEXT_SQL} t ON o.id = t.order_id""")
def list_orders(spark, d):
    listed = O.list_orders(D.nest_items(D.f_orders(spark, d), D.f_items(spark, d)))
    return listed.select("id", "order_number", "customer_id", "customer_name", "customer_phone", "delivery_zone",
                         "notes", _items_text().alias("items_text"),
                         F.concat_ws(",", "reward_ids").alias("reward_ids_text"),
                         "order_total", "status", "accounted_at", "delivered_at", "created_at", "updated_at")


@query("customer_order_history", "O-A4", oracle=f"""
SELECT o.customer_id, o.id, o.order_number, o.delivery_zone, coalesce(t.items_text, '') AS items_text, o.order_total, o.status,
       o.created_at, o.updated_at, o.delivered_at
FROM f_orders o LEFT JOIN {_ITEMS_TEXT_SQL} t ON o.id = t.order_id WHERE o.customer_id IN (SELECT id FROM f_customers)""")
def customer_order_history(spark, d):
    hist = O.customer_order_history(D.f_orders_nested(spark, d), D.f_customers(spark, d).select(F.col("id").alias("customer_id")))
    return hist.select("customer_id", "id", "order_number", "delivery_zone", _items_text().alias("items_text"), "order_total", "status",
                       "created_at", "updated_at", "delivered_at")


def credentials(spark, d):
    """Profile requests: one per event; the phone is typed in three styles, and 'error'
    events carry a wrong token (they must not match)."""
    e = D.read(spark, d, "events")
    num = F.lpad(F.col("user_id").cast("string"), 6, "0")
    et = F.col("event_type")
    phone = (F.when(et == "view", F.concat(F.lit("34600"), num))
             .when(et == "click", F.concat(F.lit("(+34) 600-"), num))
             .otherwise(F.concat(F.lit("+34 600 "), num)))
    token = F.concat(F.when(et == "error", F.lit("tok-x")).otherwise(F.lit("tok-")), F.col("user_id").cast("string"))
    return e.select(F.col("event_id").alias("request_id"), phone.alias("phone"), token.alias("token"))


CREDENTIALS_SQL = """
SELECT event_id AS request_id,
       CASE WHEN event_type = 'view' THEN '34600' || lpad(CAST(user_id AS VARCHAR), 6, '0')
            WHEN event_type = 'click' THEN '(+34) 600-' || lpad(CAST(user_id AS VARCHAR), 6, '0')
            ELSE '+34 600 ' || lpad(CAST(user_id AS VARCHAR), 6, '0') END AS phone,
       CASE WHEN event_type = 'error' THEN 'tok-x' ELSE 'tok-' END || CAST(user_id AS VARCHAR) AS token
FROM events"""

RESOLVE_SQL = """
SELECT r.request_id, m.customer_id, m.customer_id IS NOT NULL AS matched
FROM credentials r LEFT JOIN (
  SELECT r2.request_id, arg_min(c.id, (c.created_at, c.id)) AS customer_id
  FROM credentials r2 JOIN f_customers c
    ON regexp_replace(coalesce(r2.phone, ''), '[^0-9]', '', 'g') = regexp_replace(c.customer_phone, '[^0-9]', '', 'g')
   AND r2.token = c.access_token
  GROUP BY r2.request_id) m ON r.request_id = m.request_id"""


@query("resolve_profiles", "O-A5", oracle="SELECT * FROM resolved",
       extra_views={"credentials": CREDENTIALS_SQL, "resolved": RESOLVE_SQL})
def resolve_profiles(spark, d):
    return O.resolve_profiles(credentials(spark, d), D.f_customers(spark, d))


@query("orders_for_credentials", "O-A5+O-A4", oracle="""
SELECT o.customer_id, o.id, o.order_number, o.order_total, o.status, o.created_at
FROM f_orders o WHERE o.customer_id IN (SELECT customer_id FROM resolved WHERE matched)""",
       extra_views={"credentials": CREDENTIALS_SQL, "resolved": RESOLVE_SQL})
def orders_for_credentials(spark, d):
    out = O.orders_for_credentials(credentials(spark, d), D.f_customers(spark, d), D.f_orders(spark, d))
    return out.select("customer_id", "id", "order_number", "order_total", "status", "created_at")


@query("number_orders", "O-A2", oracle="""
SELECT id, seq,
       'P-' || CASE WHEN length(CAST(seq AS VARCHAR)) >= 5 THEN CAST(seq AS VARCHAR) ELSE lpad(CAST(seq AS VARCHAR), 5, '0') END AS order_number
FROM (SELECT id, row_number() OVER (ORDER BY created_at, id) AS seq FROM f_orders)""")
def number_orders(spark, d):
    core = D.f_orders_core(spark, d).select("id", "created_at")
    return O.number_orders(core).select("id", "seq", "order_number")


def raw_requests(spark, d):
    """Order requests as they arrive from the shop: items as JSON text. Some lack a name, a zone,
    items or a total, or have one below zero or too large."""
    o = D.nest_items(D.f_orders(spark, d), D.f_items(spark, d))
    k, total = F.col("id"), F.col("order_total")
    return o.select(k.alias("request_id"), "customer_id", F.when(k % 97 == 1, F.lit("  ")).otherwise(F.col("customer_name")).alias("customer_name"),
                    "customer_phone", F.when(k % 89 != 2, F.col("delivery_zone")).alias("delivery_zone"), "notes",
                    F.when(k % 73 != 5, F.to_json("items")).alias("items_json"),
                    F.when(k % 83 == 3, -total).when(k % 71 == 6, total * 10000).when(k % 79 != 4, total).cast("decimal(16,2)").alias("order_total"),
                    "reward_ids", "created_at")


@query("ingest_orders", "O-A1", oracle="""
, raw AS (
  SELECT id, CASE WHEN id % 97 = 1 THEN '  ' ELSE customer_name END AS customer_name, customer_phone,
         CASE WHEN id % 89 <> 2 THEN delivery_zone END AS delivery_zone,
         CAST(CASE WHEN id % 83 = 3 THEN -order_total WHEN id % 71 = 6 THEN order_total * 10000 WHEN id % 79 <> 4 THEN order_total END AS DECIMAL(16,2)) AS order_total
  FROM f_orders)
SELECT o.id AS request_id,
       CASE WHEN coalesce(trim(o.customer_name), '') = '' THEN 'name_required'
            WHEN coalesce(trim(o.delivery_zone), '') = '' THEN 'zone_required'
            WHEN coalesce(t.n_items, 0) = 0 THEN 'empty_order'
            WHEN coalesce(o.order_total, 0) < 0 OR o.order_total >= 100000000 THEN 'invalid_total'
            WHEN o.order_total IS NULL THEN 'total_required' END AS reject_reason,
       trim(o.customer_name) AS customer_name, nullif(trim(o.customer_phone), '') AS customer_phone,
       trim(o.delivery_zone) AS delivery_zone, coalesce(t.n_items, 0) AS n_items,
       TRY_CAST(round(o.order_total, 2) AS DECIMAL(10,2)) AS order_total, 'pending' AS status
FROM raw o LEFT JOIN (SELECT order_id, count(*) AS n_items FROM f_items WHERE order_id % 73 <> 5 GROUP BY order_id) t ON o.id = t.order_id""")
def ingest_orders(spark, d):
    out = O.ingest_orders(raw_requests(spark, d))
    return out.select("request_id", "reject_reason", "customer_name", "customer_phone", "delivery_zone",
                      F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
                      "order_total", "status")


@query("rewards_on_orders", "O-A7", oracle="""
SELECT c.reward_id, c.n_orders, r.reward_label, r.threshold
FROM (SELECT reward_id, count(*) AS n_orders FROM (SELECT unnest(reward_ids) AS reward_id FROM f_orders) GROUP BY reward_id) c
LEFT JOIN f_rewards r ON r.id = c.reward_id""")
def rewards_on_orders(spark, d):
    return O.rewards_on_orders(D.f_orders_core(spark, d), D.f_rewards(spark, d))


def historic_imports(spark, d):
    """One historic import per nation; region 0 reuses an existing order number (skipped)."""
    n = D.read(spark, d, "nation")
    k = F.col("n_nationkey").cast("string")
    num = F.when(F.col("n_regionkey") == 0, F.concat(F.lit("P-"), F.lpad(k, 8, "0"))) \
        .otherwise(F.concat(F.lit("P-H"), F.lpad(k, 3, "0")))
    return n.select(num.alias("order_number"), F.col("n_nationkey").cast("bigint").alias("seq"),
                    F.concat(F.lit("customer#"), F.lpad(k, 8, "0")).alias("prefix"),
                    F.col("n_name").alias("customer_name"), F.lit("unspecified").alias("delivery_zone"),
                    F.lit("historic import").alias("notes"),
                    (F.col("n_nationkey").cast("decimal(12,2)") * F.lit(1.37).cast("decimal(4,2)")).alias("order_total"))


@query("import_historic", "O-A8", oracle="""
SELECT i.order_number, m.customer_id, i.customer_name, i.delivery_zone,
       CAST(i.order_total AS DECIMAL(10,2)) AS order_total, 'pending' AS status
FROM imports i
LEFT JOIN (SELECT i2.order_number, arg_min(c.id, (c.created_at, c.id)) AS customer_id
           FROM imports i2 JOIN f_customers c ON starts_with(lower(c.customer_name), i2.prefix)
           GROUP BY i2.order_number) m ON m.order_number = i.order_number
WHERE i.order_number NOT IN (SELECT order_number FROM f_orders)""", extra_views={"imports": """
SELECT CASE WHEN n_regionkey = 0 THEN 'P-' || lpad(CAST(n_nationkey AS VARCHAR), 8, '0')
            ELSE 'P-H' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') END AS order_number,
       'customer#' || lpad(CAST(n_nationkey AS VARCHAR), 8, '0') AS prefix,
       n_name AS customer_name, 'unspecified' AS delivery_zone,
       CAST(n_nationkey AS DECIMAL(12,2)) * CAST(1.37 AS DECIMAL(4,2)) AS order_total
FROM nation"""})
def import_historic(spark, d):
    out = O.import_historic(D.f_orders_core(spark, d), historic_imports(spark, d), D.f_customers(spark, d))
    return out.select("order_number", "customer_id", "customer_name", "delivery_zone", "order_total", "status")
