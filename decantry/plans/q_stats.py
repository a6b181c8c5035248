"""Statistics (O-G*) and dashboard (O-H*) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from decantry.operators import stats as S
from decantry.plans.q_lifecycle import LIFE_VIEWS, _members
from decantry.plans.q_rewards import BALANCES_SQL, snapshot_balances
from decantry.plans.registry import query
from decantry.sources import driver as D

_ML = "coalesce(TRY_CAST(nullif(regexp_replace(i.size, '[^0-9.]', '', 'g'), '') AS DECIMAL(18,4)), CAST(0 AS DECIMAL(18,4)))"
_QTY = "coalesce(TRY_CAST(nullif(i.qty, '') AS DECIMAL(18,4)), CAST(1 AS DECIMAL(18,4)))"
_DELIVERED_ITEMS = "f_items i WHERE i.order_id IN (SELECT id FROM f_orders WHERE status = 'delivered')"


def _o(spark, d):
    return D.f_orders(spark, d)


def _oc(spark, d):
    return D.f_orders_core(spark, d)


@query("delivered_revenue", "O-G1", oracle="""
SELECT CAST(sum(order_total) AS DECIMAL(18,2)) AS revenue, count(*) AS delivered_orders
FROM f_orders WHERE status = 'delivered'""")
def delivered_revenue(spark, d):
    return S.delivered_revenue(_oc(spark, d))


@query("average_ticket", "O-G2", oracle="""
SELECT revenue, delivered_orders,
       CASE WHEN delivered_orders = 0 THEN NULL ELSE
         CAST(CAST((CAST(revenue * 100 AS HUGEINT) * 2 + delivered_orders) // (delivered_orders * 2) AS DECIMAL(38,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2)) END AS average_ticket
FROM (SELECT CAST(sum(order_total) AS DECIMAL(18,2)) AS revenue, count(*) AS delivered_orders FROM f_orders WHERE status = 'delivered')""")
def average_ticket(spark, d):
    return S.average_ticket(_oc(spark, d))


@query("buyers_repeat_rate", "O-G3", oracle="""
SELECT buyers, repeat_buyers,
       CASE WHEN buyers = 0 THEN NULL ELSE
         CAST(CAST((CAST(repeat_buyers AS HUGEINT) * 10000 * 2 + buyers) // (buyers * 2) AS DECIMAL(38,0)) * CAST(0.0001 AS DECIMAL(5,4)) AS DECIMAL(18,4)) END AS repeat_rate
FROM (SELECT count(*) AS buyers, count(*) FILTER (WHERE n >= 2) AS repeat_buyers
      FROM (SELECT customer_id, count(*) AS n FROM f_orders WHERE status = 'delivered' AND customer_id IS NOT NULL GROUP BY customer_id))""")
def buyers_repeat_rate(spark, d):
    return S.buyers_repeat_rate(_oc(spark, d))


@query("decants_served", "O-G4", oracle=f"""
SELECT CAST(sum({_QTY}) AS DECIMAL(18,2)) AS decants, CAST(sum({_ML} * {_QTY}) AS DECIMAL(18,2)) AS ml_served
FROM {_DELIVERED_ITEMS}""")
def decants_served(spark, d):
    return S.decants_served(_oc(spark, d), D.f_items_core(spark, d))


@query("best_sellers", "O-G5", oracle=f"""
SELECT trim(i.name) AS perfume, CAST(sum({_QTY}) AS DECIMAL(18,2)) AS decants
FROM {_DELIVERED_ITEMS} GROUP BY trim(i.name) ORDER BY decants DESC, perfume LIMIT 10""")
def best_sellers(spark, d):
    return S.best_sellers(_oc(spark, d), D.f_items_core(spark, d), k=10, names=D.item_names(spark, d))


@query("monthly_revenue", "O-G6", oracle="""
SELECT date_trunc('month', delivered_at) AS month, CAST(sum(order_total) AS DECIMAL(18,2)) AS revenue,
       count(*) AS delivered_orders
FROM f_orders WHERE status = 'delivered' GROUP BY 1""")
def monthly_revenue(spark, d):
    return S.monthly_revenue(_oc(spark, d))


@query("orders_by_status", "O-G7", oracle="""
SELECT s.status, CAST(coalesce(c.n, 0) AS BIGINT) AS orders
FROM (SELECT unnest(['pending', 'preparing', 'ready', 'delivered', 'cancelled']) AS status) s
LEFT JOIN (SELECT status, count(*) AS n FROM f_orders GROUP BY status) c ON c.status = s.status""")
def orders_by_status(spark, d):
    return S.orders_by_status(spark, _oc(spark, d))


@query("sizes_chosen", "O-G8", oracle=f"""
SELECT CAST({_ML} AS DECIMAL(18,2)) AS ml, CAST(sum({_QTY}) AS DECIMAL(18,2)) AS decants
FROM {_DELIVERED_ITEMS} GROUP BY 1""")
def sizes_chosen(spark, d):
    return S.sizes_chosen(_oc(spark, d), D.f_items_core(spark, d))


@query("delivery_zones", "O-G9", oracle="""
SELECT delivery_zone, count(*) AS delivered_orders, CAST(sum(order_total) AS DECIMAL(18,2)) AS revenue
FROM f_orders WHERE status = 'delivered' GROUP BY delivery_zone""")
def delivery_zones(spark, d):
    return S.delivery_zones(_o(spark, d))


@query("repeat_customers", "O-G10", oracle="""
SELECT customer_id, count(*) AS delivered_orders, CAST(sum(order_total) AS DECIMAL(18,2)) AS spend
FROM f_orders WHERE status = 'delivered' AND customer_id IS NOT NULL GROUP BY customer_id HAVING count(*) >= 2""")
def repeat_customers(spark, d):
    return S.repeat_customers(_oc(spark, d))


@query("kpi_cube", "O-G11", oracle=f"""
SELECT date_trunc('month', o.created_at) AS month, o.delivery_zone, o.status,
       count(*) AS orders, CAST(sum(o.order_total) AS DECIMAL(18,2)) AS revenue,
       CAST(coalesce(sum(t.q), 0) AS DECIMAL(18,2)) AS decants, CAST(coalesce(sum(t.ml), 0) AS DECIMAL(18,2)) AS ml,
       CAST(grouping(date_trunc('month', o.created_at), o.delivery_zone, o.status) AS BIGINT) AS grouping_id
FROM f_orders o LEFT JOIN (SELECT i.order_id, sum({_QTY}) AS q, sum({_ML} * {_QTY}) AS ml FROM f_items i GROUP BY i.order_id) t
  ON t.order_id = o.id
GROUP BY CUBE (date_trunc('month', o.created_at), o.delivery_zone, o.status)""")
def kpi_cube(spark, d):
    return S.kpi_cube(_o(spark, d), D.f_items_core(spark, d))


@query("dashboard", "O-H1..O-H5", oracle="""
SELECT (SELECT count(*) FROM f_customers) AS customers,
       (SELECT CAST(coalesce(sum(total_spent), 0) AS DECIMAL(18,2)) FROM balances) AS accumulated_spend,
       (SELECT count(*) FROM members) AS works_discovered,
       (SELECT count(*) FROM f_codes WHERE CAST(created_at AS DATE) = (SELECT max(CAST(created_at AS DATE)) FROM f_codes)) AS codes_today,
       (SELECT count(*) FROM f_codes WHERE NOT is_redeemed) AS pending_codes""",
       extra_views={**LIFE_VIEWS, "balances": BALANCES_SQL})
def dashboard(spark, d):
    return S.dashboard(D.f_customers(spark, d), snapshot_balances(spark, d), _members(spark, d), D.f_codes_core(spark, d))


@query("orders_snapshot_delivered", "2.3-Sinks", oracle="""
SELECT CAST(date_trunc('month', created_at) AS DATE) AS month, count(*) AS delivered_orders,
       CAST(sum(order_total) AS DECIMAL(18,2)) AS revenue
FROM f_orders WHERE status = 'delivered' GROUP BY 1""")
def orders_snapshot_delivered(spark, d):
    """The order snapshot written as Parquet partitioned by (status, month) under the checkpoint
    folder, read back with a status filter that prunes to the delivered folders."""
    import uuid

    from decantry.session import ensure_checkpoint_dir
    from decantry.sources import snapshots as SN
    path = ensure_checkpoint_dir(spark).rstrip("/") + f"/orders-snapshot-{uuid.uuid4().hex[:12]}"
    core = D.f_orders_core(spark, d).select("id", "customer_id", "order_total", "status", "created_at")
    SN.write_snapshot(SN.with_order_layout(core), path)
    snap = SN.read_snapshot(spark, path).filter(F.col("status") == "delivered")
    return (snap.groupBy("month").agg(F.count(F.lit(1)).alias("delivered_orders"),
                                      F.sum("order_total").cast("decimal(18,2)").alias("revenue")))
