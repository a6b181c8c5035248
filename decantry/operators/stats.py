"""Statistics (O-G*) and dashboard figures (O-H*).

Economic metrics use delivered orders only. All sums are exact decimals; ratios are
rounded half-up in integer arithmetic (``exact_ratio``). Item metrics join items to
delivered order ids (semi-join), never the other way round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decantry.functions import exprs as X
from decantry.operators.orders import typed_items

REV = "decimal(18,2)"


def _delivered(orders: DataFrame) -> DataFrame:
    return orders.filter(F.col("status") == "delivered")


def delivered_items(orders: DataFrame, items: DataFrame) -> DataFrame:
    ids = _delivered(orders).select(F.col("id").alias("order_id"))
    return typed_items(items.join(ids, "order_id", "left_semi")).filter(~F.col("quarantine"))


def delivered_revenue(orders: DataFrame) -> DataFrame:
    return _delivered(orders).agg(F.sum("order_total").cast(REV).alias("revenue"),
                                  F.count(F.lit(1)).alias("delivered_orders"))


def average_ticket(orders: DataFrame) -> DataFrame:
    r = delivered_revenue(orders)
    return r.select("revenue", "delivered_orders",
                    X.exact_ratio(F.col("revenue"), F.col("delivered_orders"), 2).alias("average_ticket"))


def buyers_repeat_rate(orders: DataFrame) -> DataFrame:
    """Two-level aggregation (per customer, then global) instead of count(distinct)."""
    per = (_delivered(orders).filter(F.col("customer_id").isNotNull())
           .groupBy("customer_id").agg(F.count(F.lit(1)).alias("n")))
    g = per.agg(F.count(F.lit(1)).alias("buyers"), F.count(F.when(F.col("n") >= 2, True)).alias("repeat_buyers"))
    return g.select("buyers", "repeat_buyers", X.exact_ratio(F.col("repeat_buyers"), F.col("buyers"), 4).alias("repeat_rate"))


def decants_served(orders: DataFrame, items: DataFrame) -> DataFrame:
    it = delivered_items(orders, items)
    return it.agg(F.sum("qty_n").cast("decimal(18,2)").alias("decants"),
                  F.sum(F.col("ml") * F.col("qty_n")).cast("decimal(18,2)").alias("ml_served"))


def best_sellers(orders: DataFrame, items: DataFrame, k: int = 10, names: DataFrame | None = None) -> DataFrame:
    """Top-k perfumes by decants; ties by name. Partial aggregation absorbs hot names.
    With ``names`` (item_key -> name) quantities are summed per key before the name lookup."""
    it = delivered_items(orders, items)
    if names is not None:
        per_key = it.groupBy("item_key").agg(F.sum("qty_n").alias("_q"))
        it = per_key.join(names, "item_key").select(F.trim("name").alias("perfume"), F.col("_q").alias("qty_n"))
    agg = it.groupBy("perfume").agg(F.sum("qty_n").cast("decimal(18,2)").alias("decants"))
    return agg.orderBy(F.col("decants").desc(), F.col("perfume")).limit(k)


def monthly_revenue(orders: DataFrame) -> DataFrame:
    d = _delivered(orders).withColumn("month", F.date_trunc("month", F.col("delivered_at")).cast("timestamp_ntz"))
    return (d.groupBy("month").agg(F.sum("order_total").cast(REV).alias("revenue"),
                                   F.count(F.lit(1)).alias("delivered_orders")).orderBy("month"))


def orders_by_status(spark: SparkSession, orders: DataFrame) -> DataFrame:
    """Counts over all orders, with zero rows for statuses that have none (a 5-row domain)."""
    dom = spark.createDataFrame([(s,) for s in X.ORDER_STATUSES], "status string")
    counts = orders.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return (F.broadcast(dom).join(counts, "status", "left")
            .select("status", F.coalesce("n", F.lit(0)).cast("bigint").alias("orders")))


def sizes_chosen(orders: DataFrame, items: DataFrame) -> DataFrame:
    it = delivered_items(orders, items)
    return (it.groupBy(F.col("ml").cast("decimal(18,2)").alias("ml"))
            .agg(F.sum("qty_n").cast("decimal(18,2)").alias("decants")).orderBy(F.col("decants").desc(), "ml"))


def delivery_zones(orders: DataFrame) -> DataFrame:
    return (_delivered(orders).groupBy("delivery_zone")
            .agg(F.count(F.lit(1)).alias("delivered_orders"), F.sum("order_total").cast(REV).alias("revenue"))
            .orderBy(F.col("revenue").desc(), "delivery_zone"))


def repeat_customers(orders: DataFrame) -> DataFrame:
    per = (_delivered(orders).filter(F.col("customer_id").isNotNull()).groupBy("customer_id")
           .agg(F.count(F.lit(1)).alias("delivered_orders"), F.sum("order_total").cast(REV).alias("spend")))
    return per.filter(F.col("delivered_orders") >= 2).orderBy(F.col("spend").desc(), "customer_id")


def kpi_cube(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Revenue, orders, decants and ml by every combination of (month, zone, status).

    Two levels: orders are summed to (month, zone, status) first, with map-side combine, and
    the grouping sets run over those few rows, so that no order is expanded eight times.
    Items are aggregated per order before, so the join to orders is 1:1."""
    it = (typed_items(items).filter(~F.col("quarantine")).groupBy("order_id")
          .agg(F.sum("qty_n").alias("_q"), F.sum(F.col("ml") * F.col("qty_n")).alias("_ml")))
    dims = ["month", "delivery_zone", "status"]
    o = (orders.select(F.col("id").alias("order_id"), "delivery_zone", "status", "order_total",
                       F.date_trunc("month", F.col("created_at")).cast("timestamp_ntz").alias("month"))
         .join(it, "order_id", "left"))
    base = o.groupBy(*dims).agg(F.count(F.lit(1)).alias("_n"), F.sum("order_total").alias("_total"),
                                F.sum("_q").alias("_q"), F.sum("_ml").alias("_ml"))
    return (base.cube(*dims)
            .agg(F.sum("_n").alias("orders"), F.sum("_total").cast(REV).alias("revenue"),
                 F.coalesce(F.sum("_q"), F.lit(0)).cast("decimal(18,2)").alias("decants"),
                 F.coalesce(F.sum("_ml"), F.lit(0)).cast("decimal(18,2)").alias("ml"),
                 F.grouping_id().alias("grouping_id")))


def dashboard(customers: DataFrame, balances: DataFrame, members: DataFrame, codes: DataFrame) -> DataFrame:
    """One row of headline figures; each is a scalar subquery over its own table.
    "Codes today" counts codes created on the latest code date (``as_of`` **[choice]**)."""
    as_of = codes.select(F.max(F.to_date("created_at"))).scalar()
    base = customers.agg(F.count(F.lit(1)).alias("customers"))
    return base.select(
        "customers",
        balances.select(F.coalesce(F.sum("total_spent"), F.lit(0)).cast(REV)).scalar().alias("accumulated_spend"),
        members.select(F.count(F.lit(1))).scalar().alias("works_discovered"),
        codes.filter(F.to_date("created_at") == as_of).select(F.count(F.lit(1))).scalar().alias("codes_today"),
        codes.filter(~F.col("is_redeemed")).select(F.count(F.lit(1))).scalar().alias("pending_codes"))
