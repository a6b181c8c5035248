"""Views of the driver's Parquet tables in the shop's data model (FIXTURES.md section 2).

Every view is a lazy DataFrame over the Parquet scan, so Catalyst prunes columns and
pushes filters of the operators that consume it into the scan. The DuckDB twin of each
view lives in ``decantry.plans.sql_views`` and must stay definition-for-definition equal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decantry.functions import exprs as X

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]

_MEMO: dict = {}


def memo_view(fn):
    """Build a view once per (session, folder): DataFrames are immutable, and reusing the same
    object lets later plans skip re-analysing it."""
    def wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (id(spark), sf_dir, fn.__module__, fn.__name__)
        df = _MEMO.get(key)
        if df is None or df.sparkSession is not spark:
            df = _MEMO[key] = fn(spark, sf_dir)
        return df
    wrapper.__name__, wrapper.__doc__, wrapper.__wrapped__ = fn.__name__, fn.__doc__, fn
    return wrapper


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def row_count(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Rows of a table, from the Parquet footers: the size of a key domain."""
    key = (id(spark), sf_dir, "row_count", name)
    if key not in _MEMO:
        _MEMO[key] = read(spark, sf_dir, name).count()
    return _MEMO[key]


def product_of(customer, place, parts: int):
    """The catalogue key that a customer's ``place`` names: eleven products each, so that orders
    share some, spread over the whole catalogue."""
    return (customer * 31 + place % 11) % parts


def _ts(text: str):
    return F.lit(text).cast("timestamp_ntz")


def catalog_name(name_col, key_col):
    """Catalogue names must be unique: p_name alone repeats, so the key is appended."""
    return F.concat(name_col, F.lit(" #"), key_col.cast("string"))


@memo_view
def f_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    price = X.money("p_retailprice")

    def pr(factor: str):
        v = F.round(price * F.lit(factor).cast("decimal(3,2)"), 2).cast("decimal(10,2)")
        return F.when(k % 10 == 0, F.lit(None).cast("decimal(10,2)")).otherwise(v)

    status = F.when(k % 10 == 0, "upcoming").when(k % 10 == 1, "hidden").otherwise("published")
    return read(spark, sf_dir, "part").select(
        k.alias("id"),
        catalog_name(F.col("p_name"), k).alias("name"),
        F.col("p_brand").alias("brand"),
        pr("0.01").alias("price_2ml"), pr("0.02").alias("price_3ml"),
        pr("0.03").alias("price_5ml"), pr("0.05").alias("price_10ml"),
        status.alias("availability_status"),
        (k % 10 != 1).alias("active"),
        F.when(k % 50 == 7, _ts("2001-01-01 00:00:00")).alias("deleted_at"),
        F.when(k % 7 == 0, F.lit(None).cast("decimal(10,2)"))
         .otherwise((F.lit(500) + F.lit(100) * (k % 20)).cast("decimal(10,2)")).alias("stock_initial_ml"),
        F.lit(15).cast("decimal(10,2)").alias("low_stock_threshold_ml"),
        F.lit(1000).alias("display_order"),
        F.timestamp_add("MINUTE", k, _ts("2000-01-01 00:00:00")).alias("created_at"),
        F.when(F.col("p_size") > 25, F.concat(F.lit("img/"), k.cast("string"), F.lit(".webp"))).alias("image_url"),
        F.col("p_type").alias("description"),
        F.split("p_name", " ").alias("accords"), F.split("p_type", " ").alias("notes"),
        F.when(F.col("p_size") % 2 == 0, F.lower("p_brand")).alias("journey_theme"),
        F.concat(F.lit("Journey "), F.col("p_name")).alias("journey_title"),
        F.when(F.col("p_size") > 10, F.concat_ws(" · ", "p_type", "p_name")).alias("journey_copy"),
    )


@memo_view
def f_items_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat order items keyed by the catalogue key (no name): what size/quantity metrics need.
    ``item_names`` maps the key to the item name."""
    ln = F.col("l_linenumber")
    size = F.when(ln % 4 == 0, "2 ml").when(ln % 4 == 1, "3 ml").when(ln % 4 == 2, "5 ml").otherwise("10 ml")
    qty = F.when(ln == 7, F.lit("")).otherwise(F.col("l_quantity").cast("bigint").cast("string"))
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), ln.alias("line"), F.col("l_partkey").alias("item_key"),
        size.alias("size"), qty.alias("qty"))


@memo_view
def item_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_key -> item name (the catalogue name of the part)."""
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_key"),
                                              catalog_name(F.col("p_name"), F.col("p_partkey")).alias("name"))


@memo_view
def f_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat order items with names: the silver form of the orders' ``items`` array."""
    core = f_items_core(spark, sf_dir)
    names = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    return (core.join(names, core.item_key == names.p_partkey, "left")
            .select("order_id", "line", catalog_name(F.col("p_name"), F.col("item_key")).alias("name"),
                    "size", "qty"))


def _order_status():
    """``delivered`` is tested first on its own so ``status = 'delivered'`` folds to
    ``o_orderstatus = 'F'``, which the Parquet scan can push down."""
    st, pri = F.col("o_orderstatus"), F.col("o_orderpriority")
    rest = (F.when((st == "P") & (pri == "1-URGENT"), "ready")
            .when(st == "P", "preparing")
            .when((st == "O") & (pri == "5-LOW"), "cancelled")
            .when(st == "O", "pending"))
    return F.when(st.eqNullSafe("F"), F.lit("delivered")).otherwise(rest)


@memo_view
def f_orders_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order headers from ``orders`` alone (no customer/nation join): what status, stock and
    money operators need. ``f_orders`` adds the name/phone/zone columns."""
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    status = _order_status()
    guest = k % 11 == 0
    settings = row_count(spark, sf_dir, "supplier")
    named = lambda place: F.concat(F.lit("reward-"), (place % settings).cast("string"))
    rewards = (F.when(F.col("o_orderpriority") == "1-URGENT", F.array(named(k)))
               .when(F.col("o_orderpriority") == "2-HIGH", F.array(named(k * 7), named(k * 7 + 1)))
               .otherwise(F.array().cast("array<string>")))
    return o.select(k.alias("id"),
                    F.concat(F.lit("P-"), F.lpad(k.cast("string"), 8, "0")).alias("order_number"),
                    F.when(guest, F.lit(None).cast("bigint")).otherwise(F.col("o_custkey")).alias("customer_id"),
                    F.col("o_custkey").alias("_buyer"),
                    F.lit(None).cast("string").alias("notes"),
                    rewards.alias("reward_ids"),
                    X.money("o_totalprice").alias("order_total"),
                    status.alias("status"),
                    F.when((F.col("o_orderstatus") == "F") & ~guest, F.col("o_orderdate")).alias("accounted_at"),
                    F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("delivered_at"),
                    F.col("o_orderdate").alias("created_at"),
                    F.col("o_orderdate").alias("updated_at"))


@memo_view
def f_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order headers with customer name, phone and delivery zone (no items column; join
    ``f_items`` or use ``f_orders_nested``)."""
    core = f_orders_core(spark, sf_dir)
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (core.join(c, core._buyer == c.c_custkey, "left")
            .join(n, F.col("c_nationkey") == n.n_nationkey, "left")
            .select("id", "order_number", "customer_id",
                    F.col("c_name").alias("customer_name"),
                    F.concat(F.lit("+34 600 "), F.lpad(F.col("_buyer").cast("string"), 6, "0")).alias("customer_phone"),
                    F.col("n_name").alias("delivery_zone"),
                    "notes", "reward_ids", "order_total", "status", "accounted_at", "delivered_at",
                    "created_at", "updated_at"))


def nest_items(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Attach ``items: array<struct<name,size,qty>>`` (ordered by line) to each order.

    Items are pre-aggregated per order before the join, so the join is 1:1 and
    orders without lines get an empty array.
    """
    per_order = (items.groupBy("order_id")
                 .agg(F.array_sort(F.collect_list(F.struct("line", "name", "size", "qty"))).alias("_its")))
    joined = orders.join(per_order, orders.id == per_order.order_id, "left").drop("order_id")
    nested = F.transform(F.coalesce(F.col("_its"), F.array()),
                         lambda s: F.struct(s["name"].alias("name"), s["size"].alias("size"), s["qty"].alias("qty")))
    return joined.withColumn("items", nested).drop("_its")


@memo_view
def f_orders_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nest_items(f_orders(spark, sf_dir), f_items(spark, sf_dir))


@memo_view
def f_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(
        k.alias("id"),
        F.col("c_name").alias("customer_name"),
        F.concat(F.lit("+34 600 "), F.lpad(k.cast("string"), 6, "0")).alias("customer_phone"),
        F.concat(F.lit("tok-"), k.cast("string")).alias("access_token"),
        F.timestamp_add("MINUTE", k, _ts("1995-01-01 00:00:00")).alias("created_at"),
        (F.col("c_acctbal") >= 0).alias("ranking_opt_in"),
        F.col("c_mktsegment").alias("segment"),
    )


@memo_view
def f_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reward settings: one per supplier, so the settings table grows with the data.

    threshold = 300000 + 100000 * (s_suppkey % 23) (the reference's 30/75/150/250 bookmarks scaled
    to the driver's order totals); inactive when the supplier balance is negative.
    """
    k = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(
        F.concat(F.lit("reward-"), k.cast("string")).alias("id"),
        (F.lit(300000) + F.lit(100000) * (k % 23)).cast("int").alias("threshold"),
        F.concat(F.lit("Discovery "), F.col("s_name")).alias("reward_label"),
        (F.col("s_acctbal") >= 0).alias("active"),
        ((k % 4) * 10).cast("int").alias("sort_order"),
        F.timestamp_add("MINUTE", k, _ts("2002-01-01 00:00:00")).alias("updated_at"),
    )


def _lifecycle_order_attrs(oid, customer, parts: int):
    """Attributes of a lifecycle order, all functions of its id and customer (FIXTURES.md section 2)."""
    total = (((oid * 37) % 9973).cast("decimal(12,0)") / F.lit(100)).cast(X.MONEY)
    keys = F.array(*[product_of(customer, oid * 7 + j * 13, parts) for j in range(3)])
    return total, keys


def status_events_of(e: DataFrame, parts: int) -> DataFrame:
    """Map raw events (batch or streaming) to status changes of the lifecycle model; ``parts``
    is the number of catalogue products."""
    oid = F.col("user_id") * 20 + F.col("event_id") % 20
    et = F.col("event_type")
    status = (F.when(et == "purchase", "delivered").when(et == "view", "preparing")
              .when(et == "click", "ready").when(et == "signup", "pending")
              .when(et == "error", "cancelled"))
    total, keys = _lifecycle_order_attrs(oid, F.col("user_id"), parts)
    return e.select(oid.alias("order_id"), F.col("user_id").alias("customer_id"),
                    status.alias("new_status"), F.col("ts"), F.col("event_id").alias("seq"),
                    total.alias("order_total"), keys.alias("perfume_keys"),
                    F.concat(F.lit("P-"), F.lpad(oid.cast("string"), 8, "0")).alias("order_number"))


@memo_view
def f_status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status changes of the lifecycle model (one order has exactly one customer)."""
    return status_events_of(read(spark, sf_dir, "events"), row_count(spark, sf_dir, "part"))


def event_arrivals(spark: SparkSession, sf_dir: str, folder: str, batches: int = 8) -> int:
    """Lay the events out under ``folder`` as ``batches`` arrivals, one after another in time
    (bounds are quantiles of ``ts``, so equal times arrive together); returns the files of each."""
    e = read(spark, sf_dir, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    bounds = e.select(at.cast("double").alias("t")).approxQuantile("t", [k / batches for k in range(1, batches)], 0.001)
    files = max(1, e.rdd.getNumPartitions() // batches)
    for low, high in zip([None, *bounds], [*bounds, None]):
        part = e if low is None else e.filter(at > F.lit(low))
        part = part if high is None else part.filter(at <= F.lit(high))
        part.repartition(files).write.mode("append").parquet(folder)
    return files


def stream_events(spark: SparkSession, sf_dir: str, folder: str, files: int) -> DataFrame:
    """The arrivals as a file stream, ``files`` a micro-batch (schema taken from the table, never
    inferred per batch)."""
    return spark.readStream.schema(read(spark, sf_dir, "events").schema).option("maxFilesPerTrigger", files).parquet(folder)


@memo_view
def f_lifecycle_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of the lifecycle model: id, customer, total, created_at (first event)."""
    ev = f_status_events(spark, sf_dir)
    base = ev.groupBy("order_id", "customer_id").agg(F.min("ts").alias("created_at"))
    total, _ = _lifecycle_order_attrs(F.col("order_id"), F.col("customer_id"), row_count(spark, sf_dir, "part"))
    return base.select(F.col("order_id").alias("id"), "customer_id", total.alias("order_total"), "created_at",
                       F.concat(F.lit("P-"), F.lpad(F.col("order_id").cast("string"), 8, "0")).alias("order_number"))


@memo_view
def f_lifecycle_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat items (order_id, name) of the lifecycle orders: three catalogue keys per order."""
    orders = f_lifecycle_orders(spark, sf_dir).select(F.col("id").alias("order_id"), "customer_id")
    _, keys = _lifecycle_order_attrs(F.col("order_id"), F.col("customer_id"), row_count(spark, sf_dir, "part"))
    cat = (f_catalog(spark, sf_dir)
           .select(F.col("id").alias("pk"), "name"))
    return (orders.select("order_id", F.explode(keys).alias("pk"))
            .join(cat, "pk", "left").select("order_id", "name"))


@memo_view
def f_codes_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes without names and perfumes: what counts and lists by customer need, from ``orders`` alone."""
    o = f_orders_core(spark, sf_dir)
    return o.select(F.concat(F.lit("PR-"), F.upper(F.substring(F.sha2(F.col("order_number"), 256), 1, 10))).alias("code"),
                    F.concat(F.lit("+34 600 "), F.lpad(F.col("_buyer").cast("string"), 6, "0")).alias("customer_phone"),
                    "order_number", "order_total", F.floor("order_total").cast("int").alias("bookmarks_awarded"),
                    (F.col("id") % 10 == 0).alias("is_redeemed"), "created_at")


@memo_view
def f_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One code per order; redeemed when o_orderkey % 10 = 0."""
    o = f_orders(spark, sf_dir)
    names = (f_items(spark, sf_dir).groupBy("order_id")
             .agg(F.array_sort(F.collect_set(F.trim("name"))).alias("perfumes")))
    return (o.join(names, o.id == names.order_id, "left")
            .select(F.concat(F.lit("PR-"), F.upper(F.substring(F.sha2(F.col("order_number"), 256), 1, 10))).alias("code"),
                    "customer_name", "customer_phone", "order_number", "order_total",
                    F.coalesce(F.col("perfumes"), F.array().cast("array<string>")).alias("perfumes"),
                    F.floor("order_total").cast("int").alias("bookmarks_awarded"),
                    (F.col("id") % 10 == 0).alias("is_redeemed"),
                    F.col("created_at")))


@memo_view
def f_museum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Museum works: every catalogue product gets a work (creation upserts one); accords are
    the words of p_name. Empty artwork_path means the artwork is still missing."""
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        catalog_name(F.col("p_name"), k).alias("perfume_name"),
        F.col("p_brand").alias("brand"),
        F.when(F.col("p_size") % 3 == 0, F.lit("")).otherwise(
            F.concat(F.lit("assets/artworks/"), k.cast("string"), F.lit(".webp"))).alias("artwork_path"),
        F.concat(F.col("p_type"), F.lit(" "), F.col("p_name")).alias("description"),
        (F.col("p_size") > 5).alias("published"),
        F.split(F.col("p_name"), " ").alias("accords"),
        F.split(F.col("p_type"), " ").alias("notes"),
        F.timestamp_add("MINUTE", k, _ts("2002-01-01 00:00:00")).alias("updated_at"),
    )


@memo_view
def f_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artwork notifications (one per event); 'view' and 'click' ones have been seen."""
    e = read(spark, sf_dir, "events")
    cat = f_catalog(spark, sf_dir).select(F.col("id").alias("_pk"), F.col("name").alias("perfume"))
    oid = F.col("user_id") * 20 + F.col("event_id") % 20
    base = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("customer_id"), oid.alias("order_id"),
                    product_of(F.col("user_id"), F.col("event_id"), row_count(spark, sf_dir, "part")).alias("_pk"),
                    F.concat(F.lit("P-"), F.lpad(oid.cast("string"), 8, "0")).alias("order_number"),
                    F.when(F.col("event_type").isin("view", "click"), F.col("ts")).alias("seen_at"),
                    F.col("ts").alias("created_at"))
    return base.join(cat, "_pk", "left").select("id", "customer_id", "order_id", "perfume", "order_number",
                                                "seen_at", "created_at")
