"""Orders: ingest, numbering, listings, profile matching, items, historic imports (O-A*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from decantry.functions import exprs as X
from decantry.session import cut_lineage

ITEM_SCHEMA = T.ArrayType(T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("size", T.StringType()),
    T.StructField("qty", T.StringType()),   # JSON numbers arrive as text, like ->> does
]))

ORDER_LIST_COLUMNS = ["id", "order_number", "customer_id", "customer_name", "customer_phone",
                      "delivery_zone", "notes", "items", "reward_ids", "order_total", "status",
                      "accounted_at", "delivered_at", "created_at", "updated_at"]

HISTORY_COLUMNS = ["id", "order_number", "delivery_zone", "items", "order_total", "status",
                   "created_at", "updated_at", "delivered_at"]


# ---------------------------------------------------------------- O-A6 items
def typed_items(items: DataFrame, name: str = "name", size: str = "size", qty: str = "qty") -> DataFrame:
    """Add ``perfume`` (trimmed name), ``ml``, ``qty_n`` and a ``quarantine`` flag to flat items.

    Unparseable sizes/quantities ('1.2.3', '.') make the whole reference call fail;
    here the item is flagged and excluded from sums instead.
    """
    named = [F.trim(F.col(name)).alias("perfume")] if name in items.columns else []
    return items.select(
        "*", *named,
        X.size_ml(size).alias("ml"),
        X.qty_value(qty).alias("qty_n"),
        (X.size_is_bad(size) | X.qty_is_bad(qty)).alias("quarantine"),
    )


def explode_items(orders: DataFrame, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """One row per element of ``items`` (empty arrays give no rows), typed per section 1.3.

    Only ``keep`` columns and the three item fields are carried through the Generate,
    so the scan below stays pruned.
    """
    flat = (orders.select(*keep, F.explode("items").alias("it"))
            .select(*keep, F.col("it.name").alias("name"), F.col("it.size").alias("size"),
                    F.col("it.qty").alias("qty")))
    return typed_items(flat)


def with_stored_items(orders: DataFrame, items_json: str = "items_json") -> DataFrame:
    """``items_json`` (an order's items as JSON text) replaced by ``items``, typed for the store.

    Each item keeps its texts beside ``perfume``, ``ml`` and ``qty_n``. One that is no object, or
    whose size or quantity does not parse, is also kept as it came in ``rescued`` (its numbers
    are those of an empty text); it does not touch the items beside it. Text that is no array
    gives no items. Typed once here, items are read back by ``explode_stored_items`` without
    parsing, and without a shuffle."""
    def parts(e):
        return F.struct(e.alias("text"), F.when(e.startswith("{"), F.from_json(e, ITEM_SCHEMA.elementType)).alias("i"))

    def typed(x):
        i = x["i"]
        bad = i.isNull() | X.size_is_bad(i["size"]) | X.qty_is_bad(i["qty"])
        return F.struct(i["name"].alias("name"), i["size"].alias("size"), i["qty"].alias("qty"), F.trim(i["name"]).alias("perfume"),
                        X.size_ml(i["size"]).alias("ml"), X.qty_value(i["qty"]).alias("qty_n"),
                        F.when(bad, F.coalesce(x["text"], F.lit("null"))).alias("rescued"))

    # Element by element: one that does not fit would null the whole array.
    texts = F.when(F.json_array_length(items_json).isNotNull(), F.from_json(F.col(items_json), T.ArrayType(T.StringType())))
    items = F.transform(F.transform(F.coalesce(texts, F.array().cast("array<string>")), parts), typed)
    return orders.withColumn("items", items).drop(items_json)


def explode_stored_items(orders: DataFrame, keep: tuple[str, ...] = ("id",),
                         fields: tuple[str, ...] = ("perfume", "ml", "qty_n", "rescued")) -> DataFrame:
    """One row per stored item with ``quarantine`` (it was rescued); the scan reads only the
    named fields of the items."""
    # Zipped field by field: of an exploded struct with several fields used the scan would read all.
    flat = (orders.select(*keep, F.explode(F.arrays_zip(*[F.col(f"items.{f}") for f in fields])).alias("it"))
            .select(*keep, *[F.col(f"it.{f}").alias(f) for f in fields]))
    return flat.withColumn("quarantine", F.col("rescued").isNotNull()) if "rescued" in fields else flat


# ---------------------------------------------------------------- O-A1 ingest
def ingest_orders(raw: DataFrame) -> DataFrame:
    """Validate raw order requests (``items_json`` is the request's JSON text).

    Returns every request with ``reject_reason`` (null when accepted) and the
    normalised order fields; split with ``.filter(reject_reason.isNull())``.
    """
    parsed = F.from_json(F.col("items_json"), ITEM_SCHEMA)
    # json_array_length is null unless the text is a JSON array (from_json would wrap a
    # lone object into a one-element array; the reference rejects any non-array).
    n_items = F.json_array_length("items_json")
    total = X.amount("order_total")   # judged as it came; rounded once, on the way out
    no_total = F.col("order_total").isNull()
    reason = (F.when(X.is_blank("customer_name"), F.lit("name_required"))
              .when(X.is_blank("delivery_zone"), F.lit("zone_required"))
              .when(n_items.isNull() | (n_items <= 0), F.lit("empty_order"))
              .when(~no_total & (total.isNull() | X.is_negative("order_total") | (F.round(total, 2) >= F.lit(10 ** 8))),
                    F.lit("invalid_total"))
              .when(no_total, F.lit("total_required")))
    return raw.select(
        "request_id",
        reason.alias("reject_reason"),
        F.col("customer_id"),
        F.trim("customer_name").alias("customer_name"),
        X.blank_to_null("customer_phone").alias("customer_phone"),
        F.trim("delivery_zone").alias("delivery_zone"),
        X.blank_to_null("notes").alias("notes"),
        parsed.alias("items"),
        F.coalesce(F.col("reward_ids"), F.array().cast("array<string>")).alias("reward_ids"),
        X.money_once("order_total").alias("order_total"),     # null for rejected overflow
        F.lit("pending").alias("status"),
        F.col("created_at"),
    )


# ---------------------------------------------------------------- O-A2 numbering
def number_orders(orders: DataFrame, order_cols: tuple[str, ...] = ("created_at", "id"),
                  start: int = 1, num_partitions: int | None = None) -> DataFrame:
    """Assign dense order numbers ``P-00001``... in ``order_cols`` order, without a global window.

    Range-partition on the sort key and sort within partitions, then checkpoint: partition
    contents and order are fixed from here on (and survive executor loss). On the
    checkpointed rows ``monotonically_increasing_id`` carries the partition index in its
    high bits and the row's position in its low 33 bits, so per-partition counts give
    offsets (a frame with one row per partition, broadcast) and each row's number is
    offset + position: no shuffle of the orders after the range partitioning.
    """
    n = num_partitions or int(orders.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in order_cols]
    ranged = cut_lineage(orders.repartitionByRange(n, *keys).sortWithinPartitions(*keys))
    tagged = ranged.withColumn("_mid", F.monotonically_increasing_id())
    tagged = (tagged.withColumn("_pid", F.shiftright("_mid", 33))
              .withColumn("_pos", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))))
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: a bounded frame, so an unpartitioned window is fine here.
    offsets = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    seq = F.col("_off") + F.col("_pos") + F.lit(start)
    return (tagged.join(F.broadcast(offsets), "_pid")
            .withColumn("seq", seq.cast("bigint"))
            .withColumn("order_number", X.order_number(F.col("seq")))
            .drop("_mid", "_pid", "_pos", "_off"))


# ---------------------------------------------------------------- O-A3 / O-A4 listings
def list_orders(orders: DataFrame) -> DataFrame:
    """All orders newest first; ties broken by order_number **[choice]**."""
    cols = [c for c in ORDER_LIST_COLUMNS if c in orders.columns]
    return orders.select(*cols).orderBy(F.col("created_at").desc(), F.col("order_number").asc())


def customer_order_history(orders: DataFrame, customer_ids: DataFrame, id_col: str = "customer_id") -> DataFrame:
    """Orders of the given customers (a semi-join: one id or millions), newest first per customer.

    The order is a global sort on (customer, created_at desc, order_number): range
    partitioning splits even a very large customer's history across tasks, which a
    window partitioned by customer could not.
    """
    ids = customer_ids.select(F.col(id_col).alias("customer_id")).distinct()
    mine = orders.join(ids, "customer_id", "left_semi")
    cols = [c for c in HISTORY_COLUMNS if c in orders.columns]
    return (mine.select("customer_id", *cols)
            .orderBy(F.col("customer_id"), F.col("created_at").desc(), F.col("order_number")))


# ---------------------------------------------------------------- O-A5 profiles
def resolve_profiles(credentials: DataFrame, customers: DataFrame) -> DataFrame:
    """Match (phone, token) requests to customers on digits-only phone **and** token.

    The first match by (created_at, id) wins **[choice]**; unmatched requests keep a
    null ``customer_id`` and ``matched = false`` (the reference raises an error).
    """
    cred = credentials.select("request_id", X.phone_digits("phone").alias("_ph"), F.col("token").alias("_tok"))
    cust = customers.select(F.col("id").alias("customer_id"), X.stored_digits("customer_phone").alias("_ph"),
                            F.col("access_token").alias("_tok"), F.col("created_at").alias("_c"))
    hits = (cred.join(cust, ["_ph", "_tok"], "inner")
            .groupBy("request_id")
            .agg(F.min_by("customer_id", F.struct("_c", "customer_id")).alias("customer_id")))
    return (credentials.select("request_id").join(hits, "request_id", "left")
            .select("request_id", "customer_id", F.col("customer_id").isNotNull().alias("matched")))


def orders_for_credentials(credentials: DataFrame, customers: DataFrame, orders: DataFrame) -> DataFrame:
    """O-A5 then O-A4: the orders of every customer who logged in, newest first.

    A customer's history comes once however often they logged in; ``resolve_profiles`` says
    which request was whose.
    """
    prof = resolve_profiles(credentials, customers).filter("matched").select("customer_id").distinct()
    return customer_order_history(orders, prof)


# ---------------------------------------------------------------- O-A7 rewards on orders
def rewards_on_orders(orders: DataFrame, rewards: DataFrame) -> DataFrame:
    """How often each reward was chosen in a cart **[choice]**; unknown ids are kept with null label."""
    chosen = orders.select(F.explode("reward_ids").alias("reward_id"))
    counts = chosen.groupBy("reward_id").agg(F.count(F.lit(1)).alias("n_orders"))
    r = rewards.select(F.col("id").alias("reward_id"), "reward_label", "threshold")
    return counts.join(r, "reward_id", "left")


# ---------------------------------------------------------------- O-A8 historic imports
def import_historic(orders: DataFrame, imports: DataFrame, customers: DataFrame) -> DataFrame:
    """Insert historic orders whose number is absent (of imports with one number the first by
    ``seq`` **[choice]**); link the earliest customer whose ``lower(name)`` starts with the
    import's prefix (null when none).

    The prefix test is an equi-join: each customer's name gives its own prefixes (as many as
    it has characters), those that some import uses are kept and reduced to the earliest
    customer per prefix.
    """
    fresh = imports.join(orders.select("order_number"), "order_number", "left_anti")
    fields = ["prefix", "customer_name", "delivery_zone", "notes", "order_total"]
    fresh = (fresh.groupBy("order_number").agg(F.min_by(F.struct(*fields), F.col("seq")).alias("_i"))
             .select("order_number", *[F.col(f"_i.{c}").alias(c) for c in fields]))
    lname = F.lower("customer_name")
    cust = customers.select(F.col("id").alias("_cid"), F.col("created_at").alias("_c"),
                            F.explode(F.transform(F.sequence(F.lit(0), F.char_length(lname)),
                                                  lambda k: F.substr(lname, F.lit(1), k))).alias("prefix"))
    keyed = (cust.join(fresh.select("prefix").distinct(), "prefix", "left_semi").groupBy("prefix")
             .agg(F.min_by("_cid", F.struct("_c", "_cid")).alias("customer_id")))
    return (fresh.join(keyed, "prefix", "left")
            .select("order_number", "customer_id", "customer_name", "delivery_zone", "notes",
                    F.array().cast(ITEM_SCHEMA).alias("items"), X.money_once("order_total").alias("order_total"),
                    F.lit("pending").alias("status")))
