"""Order lifecycle, loyalty ledger and collection (O-B1..O-B4, O-B7..O-B10).

Status events ``(order_id, new_status, ts, seq)`` are applied per order in (ts, seq)
order. Everything here is set-based: per-order facts come from aggregates (which
combine map-side, so one order or customer with a huge history never lands whole
in one task), and transitions come from a chunked, skew-safe lag per order
(``operators/ordered.py``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decantry.functions import exprs as X
from decantry.operators.ordered import DEFAULT_CHUNK, clamped_totals, lag_by_key

DELIVERED = "delivered"
INITIAL_STATUS = "pending"   # status of an order before its first event (creation default)


def _key() -> Column:
    return F.struct(F.col("ts"), F.col("seq"))


# ---------------------------------------------------------------- O-B1
def validate_status_events(events: DataFrame, orders: DataFrame, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Status must be one of the five; the order must exist. Any -> any is allowed.

    ``parts`` lays both sides out in so many tasks by order. Ids compress to a small part of their
    size in memory, so a layout by shuffled bytes alone gives a task far more rows than it looks.
    """
    named = F.coalesce(F.col("new_status").isin(*X.ORDER_STATUSES), F.lit(False))
    asked, ids = events.filter(named), orders.select(F.col("id").alias("order_id"))
    if parts is not None:
        asked, ids = asked.repartition(parts, "order_id"), ids.repartition(parts, "order_id")
    unknown = asked.join(ids, "order_id", "left_anti").withColumn("reject_reason", F.lit("order_not_found"))
    return (asked.join(ids, "order_id", "left_semi"),
            events.filter(~named).withColumn("reject_reason", F.lit("invalid_status")).unionByName(unknown))


# ---------------------------------------------------------------- O-B2
def order_status_final(events: DataFrame) -> DataFrame:
    """Per order: final status, ``delivered_at`` = first event of the *current* delivered run
    (null unless delivered), ``updated_at`` = last event time.

    Gaps-and-islands without a window: the last non-delivered event bounds the final
    island, so the run start is ``min(ts)`` of delivered events after it.
    """
    per_order = (events.groupBy("order_id")
                 .agg(F.max_by("new_status", _key()).alias("status"),
                      F.max("ts").alias("updated_at"),
                      F.max(F.when(F.col("new_status") != DELIVERED, _key())).alias("_last_nd")))
    run = (events.filter(F.col("new_status") == DELIVERED)
           .join(per_order.select("order_id", "_last_nd"), "order_id")
           .filter(F.col("_last_nd").isNull() | (_key() > F.col("_last_nd")))
           .groupBy("order_id").agg(F.min("ts").alias("_run_start")))
    return (per_order.join(run, "order_id", "left")
            .select("order_id", "status",
                    F.when(F.col("status") == DELIVERED, F.col("_run_start")).alias("delivered_at"),
                    "updated_at"))


def transitions(events: DataFrame, initial_status: str = INITIAL_STATUS, unit: str = DEFAULT_CHUNK) -> DataFrame:
    """Each event with ``entered`` / ``left`` flags for the delivered state.

    The previous status comes from a chunked, skew-safe lag per order (``ordered.lag_by_key``).
    """
    prev = lag_by_key(events, "order_id", "new_status", "_prev", default=initial_status, unit=unit)
    return (prev.withColumn("entered", (F.col("new_status") == DELIVERED) & (F.col("_prev") != DELIVERED))
            .withColumn("left", (F.col("new_status") != DELIVERED) & (F.col("_prev") == DELIVERED))
            .drop("_prev"))


# ---------------------------------------------------------------- O-B3
def loyalty_balance(final_status: DataFrame, orders: DataFrame) -> DataFrame:
    """Balances (total_spent, bookmarks) implied by the final order states.

    Delivery adds the total and floor(total) *per order*; leaving delivered subtracts the
    same, clamped at 0. An order's minus always follows its own plus, so without
    absolute overrides the running sum never goes below 0 and the clamp never fires:
    the balance is a plain sum over currently delivered, non-guest orders.
    """
    delivered = final_status.filter(F.col("status") == DELIVERED).select(F.col("order_id").alias("id"))
    mine = orders.filter(F.col("customer_id").isNotNull()).join(delivered, "id", "left_semi")
    return (mine.groupBy("customer_id")
            .agg(F.sum("order_total").cast("decimal(18,2)").alias("total_spent"),
                 F.sum(F.floor("order_total")).cast("bigint").alias("bookmarks"),
                 F.count(F.lit(1)).alias("delivered_orders")))


def clamped_balance(deltas: DataFrame, overrides: DataFrame | None = None, value: str = "delta",
                    start: str = "start_value", unit: str = DEFAULT_CHUNK) -> DataFrame:
    """Exact ``b <- greatest(0, b + d)`` over ordered deltas per customer, with absolute overrides.

    Only deltas after a customer's last override (or all, starting at 0) matter. For a
    reflected walk starting at v: ``b_n = S_n - least(-v, min_k S_k)`` with S the prefix sums
    of the deltas; S_n and min S come from a chunked two-level prefix scan
    (``ordered.clamped_totals``), so one huge customer never sits in one window task.
    Inputs: deltas (customer_id, ts, seq, delta); overrides (customer_id, ts, seq, start_value).
    """
    d = deltas
    if overrides is not None:
        last = overrides.groupBy("customer_id").agg(F.max_by(F.struct(start, "ts", "seq"), _key()).alias("_o"))
        d = (d.join(last, "customer_id", "left")
             .filter(F.col("_o").isNull() | (_key() > F.struct(F.col("_o.ts"), F.col("_o.seq"))))
             .drop("_o"))
    tot = clamped_totals(d, "customer_id", value, unit=unit)
    if overrides is None:
        return tot.select("customer_id", (F.col("_sn") - F.least(F.lit(0), F.col("_smin"))).alias("balance"))
    starts = last.select("customer_id", F.col(f"_o.{start}").alias("_v"))
    res = (tot.join(starts, "customer_id", "full")
           .select("customer_id",
                   F.when(F.col("_sn").isNull(), F.col("_v"))
                    .otherwise(F.col("_sn") - F.least(-F.coalesce(F.col("_v"), F.lit(0)), F.col("_smin")))
                    .alias("balance")))
    return res


# ---------------------------------------------------------------- O-B4
def collection_members(final_status: DataFrame, orders: DataFrame, items: DataFrame) -> DataFrame:
    """(customer, perfume) pairs: some currently delivered, non-guest order contains the
    trimmed name. Valid when no manual unlocks or codes touched the library (else use the fold)."""
    delivered = final_status.filter(F.col("status") == DELIVERED).select(F.col("order_id").alias("id"))
    mine = (orders.filter(F.col("customer_id").isNotNull()).join(delivered, "id", "left_semi")
            .select(F.col("id").alias("order_id"), "customer_id"))
    names = items.select("order_id", X.blank_to_null("name").alias("perfume")).filter(F.col("perfume").isNotNull())
    return mine.join(names, "order_id").select("customer_id", "perfume").distinct()


# ---------------------------------------------------------------- O-B7
def apply_manual_unlocks(library: DataFrame, notifications: DataFrame, customers: DataFrame,
                         changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Manual unlock / lock batch. Returns (library, notifications, rejects).

    Per (customer, perfume), in seq order: unlock inserts with MANUAL-STUDIO, keeping an
    existing source; lock deletes the row and the unseen notifications. The batch result
    per key depends only on the last change and whether any lock occurred (a lock before
    the final unlock drops the old source), so it is two aggregates, no window.
    A new MANUAL notification appears when the final change is an unlock and either a lock
    happened or no unseen notification existed; its time is the first unlock after the
    last lock.
    """
    ids = customers.select(F.col("id").alias("customer_id")).withColumn("_known", F.lit(True))
    ch = changes.withColumn("perfume", F.trim("perfume")).join(ids, "customer_id", "left")
    reason = (F.when(F.col("_known").isNull(), F.lit("customer_not_found"))
              .when(X.is_blank("perfume"), F.lit("invalid_perfume")))
    ch = ch.withColumn("reject_reason", reason)
    rejects = ch.filter(F.col("reject_reason").isNotNull()).select("customer_id", "perfume", "seq", "reject_reason")
    ok = ch.filter(F.col("reject_reason").isNull())
    per_key = (ok.groupBy("customer_id", "perfume")
               .agg(F.max_by("unlocked", "seq").alias("_last_unlock"),
                    F.max(F.when(~F.col("unlocked"), F.col("seq"))).alias("_last_lock_seq")))
    first_unlock = (ok.filter("unlocked").join(per_key.select("customer_id", "perfume", "_last_lock_seq"),
                                               ["customer_id", "perfume"])
                    .filter(F.col("_last_lock_seq").isNull() | (F.col("seq") > F.col("_last_lock_seq")))
                    .groupBy("customer_id", "perfume").agg(F.min_by("ts", "seq").alias("_unlock_ts")))
    per_key = per_key.join(first_unlock, ["customer_id", "perfume"], "left")

    merged = (library.withColumn("_in_lib", F.lit(True)).join(per_key, ["customer_id", "perfume"], "full")
              .withColumn("_in_lib", F.coalesce(F.col("_in_lib"), F.lit(False))))
    untouched = F.col("_last_unlock").isNull()
    exists = F.when(untouched, F.col("_in_lib")).otherwise(F.col("_last_unlock"))
    source = (F.when(untouched, F.col("source_code"))
              .when(F.col("_last_lock_seq").isNotNull(), F.lit(X.MANUAL_SOURCE))
              .otherwise(F.coalesce(F.col("source_code"), F.lit(X.MANUAL_SOURCE))))
    new_lib = merged.filter(exists).select("customer_id", "perfume", source.alias("source_code"))

    unseen = (notifications.filter(F.col("seen_at").isNull())
              .groupBy("customer_id", "perfume").agg(F.lit(True).alias("_has_unseen")))
    touched = per_key.join(unseen, ["customer_id", "perfume"], "left")
    add = touched.filter(F.col("_last_unlock") & (F.col("_last_lock_seq").isNotNull() | F.col("_has_unseen").isNull()))
    new_notes = add.select(F.concat(F.lit("manual-"), F.col("customer_id").cast("string"), F.lit("-"),
                                    F.col("perfume")).alias("id"),
                           "customer_id", F.lit(None).cast(notifications.schema["order_id"].dataType).alias("order_id"),
                           "perfume", F.lit(X.MANUAL_NOTE_NUMBER).alias("order_number"),
                           F.lit(None).cast("timestamp_ntz").alias("seen_at"),
                           F.col("_unlock_ts").cast("timestamp_ntz").alias("created_at"))
    locked_keys = per_key.filter(F.col("_last_lock_seq").isNotNull()).select("customer_id", "perfume")
    kept = (notifications.join(locked_keys.withColumn("_locked", F.lit(True)), ["customer_id", "perfume"], "left")
            .filter(F.col("_locked").isNull() | F.col("seen_at").isNotNull()).drop("_locked"))
    return new_lib, kept.unionByName(new_notes.select(*kept.columns)), rejects


# ---------------------------------------------------------------- O-B8 / O-B9
def pending_notifications(profiles: DataFrame, notifications: DataFrame) -> DataFrame:
    """Unseen notifications of every customer who asked, oldest first; once a customer,
    however many of the requests were theirs."""
    me = profiles.filter("matched").select("customer_id").distinct()
    return (notifications.filter(F.col("seen_at").isNull()).join(me, "customer_id", "left_semi")
            .select("customer_id", "id", "perfume", "order_number", "created_at")
            .orderBy("customer_id", "created_at", "id"))


def mark_seen(profiles: DataFrame, notifications: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Set ``seen_at = coalesce(seen_at, request time)`` for listed ids owned by the caller.

    Returns (per-request updated counts, notifications after). The count includes rows
    already seen (the update touches them). Requests apply in seq order, so a row's
    new ``seen_at`` is the earliest request time that listed it.
    """
    me = profiles.filter("matched").select("request_id", "customer_id")
    ids = (requests.join(me, "request_id").select("request_id", "customer_id", "ts", "seq",
                                                   F.explode("ids").alias("id")).distinct())
    hits = ids.join(notifications.select("id", F.col("customer_id").alias("_owner")), "id")
    hits = hits.filter(F.col("customer_id") == F.col("_owner"))
    counts = (requests.select("request_id").join(hits.groupBy("request_id").agg(F.count(F.lit(1)).alias("updated")),
                                                 "request_id", "left")
              .select("request_id", F.coalesce("updated", F.lit(0)).cast("bigint").alias("updated")))
    first_seen = hits.groupBy("id").agg(F.min_by("ts", "seq").alias("_seen"))
    after = (notifications.join(first_seen, "id", "left")
             .withColumn("seen_at", F.coalesce(F.col("seen_at"), F.col("_seen").cast("timestamp_ntz"))).drop("_seen"))
    return counts, after


# ---------------------------------------------------------------- O-B10
LEVELS = ["Initiate", "Explorer", "Connoisseur", "Collector", "Curator"]   # [choice] quarter bands


def collection_completeness(customers: DataFrame, members: DataFrame, museum: DataFrame) -> DataFrame:
    """Discovered works over total works per customer; the total is a scalar subquery
    (grows with the museum), so no join is needed to attach it."""
    total = museum.select(F.count(F.lit(1))).scalar()
    counts = members.groupBy("customer_id").agg(F.count(F.lit(1)).alias("discovered"))
    disc = F.coalesce(F.col("discovered"), F.lit(0)).cast("bigint")
    band = F.least(F.lit(len(LEVELS) - 1), F.floor(disc * F.lit(len(LEVELS) - 1) / F.greatest(total, F.lit(1))).cast("int"))
    level = F.element_at(F.array(*[F.lit(x) for x in LEVELS]), band + 1)
    return (customers.select(F.col("id").alias("customer_id")).join(counts, "customer_id", "left")
            .select("customer_id", disc.alias("discovered"), total.cast("bigint").alias("total_works"),
                    X.exact_ratio(disc, total, 4).alias("progress"), level.alias("level")))
