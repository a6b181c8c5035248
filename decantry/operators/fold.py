"""Exact, path-dependent collection ownership (O-B5) and unlock notifications (O-B6).

Which order "owns" a (customer, perfume) library row depends on the history: the first
deliverer owns it; when the owner leaves delivered, ownership moves to the customer's
other delivered order with that perfume having the latest delivered_at, then latest
created_at; with none left, the row is deleted. A notification is created per real
insert and every notification of an order is deleted when that order leaves delivered.

Ownership of (c, p) depends only on transitions of c's orders that contain p, so the
fold is keyed by (customer, perfume). Spark hash-partitions on that key and sorts each
partition by (key, ts, seq); ``mapInPandas`` then walks the sorted rows carrying only
the current key's state, so a task's memory is bounded by one key's live orders, never
by the size of a group; a key too long for one task goes to ``hot_fold``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decantry.functions import exprs as X
from decantry.operators.hot_fold import hot_fold
from decantry.operators.lifecycle import transitions
from decantry.session import cut_lineage, ship_package

FOLD_OUTPUT_SCHEMA = ("record string, customer_id bigint, perfume string, order_id bigint, "
                      "order_number string, source_code string, created_at timestamp_ntz")


ROWS_A_TASK = 250_000      # steps of one key that a task walks alone
MANUAL_OWNER = -1          # owner marker of a row inserted by a manual unlock


@dataclass
class KeyState:
    """State of one (customer, perfume): delivered orders containing it, owner, live notifications.

    ``owner`` is an order id, ``MANUAL_OWNER`` for a manually unlocked row, or None (no row).
    Notifications of manual unlocks are keyed by None (they belong to no order).
    """
    delivered: dict = field(default_factory=dict)      # order_id -> (delivered_at, created_at, order_number)
    owner: int | None = None
    notes: dict = field(default_factory=dict)          # order_id|None -> (order_number, created_at)

    def enter(self, order_id, ts, created_at, order_number):
        self.delivered[order_id] = (ts, created_at, order_number)
        if self.owner is None:                          # insert ... on conflict do nothing
            self.owner = order_id
            self.notes[order_id] = (order_number, ts)

    def leave(self, order_id):
        self.delivered.pop(order_id, None)
        self.notes.pop(order_id, None)                   # all of the order's notifications go
        if self.owner == order_id:
            if self.delivered:
                # latest delivered_at (nulls last), then latest created_at; order_number breaks ties [choice]
                def rank(item):
                    _, (d_at, c_at, num) = item
                    return (d_at is not None, d_at or pd.Timestamp.min, c_at or pd.Timestamp.min, num or "")
                self.owner = max(self.delivered.items(), key=rank)[0]
            else:
                self.owner = None

    def unlock(self, ts):
        """Manual unlock: insert with the manual source if absent (an existing source stays);
        add a notification unless one is still pending for this key."""
        if self.owner is None:
            self.owner = MANUAL_OWNER
        if not self.notes:
            self.notes[None] = (X.MANUAL_NOTE_NUMBER, ts)

    def lock(self):
        """Manual lock: the row and its pending notifications go; delivered orders stay."""
        self.owner = None
        self.notes.clear()

    def rows(self, customer_id, perfume):
        out = []
        if self.owner == MANUAL_OWNER:
            out.append(("library", customer_id, perfume, None, None, X.MANUAL_SOURCE, None))
        elif self.owner is not None:
            num = self.delivered[self.owner][2]
            out.append(("library", customer_id, perfume, self.owner, num, X.ORDER_SOURCE_PREFIX + num, None))
        for oid, (num, ts) in self.notes.items():
            out.append(("notification", customer_id, perfume, oid, num, None, ts))
        return out


def _fold_sorted(batches):
    """mapInPandas body: rows arrive sorted by (customer_id, perfume, ts, seq, kind rank).
    Columns are walked as plain lists (cheaper than per-row tuples)."""
    cols = ["record", "customer_id", "perfume", "order_id", "order_number", "source_code", "created_at"]
    key, state = None, None
    for pdf in batches:
        out = []
        rows = zip(pdf["customer_id"].tolist(), pdf["perfume"].tolist(), pdf["kind"].tolist(),
                   pdf["order_id"].astype("Int64").tolist(), pdf["ts"].tolist(), pdf["created_at"].tolist(),
                   pdf["order_number"].tolist())
        for cust, perfume, kind, order_id, ts, created_at, number in rows:
            k = (cust, perfume)
            if k != key:
                if state is not None:
                    out.extend(state.rows(*key))
                key, state = k, KeyState()
            if kind == "enter":
                state.enter(order_id, ts, created_at, number)
            elif kind == "leave":
                state.leave(order_id)
            elif kind == "unlock":
                state.unlock(ts)
            else:
                state.lock()
        if out:
            yield pd.DataFrame(out, columns=cols)
    if state is not None:
        yield pd.DataFrame(state.rows(*key), columns=cols)


def delivered_transitions(events: DataFrame, orders: DataFrame, items: DataFrame) -> DataFrame:
    """Enter/leave-delivered transitions of non-guest orders, one row per distinct perfume."""
    tr = (transitions(events).filter(F.col("entered") | F.col("left"))
          .select("order_id", "ts", "seq", "entered"))
    heads = (orders.filter(F.col("customer_id").isNotNull())
             .select(F.col("id").alias("order_id"), "customer_id", "order_number", "created_at"))
    names = (items.select("order_id", X.blank_to_null("name").alias("perfume"))
             .filter(F.col("perfume").isNotNull()).distinct())
    out = tr.join(heads, "order_id").join(names, "order_id")
    return out.withColumn("kind", F.when(F.col("entered"), F.lit("enter")).otherwise(F.lit("leave")))


def manual_steps(changes: DataFrame, customers: DataFrame) -> DataFrame:
    """Valid manual unlock/lock changes (known customer, non-blank perfume) as fold steps."""
    ids = customers.select(F.col("id").alias("customer_id"))
    ok = (changes.withColumn("perfume", X.blank_to_null("perfume")).filter(F.col("perfume").isNotNull())
          .join(ids, "customer_id", "left_semi"))
    return ok.select("customer_id", "perfume", F.lit(None).cast("bigint").alias("order_id"),
                     F.lit(None).cast("string").alias("order_number"),
                     F.lit(None).cast("timestamp_ntz").alias("created_at"), "ts", "seq",
                     F.when(F.col("unlocked"), F.lit("unlock")).otherwise(F.lit("lock")).alias("kind"))


_STEP_COLS = ["customer_id", "perfume", "order_id", "order_number", "created_at", "ts", "seq", "kind"]


def collection_fold(events: DataFrame, orders: DataFrame, items: DataFrame, manual: DataFrame | None = None,
                    num_partitions: int | None = None, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """Library rows and live notifications after the whole history (``record`` tells which).
    ``manual`` (from ``manual_steps``) interleaves admin unlocks/locks; at equal (ts, seq)
    order transitions apply before manual changes **[choice]**.

    Keys of up to ``rows_a_task`` steps are walked in order, many a task; a longer key is
    answered by ``hot_fold`` from all its parts at once.
    """
    ship_package(events.sparkSession)          # the fold body runs in Python workers
    rows = delivered_transitions(events, orders, items).select(*_STEP_COLS)
    if manual is not None:
        rows = rows.unionByName(manual.select(*_STEP_COLS))
    rows = cut_lineage(rows.withColumn("_k", F.when(F.col("kind").isin("enter", "leave"), F.lit(0)).otherwise(F.lit(1))))
    n = num_partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = rows.groupBy("customer_id", "perfume").agg(F.count(F.lit(1)).alias("_n"))
    hot = cut_lineage(sizes.filter(F.col("_n") > rows_a_task))     # fewer than rows / rows_a_task keys
    n_hot = hot.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    keys = hot.select("customer_id", "perfume")
    short = rows if n_hot == 0 else rows.join(keys, ["customer_id", "perfume"], "left_anti")
    keyed = (short.repartition(n, "customer_id", "perfume")
             .sortWithinPartitions("customer_id", "perfume", "ts", "seq", "_k"))
    walked = keyed.select(*_STEP_COLS).mapInPandas(_fold_sorted, FOLD_OUTPUT_SCHEMA)
    if n_hot == 0:
        return walked
    long = rows.join(keys, ["customer_id", "perfume"], "left_semi")
    return walked.unionByName(hot_fold(long, max(n, -(-n_hot // max(1, rows_a_task)))))


def collection_sources(events: DataFrame, orders: DataFrame, items: DataFrame,
                       manual: DataFrame | None = None) -> DataFrame:
    """O-B5: (customer, perfume, source_code) after the history."""
    f = collection_fold(events, orders, items, manual)
    return f.filter(F.col("record") == "library").select("customer_id", "perfume", "source_code")


def unlock_notifications(events: DataFrame, orders: DataFrame, items: DataFrame,
                         manual: DataFrame | None = None) -> DataFrame:
    """O-B6: notifications still present after the history (all unseen in this model)."""
    f = collection_fold(events, orders, items, manual)
    return (f.filter(F.col("record") == "notification")
            .select("customer_id", "perfume", "order_id", "order_number", "created_at"))
