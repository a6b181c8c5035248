"""Order lifecycle as a Structured Streaming job (O-B11).

The reference applies status changes one call at a time; here they arrive as a stream, and a
``StatefulProcessor`` keyed by customer applies them in (ts, seq) order within each
micro-batch, after everything already applied for that customer (arrival order across
batches is the late-data rule). Its state is fine-grained:

* ``account``: the clamped totals, a version and, while the customer is small, all their orders and perfumes;
* ``orders``: order id -> status and creation time (the first event seen);
* ``perfumes``: perfume -> owner, live deliveries and unseen notifications.

A call to the state costs far more than its bytes, so a customer of up to ``SMALL`` entries is one value, read
and written once a micro-batch. A larger one moves to the two maps for good: there a
micro-batch reads and rewrites only the orders and perfumes that its events name. It
emits only what changed: a library row or its removal, a notification or its removal, the
balance. ``latest_views`` folds these changes into the current tables. The static side of the
enrichment is the catalogue alone; an event brings its order's total, number and keys.

Memory: a task holds one customer's rows of one micro-batch (bounded by the source's
admission, ``maxFilesPerTrigger``) and the state entries these rows touch.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta
from decimal import Decimal
from operator import itemgetter

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from decantry.functions import exprs as X
from decantry.session import delete_folder, ensure_checkpoint_dir, ship_package

OUTPUT_SCHEMA = ("customer_id long, version long, record string, perfume string, order_id long, source_code string, "
                 "created_at timestamp_ntz, total_spent decimal(18,2), bookmarks long, gone boolean")
STEP = ("order_id", "new_status", "ts", "seq", "cents", "order_number", "perfume", "unlocked", "rk")
EPOCH = datetime(1970, 1, 1)
ORDER_STATE = "status string, created_at long"
PERFUME_STATE = ("owner long, ids array<long>, delivered_at array<long>, created_at array<long>, numbers array<string>, "
                 "note_ids array<long>, note_at array<long>")
ACCOUNT_STATE = ("cents long, bookmarks long, version long, in_maps boolean, "
                 "order_ids array<long>, statuses array<string>, orders_at array<long>, "
                 "names array<string>, owners array<long>, ids array<array<long>>, delivered_at array<array<long>>, "
                 "created_at array<array<long>>, numbers array<array<string>>, note_ids array<array<long>>, note_at array<array<long>>")
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MANUAL, NOBODY = -1, -2     # owner (and notification order) of a manual unlock; no library row
SMALL = 500                 # orders, perfumes, deliveries and notifications of a customer kept in one value


class _Perfume:
    """One customer's perfume: its owner, live deliveries in order of arrival, notifications."""

    def __init__(self, value=None):
        owner, ids, delivered, created, numbers, note_ids, note_at = value or (NOBODY, [], [], [], [], [], [])
        self.owner = owner
        self.live = {i: (d, c, n) for i, d, c, n in zip(ids, delivered, created, numbers)}
        self.notes = dict(zip(note_ids, note_at))
        self.had = self.view()

    def view(self):
        return self.owner, dict(self.notes)

    def value(self):
        cols = list(zip(*self.live.values())) or [(), (), ()]
        return (self.owner, list(self.live), *(list(c) for c in cols), list(self.notes), list(self.notes.values()))

    def enter(self, order_id, ts, created_at, number):
        self.live[order_id] = (ts, created_at, number)
        if self.owner == NOBODY:
            self.owner, self.notes[order_id] = order_id, ts

    def leave(self, order_id):
        self.live.pop(order_id, None)
        self.notes.pop(order_id, None)
        if self.owner == order_id:
            # the latest delivery, then the latest order; the number breaks ties [choice]
            self.owner = max(self.live, key=self.live.get) if self.live else NOBODY

    def manual(self, unlocked, ts):
        if unlocked:
            self.owner = MANUAL if self.owner == NOBODY else self.owner
            if not self.notes:
                self.notes[MANUAL] = ts
        else:
            self.owner = NOBODY
            self.notes.clear()

    def source(self):
        if self.owner == MANUAL:
            return X.MANUAL_SOURCE
        return None if self.owner == NOBODY else X.ORDER_SOURCE_PREFIX + self.live[self.owner][2]


class LifecycleProcessor(StatefulProcessor):
    """Applies one customer's events of a micro-batch to the keyed state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.orders = handle.getMapState("orders", "order_id long", ORDER_STATE)
        self.perfumes = handle.getMapState("perfumes", "perfume string", PERFUME_STATE)
        self.account = handle.getValueState("account", ACCOUNT_STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        cents, bookmarks, version, in_maps, *kept = self.account.get() or (0, 0, 0, False, *([] for _ in range(11)))
        orders: dict[int, tuple] = {i: (st, at) for i, st, at in zip(*kept[:3])}
        values: dict[str, tuple] = {name: value for name, *value in zip(*kept[3:])}
        perfumes: dict[str, _Perfume] = {}
        had = (cents, bookmarks)

        def perfume(name):
            if name not in perfumes:
                perfumes[name] = _Perfume(self.perfumes.getValue((name,)) if in_maps else values.get(name))
            return perfumes[name]

        for (ts, _, rank), order_id, status, order_cents, number, names, unlocked in self._in_order(rows):
            if rank:
                for name in names:
                    perfume(name).manual(unlocked, ts)
                continue
            if status not in X.ORDER_STATUSES:
                continue
            if order_id not in orders:
                orders[order_id] = (self.orders.getValue((order_id,)) if in_maps else None) or ("pending", ts)
            before, created = orders[order_id]
            orders[order_id] = (status, created)
            if (before == "delivered") == (status == "delivered"):
                continue
            if status == "delivered":
                cents, bookmarks = cents + order_cents, bookmarks + order_cents // 100
            else:
                cents, bookmarks = max(0, cents - order_cents), max(0, bookmarks - order_cents // 100)
            for name in names:
                if status == "delivered":
                    perfume(name).enter(order_id, ts, created, number)
                else:
                    perfume(name).leave(order_id)

        version += 1
        out = [] if had == (cents, bookmarks) else [("balance", None, None, None, None, cents, bookmarks, False)]
        for name, p in perfumes.items():
            values[name] = p.value()
            owner, notes = p.had
            if owner != p.owner:
                out.append(("library", name, p.owner if p.owner > MANUAL else None, p.source(), None, None, None, p.owner == NOBODY))
            out += [("notification", name, o if o > MANUAL else None, None, p.notes.get(o), None, None, o not in p.notes)
                    for o in {**notes, **p.notes} if notes.get(o) != p.notes.get(o)]
        in_maps = in_maps or len(orders) + sum(1 + len(v[1]) + len(v[5]) for v in values.values()) > SMALL
        if in_maps:
            for order_id, value in orders.items():
                self.orders.updateValue((order_id,), value)
            for name, value in values.items():
                self.perfumes.updateValue((name,), tuple(value))
            orders, values = {}, {}
        columns = [list(orders), *self._columns(orders.values(), 2), list(values), *self._columns(values.values(), 7)]
        self.account.update((cents, bookmarks, version, in_maps, *columns))
        yield from self._rows(key[0], version, out)

    @staticmethod
    def _columns(values, n):
        return [list(c) for c in zip(*values)] or [[] for _ in range(n)]

    @staticmethod
    def _in_order(rows):
        """One step an event, its perfumes together, by (ts, seq); admin changes after status changes at a tie."""
        steps: dict[tuple, list] = {}
        pick = None
        for r in rows:
            pick = pick or itemgetter(*[r.__fields__.index(c) for c in STEP])      # by place: Row looks names up one by one
            order_id, status, ts, seq, cents, number, name, unlocked, rank = pick(r)
            at = (ts, seq, rank)
            step = steps.setdefault((at, None if rank else order_id, name if rank else None),
                                    [at, order_id, status, cents, number, set(), bool(unlocked)])
            if name is not None and name.strip():
                step[5].add(name.strip())
        return sorted(steps.values(), key=lambda s: tuple((v is not None, v) for v in s[0]))

    @staticmethod
    def _rows(customer_id, version, out) -> Iterator[Row]:
        for record, perfume, order_id, source, at, cents, bookmarks, gone in out:
            yield Row(customer_id=customer_id, version=version, record=record, perfume=perfume, order_id=order_id, source_code=source,
                      created_at=None if at is None else EPOCH + timedelta(microseconds=at),
                      total_spent=None if cents is None else Decimal(cents).scaleb(-2), bookmarks=bookmarks, gone=gone)

    def close(self) -> None:
        pass


def with_perfumes(events: DataFrame, catalog: DataFrame) -> DataFrame:
    """Status events with one row a perfume of the order (at least one row an event): the
    event's ``perfume_keys`` named by the static catalogue (``id, name``)."""
    names = catalog.select(F.col("id").alias("_pk"), F.col("name").alias("perfume"))
    return events.withColumn("_pk", F.explode_outer("perfume_keys")).join(names, "_pk", "left").drop("_pk", "perfume_keys")


def _micros(ts: str):
    return F.unix_micros(F.col(ts).cast("timestamp"))


def stream_lifecycle(events: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """Streaming DataFrame of per-customer changes (update mode).

    ``events`` is a streaming frame (order_id, customer_id, new_status, ts, seq, order_total,
    order_number, perfume) as ``with_perfumes`` makes it; guests (no customer) are left out.
    ``manual`` is an optional streaming frame of valid admin changes (customer_id, perfume,
    unlocked, ts, seq), unioned into the same keyed state.
    """
    ship_package(events.sparkSession)          # the processor runs in Python workers
    steps = events.filter(F.col("customer_id").isNotNull()).select(
        "customer_id", "order_id", "new_status", _micros("ts").alias("ts"), "seq",
        F.floor(F.coalesce(F.col("order_total"), F.lit(0)) * 100).cast("long").alias("cents"), "order_number", "perfume",
        F.lit(None).cast("boolean").alias("unlocked"), F.lit(0).alias("rk"))
    if manual is not None:
        steps = steps.unionByName(manual.select("customer_id", "perfume", "unlocked", _micros("ts").alias("ts"), "seq", F.lit(1).alias("rk")),
                                  allowMissingColumns=True)
    return steps.groupBy("customer_id").transformWithState(LifecycleProcessor(), OUTPUT_SCHEMA, "Update", "None")


@contextmanager
def _state_store(spark: SparkSession):
    """RocksDB as the state store (map states need it), the session's own setting afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STATE_STORE)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def run_to_parquet(spark: SparkSession, updates: DataFrame, name: str = "lifecycle", folder: str | None = None) -> str:
    """Run ``updates`` until the source is drained (availableNow), writing every micro-batch
    to Parquet; returns the output folder. ``folder`` keeps state and output, so that a later
    run goes on from there; without one, a new folder under the checkpoint folder holds the
    output only and the state is deleted at the end of the run."""
    base = (folder or ensure_checkpoint_dir(spark).rstrip("/") + f"/stream-{name}-{uuid.uuid4().hex[:12]}").rstrip("/")
    out, chk = base + "/out", base + "/_checkpoint"

    def sink(df, batch_id):
        # One folder per micro-batch, overwritten on replay: the sink is idempotent even
        # though foreachBatch may run a batch again after a failure.
        df.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    with _state_store(spark):
        q = (updates.writeStream.outputMode("update").foreachBatch(sink)
             .option("checkpointLocation", chk).trigger(availableNow=True).start())
        q.awaitTermination()
    if folder is None:
        delete_folder(spark, chk)
    return out


def latest_views(spark: SparkSession, out: str) -> DataFrame:
    """The current tables: of each library row, notification and balance the last change,
    without what is gone. The changes of a key combine map-side (a maximum)."""
    rows = spark.read.parquet(out)
    rest = [c for c in rows.columns if c not in ("customer_id", "record", "perfume", "order_id", "batch_id", "version")]
    entry = F.when(F.col("record") == "notification", F.col("order_id"))
    last = (rows.groupBy("customer_id", "record", "perfume", entry.alias("_entry"))
            .agg(F.max_by(F.struct("order_id", *rest), F.col("version")).alias("_v")))
    return last.filter(~F.col("_v.gone")).select("customer_id", "record", "perfume", "_v.order_id",
                                                 *(f"_v.{c}" for c in rest if c != "gone"))
