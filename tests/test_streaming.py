"""O-B11: the streaming lifecycle over eight micro-batches and more equals the batch fold."""

import os

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from decantry.operators import fold as FO
from decantry.operators import lifecycle as L
from decantry.plans.q_lifecycle import manual_changes, manual_changes_of
from decantry.sources import driver as D
from decantry.streaming import lifecycle_stream as S


def _library(views):
    return {(r.customer_id, r.perfume): r.source_code for r in views.filter("record = 'library'").collect()}


def _stream(spark, d, folder, files, with_manual=False):
    raw = D.stream_events(spark, d, folder, files)
    manual = None
    if with_manual:
        manual = FO.manual_steps(manual_changes_of(raw, D.f_catalog(spark, d), D.row_count(spark, d, "part")), D.f_customers(spark, d))
        manual = manual.withColumn("unlocked", F.col("kind") == "unlock")
    return S.stream_lifecycle(S.with_perfumes(D.status_events_of(raw, D.row_count(spark, d, "part")), D.f_catalog(spark, d)), manual)


@pytest.mark.parametrize("with_manual", [False, True])
def test_stream_matches_batch(spark, sf_small, tmp_dir, with_manual):
    src = os.path.join(tmp_dir, "arrivals")
    files = D.event_arrivals(spark, sf_small, src, batches=9)
    out = S.run_to_parquet(spark, _stream(spark, sf_small, src, files, with_manual), "test")
    rows = spark.read.parquet(out)
    assert rows.select("batch_id").distinct().count() == 9
    views = S.latest_views(spark, out)

    events, orders, items = D.f_status_events(spark, sf_small), D.f_lifecycle_orders(spark, sf_small), D.f_lifecycle_items(spark, sf_small)
    manual = FO.manual_steps(manual_changes(spark, sf_small), D.f_customers(spark, sf_small)) if with_manual else None
    want = {(r.customer_id, r.perfume): r.source_code for r in FO.collection_sources(events, orders, items, manual).collect()}
    assert _library(views) == want
    assert any(v == "MANUAL-STUDIO" for v in want.values()) == with_manual
    want = {(r.customer_id, r.perfume, r.order_id, r.created_at) for r in FO.unlock_notifications(events, orders, items, manual).collect()}
    assert {(r.customer_id, r.perfume, r.order_id, r.created_at) for r in views.filter("record = 'notification'").collect()} == want

    bal = L.loyalty_balance(L.order_status_final(events), orders)
    want = {r.customer_id: (r.total_spent, r.bookmarks) for r in bal.collect()}
    got = {r.customer_id: (r.total_spent, r.bookmarks) for r in views.filter("record = 'balance'").collect() if r.bookmarks or r.total_spent}
    assert got == want


def test_micro_batches_emit_only_changes(spark, sf_small, tmp_dir):
    src = os.path.join(tmp_dir, "arrivals")
    files = D.event_arrivals(spark, sf_small, src, batches=8)
    out = S.run_to_parquet(spark, _stream(spark, sf_small, src, files), "changes")
    rows = spark.read.parquet(out)
    # A key that a batch repeats has changed: no two versions in a row say the same.
    said = {}
    for r in rows.orderBy("version").collect():
        key = (r.customer_id, r.record, r.perfume, r.order_id if r.record == "notification" else None)
        value = (r.order_id, r.source_code, r.created_at, r.total_spent, r.bookmarks, r.gone)
        assert said.get(key) != value
        said[key] = value
    # Far fewer rows than whole views a batch.
    assert rows.count() < 8 * S.latest_views(spark, out).count()


def test_a_second_run_goes_on_from_the_state(spark, sf_small, tmp_dir):
    src, whole, folder = (os.path.join(tmp_dir, n) for n in ("arrivals", "whole", "run"))
    files = D.event_arrivals(spark, sf_small, whole, batches=8)
    parts = sorted((f for f in os.listdir(whole) if f.startswith("part-")), key=lambda f: os.stat(os.path.join(whole, f)).st_mtime_ns)
    os.makedirs(src)
    for half in (parts[: len(parts) // 2], parts[len(parts) // 2:]):
        for f in half:
            os.link(os.path.join(whole, f), os.path.join(src, f))
        out = S.run_to_parquet(spark, _stream(spark, sf_small, src, files), folder=folder)
    once = S.run_to_parquet(spark, _stream(spark, sf_small, whole, files), "once")
    assert _library(S.latest_views(spark, out)) == _library(S.latest_views(spark, once))


def test_static_side_is_the_catalogue_alone(spark, sf_small, tmp_dir):
    src = os.path.join(tmp_dir, "arrivals")
    files = D.event_arrivals(spark, sf_small, src)
    plan = _stream(spark, sf_small, src, files)._jdf.queryExecution().analyzed().toString()
    # The events come in as the stream only; the one table read beside it is the catalogue's.
    static = [line for line in plan.splitlines() if "Relation [" in line]
    assert plan.count("StreamingRelation") == 1 and "Aggregate" not in plan
    assert len(static) == 1 and "p_partkey" in static[0]


def test_rows_that_say_nothing(spark, sf_small, tmp_dir):
    """Guests, unknown statuses, blank and null perfumes, null totals, equal times."""
    from datetime import datetime
    at = datetime(2024, 1, 1)
    rows = [(1, None, "delivered", at, 1, "5.00", "P-1", "a"), (2, 7, "lost", at, 2, "5.00", "P-2", "a"),
            (3, 7, "delivered", at, 3, None, "P-3", "  "), (3, 7, "delivered", at, 3, None, "P-3", None),
            (4, 7, "delivered", at, 4, "5.50", "P-4", " a "), (4, 7, "delivered", at, 4, "5.50", "P-4", "a"),
            (5, 7, "delivered", at, 5, "2.00", "P-5", "a"), (4, 7, "ready", at, 6, "5.50", "P-4", "a")]
    path = os.path.join(tmp_dir, "in")
    df = (spark.createDataFrame(rows, "order_id long, customer_id long, new_status string, ts timestamp_ntz, seq long, "
                                "order_total string, order_number string, perfume string")
          .withColumn("order_total", F.col("order_total").cast("decimal(12,2)")))
    df.coalesce(1).write.parquet(path)
    out = S.run_to_parquet(spark, S.stream_lifecycle(spark.readStream.schema(df.schema).parquet(path)), "edges")
    views = S.latest_views(spark, out)
    assert _library(views) == {(7, "a"): "ORDER-P-5"}
    assert [(str(r.total_spent), r.bookmarks) for r in views.filter("record = 'balance'").collect()] == [("2.00", 2)]
    assert views.filter("record = 'notification'").count() == 0


@pytest.mark.parametrize("small", [0, 7, 500])
def test_state_in_one_value_or_in_maps(small, monkeypatch):
    """A customer's changes are the same with all state in one value, in the maps from the start, or
    moved there on the way; a small customer costs one read and one write of state a micro-batch."""
    calls = []

    class Held:
        def __init__(self):
            self.rows, self.value = {}, None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

        def getValue(self, key):
            calls.append("getValue")
            return self.rows.get(key)

        def updateValue(self, key, value):
            calls.append("updateValue")
            self.rows[key] = value

    class Handle:
        def getMapState(self, *a):
            return Held()

        getValueState = getMapState

    def run(limit):
        monkeypatch.setattr(S, "SMALL", limit)
        p = S.LifecycleProcessor()
        p.init(Handle())
        out = []
        for batch in range(6):
            rows = [Row(order_id=i, new_status=["delivered", "ready", "delivered", "lost", "pending"][(i * 3 + batch) % 5], ts=batch * 100 + i // 2,
                        seq=batch * 100 + i, cents=100 * i + 50, order_number=f"P-{i}", perfume=f"p{(i + j) % 4}", unlocked=None, rk=0)
                    for i in range(batch, batch + 5) for j in range(2)]
            rows += [Row(order_id=None, new_status=None, ts=batch * 100 + 3, seq=batch * 100 + 50, cents=None, order_number=None, perfume="p1",
                         unlocked=batch % 2 == 0, rk=1)]
            out += [tuple(r) for r in p.handleInputRows((7,), iter(rows), None)]
        return out

    whole = run(10 ** 6)
    assert len(whole) > 20 and calls == ["get", "update"] * 6
    assert sorted(run(small), key=repr) == sorted(whole, key=repr)
