"""O-B5/O-B6 for long keys: the parallel fold equals the row-at-a-time model, however the
steps are cut into parts, and a hot key is spread over tasks."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from decantry.operators import fold as FO
from decantry.operators import hot_fold as HF
from row_model import reference_fold

T0 = dt.datetime(2024, 1, 1)


def _history(seed, customers, orders_each, steps, manual_share, names=("Eros", "CK One", "Le Beau")):
    """(orders, items, status events, manual changes); times repeat, seq never does."""
    rnd = random.Random(seed)
    orders, items = [], []
    for c in range(customers):
        for k in range(orders_each):
            o = c * 1000 + k
            orders.append((o, c, Decimal("9.99"), f"P-{o:06d}", T0 + dt.timedelta(minutes=rnd.randint(0, 3))))
            items += [(o, p) for p in rnd.sample(names, rnd.randint(1, len(names)))]
    events, manual = [], []
    # Long calm stretches, and stretches in which few orders are live so that the row goes.
    for s in range(1, steps + 1):
        ts, c = T0 + dt.timedelta(seconds=s // 3), rnd.randrange(customers)
        if rnd.random() < manual_share:
            manual.append((c, rnd.choice(names), rnd.random() < 0.6, ts, s))
        else:
            few = (s // 60) % 3 == 0
            o = c * 1000 + rnd.randrange(3 if few else orders_each)
            share = 0.35 if few else 0.6
            events.append((o, "delivered" if rnd.random() < share else rnd.choice(["ready", "pending", "cancelled"]), ts, s))
    return orders, items, events, manual


def _frames(spark, orders, items, events, manual):
    customers = spark.createDataFrame([(c,) for c in sorted({o[1] for o in orders})], "id long")
    changes = spark.createDataFrame(manual, "customer_id long, perfume string, unlocked boolean, ts timestamp_ntz, seq long")
    return (spark.createDataFrame(events, "order_id long, new_status string, ts timestamp_ntz, seq long"),
            spark.createDataFrame(orders, "id long, customer_id long, order_total decimal(12,2), order_number string, created_at timestamp_ntz"),
            spark.createDataFrame(items, "order_id long, name string"), FO.manual_steps(changes, customers))


def _model(orders, items, events, manual):
    meta, perf = {o[0]: o for o in orders}, {}
    for o, p in items:
        perf.setdefault(o, []).append(p)
    rows = [((ts, s, 0), {"order_id": o, "customer_id": meta[o][1], "status": st, "ts": ts, "created_at": meta[o][4],
                          "order_number": meta[o][3], "perfumes": perf.get(o, [])}) for o, st, ts, s in events]
    rows += [((ts, s, 1), {"kind": "manual", "customer_id": c, "perfume": p, "unlocked": u, "ts": ts}) for c, p, u, ts, s in manual]
    return reference_fold([h for _, h in sorted(rows, key=lambda x: x[0])])


@pytest.mark.parametrize("seed,customers,orders_each,steps,share,parts", [
    (1, 6, 4, 300, 0.0, 1), (2, 6, 4, 400, 0.0, 23), (3, 6, 4, 400, 0.15, 17), (4, 1, 40, 1500, 0.0, 40),
    (5, 2, 12, 900, 0.02, 64), (6, 3, 3, 600, 0.01, 33), (7, 2, 25, 900, 0.005, 48)])
def test_hot_fold_equals_row_model(spark, seed, customers, orders_each, steps, share, parts):
    data = _history(seed, customers, orders_each, steps, share)
    library, notes = _model(*data)
    events, orders, items, manual = _frames(spark, *data)
    fold = FO.collection_fold(events, orders, items, manual if share else None, num_partitions=parts, rows_a_task=0).collect()
    assert {(r.customer_id, r.perfume): r.source_code for r in fold if r.record == "library"} == library
    assert {(r.customer_id, r.perfume, r.order_id): r.created_at for r in fold if r.record == "notification"} == notes


def test_long_and_short_keys_together(spark):
    hot, rest = _history(11, 1, 30, 900, 0.01), _history(12, 30, 3, 300, 0.05)
    shift = lambda rows, at: [tuple(v + 5000 * (k in at) if isinstance(v, int) and k in at else v for k, v in enumerate(r)) for r in rows]
    rest = ([(o + 500_000, c + 500, *r[2:]) for r in rest[0] for o, c in [r[:2]]], [(o + 500_000, p) for o, p in rest[1]],
            [(o + 500_000, *x) for o, *x in rest[2]], [(c + 500, *x) for c, *x in rest[3]])
    rest = (rest[0], rest[1], shift(rest[2], {3}), shift(rest[3], {4}))
    data = tuple(a + b for a, b in zip(hot, rest))
    library, notes = _model(*data)
    fold = FO.collection_fold(*_frames(spark, *data), num_partitions=8, rows_a_task=100).collect()
    assert {(r.customer_id, r.perfume): r.source_code for r in fold if r.record == "library"} == library
    assert {(r.customer_id, r.perfume, r.order_id): r.created_at for r in fold if r.record == "notification"} == notes


def test_a_hot_key_spreads_over_tasks(spark):
    """A third of all steps belong to one (customer, perfume); no part takes more than its share."""
    data = _history(21, 1, 50, 6000, 0.0, names=("Eros",))
    events, orders, items, _ = _frames(spark, *data)
    steps = FO.delivered_transitions(events, orders, items).select(*FO._STEP_COLS).withColumn("_k", F.lit(0))
    parts = 16
    laid = HF.lay_out(steps, parts)
    sizes = [r["count"] for r in laid.groupBy("part").count().collect()]
    assert len(sizes) >= parts - 2 and max(sizes) < 2.5 * sum(sizes) / parts
    spans = HF.intervals(laid)
    asked = spans.select("customer_id", "perfume", F.explode(F.array(F.expr("at >> 33"), F.expr("until >> 33"))).alias("part")).where("part is not null")
    # What one group of the link step reads: the deliveries that begin or end in its part, and one cover.
    most = asked.groupBy("customer_id", "perfume", "part").count().agg(F.max("count")).first()[0]
    assert most + 1 < 2.5 * sum(sizes) / parts + 1
    covers = HF.covers(spans, asked.select("customer_id", "perfume", "part").distinct(), 4)
    assert covers.groupBy("part").count().agg(F.max("count")).first()[0] == 1


def test_no_steps(spark):
    data = ([(1, 1, Decimal("1.00"), "P-1", T0)], [(1, "Eros")], [(1, "ready", T0, 1)], [])
    assert FO.collection_fold(*_frames(spark, *data), rows_a_task=0).count() == 0
