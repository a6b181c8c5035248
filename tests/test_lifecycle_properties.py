"""Property tests: the set-based lifecycle and the Spark fold against a row-at-a-time model
of the reference on random histories (guests, repeated perfumes, delivered -> delivered,
reversal and re-delivery)."""

import datetime as dt
import random
from decimal import Decimal

from decantry.operators import fold as FO
from decantry.operators import lifecycle as L
from row_model import reference_fold

STATUSES = ["pending", "preparing", "ready", "delivered", "cancelled"]
PERFUMES = ["Eros", "CK One", " Eros ", "Sauvage", "Le Beau", ""]


def _histories(n_customers=60, seed=7):
    rnd = random.Random(seed)
    orders, items, events = [], [], []
    seq = 0
    t0 = dt.datetime(2024, 1, 1)
    oid = 0
    for c in range(n_customers):
        n_orders = rnd.randint(1, 5)
        mine = []
        for _ in range(n_orders):
            oid += 1
            cust = None if rnd.random() < 0.1 else c
            created = t0 + dt.timedelta(minutes=rnd.randint(0, 50))
            perf = rnd.sample(PERFUMES, rnd.randint(1, 3))
            if rnd.random() < 0.3:
                perf.append(perf[0])                          # repeated perfume in one order
            orders.append((oid, cust, Decimal(rnd.randint(100, 9999)) / 100, f"P-{oid:05d}", created))
            items.extend((oid, p) for p in perf)
            mine.append(oid)
        for _ in range(rnd.randint(1, 14)):
            seq += 1
            o = rnd.choice(mine)
            st = rnd.choice(STATUSES + ["delivered", "delivered"])
            # equal timestamps happen; seq breaks the tie
            events.append((o, st, t0 + dt.timedelta(hours=seq // 2), seq))
    return orders, items, events


def _frames(spark, orders, items, events):
    o = spark.createDataFrame(orders, "id long, customer_id long, order_total decimal(12,2), order_number string, created_at timestamp_ntz")
    i = spark.createDataFrame(items, "order_id long, name string")
    e = spark.createDataFrame(events, "order_id long, new_status string, ts timestamp_ntz, seq long")
    return o, i, e


def _model(orders, items, events):
    meta = {o[0]: o for o in orders}
    perf = {}
    for oid, p in items:
        perf.setdefault(oid, []).append(p)
    hist = [{"order_id": o, "customer_id": meta[o][1], "status": st, "ts": ts, "created_at": meta[o][4],
             "order_number": meta[o][3], "perfumes": perf.get(o, [])}
            for o, st, ts, sq in sorted(events, key=lambda e: (e[2], e[3]))]
    return reference_fold(hist)


def test_fold_matches_row_model(spark):
    orders, items, events = _histories()
    o, i, e = _frames(spark, orders, items, events)
    lib, notes = _model(orders, items, events)
    got = {(r.customer_id, r.perfume): r.source_code for r in FO.collection_sources(e, o, i).collect()}
    assert got == {k: v for k, v in lib.items()}
    got_n = {(r.customer_id, r.perfume, r.order_id): r.created_at for r in FO.unlock_notifications(e, o, i).collect()}
    assert got_n == notes


def test_members_equal_fold_without_manual_changes(spark):
    orders, items, events = _histories(seed=11)
    o, i, e = _frames(spark, orders, items, events)
    lib, _ = _model(orders, items, events)
    fin = L.order_status_final(e)
    members = {(r.customer_id, r.perfume) for r in L.collection_members(fin, o, i).collect()}
    assert members == set(lib)


def test_balance_equals_replayed_sum(spark):
    orders, items, events = _histories(seed=3)
    o, i, e = _frames(spark, orders, items, events)
    meta = {x[0]: x for x in orders}
    status, total, marks = {}, {}, {}
    for oid, st, ts, sq in sorted(events, key=lambda x: (x[2], x[3])):
        prev = status.get(oid, "pending")
        c, amt = meta[oid][1], meta[oid][2]
        if c is not None and prev == "delivered" and st != "delivered":
            total[c] = max(Decimal(0), total.get(c, Decimal(0)) - amt)
            marks[c] = max(0, marks.get(c, 0) - int(amt // 1))
        if c is not None and st == "delivered" and prev != "delivered":
            total[c] = total.get(c, Decimal(0)) + amt
            marks[c] = marks.get(c, 0) + int(amt // 1)
        status[oid] = st
    got = {r.customer_id: (r.total_spent, r.bookmarks) for r in L.loyalty_balance(L.order_status_final(e), o).collect()}
    want = {c: (total[c], marks[c]) for c in total if total[c] > 0 or marks[c] > 0}
    assert {c: v for c, v in got.items()} == want


def test_status_final_delivered_at_is_current_run_start(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    ev = spark.createDataFrame([(1, "delivered", t(1), 1), (1, "delivered", t(2), 2), (1, "pending", t(3), 3),
                                (1, "delivered", t(4), 4), (1, "delivered", t(5), 5),
                                (2, "delivered", t(1), 6), (2, "cancelled", t(2), 7)],
                               "order_id long, new_status string, ts timestamp_ntz, seq long")
    got = {r.order_id: (r.status, r.delivered_at, r.updated_at) for r in L.order_status_final(ev).collect()}
    assert got == {1: ("delivered", t(4), t(5)), 2: ("cancelled", None, t(2))}


def test_clamped_balance_closed_form(spark):
    rnd = random.Random(5)
    deltas, overrides, want = [], [], {}
    for c in range(200):
        b, seq = 0, 0
        for _ in range(rnd.randint(1, 25)):
            seq += 1
            ts = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=seq)
            if rnd.random() < 0.15:
                v = rnd.randint(0, 50)
                overrides.append((c, ts, seq, v))
                b = v
            else:
                d = rnd.randint(-40, 40)
                deltas.append((c, ts, seq, d))
                b = max(0, b + d)
        want[c] = b
    dd = spark.createDataFrame(deltas, "customer_id long, ts timestamp_ntz, seq long, delta long")
    oo = spark.createDataFrame(overrides, "customer_id long, ts timestamp_ntz, seq long, start_value long")
    got = {r.customer_id: r.balance for r in L.clamped_balance(dd, oo).collect()}
    assert got == {c: v for c, v in want.items() if c in got}
    assert set(got) == set(want)


def test_manual_unlock_batch_equals_sequential(spark):
    lib = spark.createDataFrame([(1, "Eros", "ORDER-P-1"), (1, "CK One", None), (2, "Sauvage", "ORDER-P-9")],
                                "customer_id long, perfume string, source_code string")
    notes = spark.createDataFrame([("n1", 1, None, "Eros", "P-1", None, dt.datetime(2024, 1, 1))],
                                  "id string, customer_id long, order_id long, perfume string, order_number string, "
                                  "seen_at timestamp_ntz, created_at timestamp_ntz")
    cust = spark.createDataFrame([(1,), (2,)], "id long")
    changes = [(1, "Eros", True, dt.datetime(2024, 2, 1), 1),        # keeps ORDER source
               (1, "CK One", True, dt.datetime(2024, 2, 2), 2),      # null source -> MANUAL
               (2, "Sauvage", False, dt.datetime(2024, 2, 3), 3),    # lock
               (2, "Sauvage", True, dt.datetime(2024, 2, 4), 4),     # lock then unlock -> MANUAL
               (1, "Le Beau", True, dt.datetime(2024, 2, 5), 5),     # new
               (3, "Eros", True, dt.datetime(2024, 2, 6), 6),        # unknown customer
               (1, "  ", True, dt.datetime(2024, 2, 7), 7)]          # blank perfume
    ch = spark.createDataFrame(changes, "customer_id long, perfume string, unlocked boolean, ts timestamp_ntz, seq long")
    new_lib, new_notes, rej = L.apply_manual_unlocks(lib, notes, cust, ch)
    got = {(r.customer_id, r.perfume): r.source_code for r in new_lib.collect()}
    assert got == {(1, "Eros"): "ORDER-P-1", (1, "CK One"): "MANUAL-STUDIO", (2, "Sauvage"): "MANUAL-STUDIO",
                   (1, "Le Beau"): "MANUAL-STUDIO"}
    assert {r.seq: r.reject_reason for r in rej.collect()} == {6: "customer_not_found", 7: "invalid_perfume"}
    unseen = sorted((r.customer_id, r.perfume) for r in new_notes.filter("seen_at IS NULL").collect())
    # Eros already had an unseen notification: no new one.
    assert unseen == [(1, "CK One"), (1, "Eros"), (1, "Le Beau"), (2, "Sauvage")]
    # One at a time gives the same library.
    seq_lib = lib
    for row in changes:
        seq_lib, _, _ = L.apply_manual_unlocks(seq_lib, notes, cust, spark.createDataFrame([row], ch.schema))
        seq_lib = spark.createDataFrame(seq_lib.collect(), lib.schema)
    assert {(r.customer_id, r.perfume): r.source_code for r in seq_lib.collect()} == got


def test_status_gate_uses_same_batch_price(spark):
    from decantry.operators import catalog as C
    cat = spark.createDataFrame([(1, "A", None, None, None, None, None, "upcoming", True)],
                                "id long, name string, price_2ml decimal(10,2), price_3ml decimal(10,2), price_5ml decimal(10,2), "
                                "price_10ml decimal(10,2), deleted_at timestamp_ntz, availability_status string, active boolean")
    st = spark.createDataFrame([(1, 1, " PUBLISHED "), (1, 3, "published")], "catalog_id long, seq long, new_status string")
    pr = spark.createDataFrame([(1, 2, Decimal(1), Decimal(2), Decimal(3), Decimal(4))],
                               "catalog_id long, seq long, price_2ml decimal(12,4), price_3ml decimal(12,4), "
                               "price_5ml decimal(12,4), price_10ml decimal(12,4)")
    new, rej = C.apply_status_changes(cat, st, pr)
    assert {r.seq: r.reject_reason for r in rej.collect()} == {1: "prices_required"}
    r = new.collect()[0]
    assert (r.availability_status, r.active) == ("published", True)


def test_chunked_scans_do_not_depend_on_chunk_width(spark):
    """Chunk width only changes how a hot key spreads, never the result."""
    from decantry.operators import ordered as OR
    rnd = random.Random(9)
    rows, seq = [], 0
    for k in range(5):                                  # key 0 is "hot"
        for _ in range(400 if k == 0 else rnd.randint(1, 30)):
            seq += 1
            rows.append((k, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rnd.randint(0, 4 * 3600)), seq,
                         rnd.choice(["a", "b", "c"]), rnd.randint(-20, 20)))
    df = spark.createDataFrame(rows, "k long, ts timestamp_ntz, seq long, v string, d long")
    lag = {u: {r.seq: r.prev for r in OR.lag_by_key(df, "k", "v", "prev", default="-", unit=u).collect()}
           for u in ("minute", "hour", "year")}
    assert lag["minute"] == lag["hour"] == lag["year"]
    want = {}
    for k, ts, sq, v, d in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        want.setdefault(k, []).append((sq, v))
    expect = {}
    for k, seqv in want.items():
        prev = "-"
        for sq, v in seqv:
            expect[sq] = prev
            prev = v
    assert lag["minute"] == expect
    tot = {u: {r.k: (r._sn, r._smin) for r in OR.clamped_totals(df, "k", "d", unit=u).collect()}
           for u in ("minute", "year")}
    assert tot["minute"] == tot["year"]
    for k, seqv in want.items():
        run, mins = 0, []
        for r in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
            run += r[4]
            mins.append(run)
        assert tot["minute"][k] == (run, min(mins))


def test_fold_with_manual_changes_matches_row_model(spark):
    """Manual unlocks/locks interleaved with deliveries and reversals (the path-dependent case
    where collection_members no longer applies)."""
    orders, items, events = _histories(n_customers=50, seed=21)
    rnd = random.Random(22)
    t0 = dt.datetime(2024, 1, 1)
    max_seq = max(e[3] for e in events)
    manual = []
    for i in range(400):
        c = rnd.randrange(50)
        p = rnd.choice(["Eros", "CK One", "Sauvage", "Le Beau", " Eros "])
        sq = rnd.randint(1, max_seq + 50)
        manual.append((c, p, rnd.random() < 0.6, t0 + dt.timedelta(hours=sq // 2), sq))
    o, i, e = _frames(spark, orders, items, events)
    cust = spark.createDataFrame([(c,) for c in range(50)], "id long")
    ch = spark.createDataFrame(manual, "customer_id long, perfume string, unlocked boolean, ts timestamp_ntz, seq long")
    steps = FO.manual_steps(ch, cust)

    meta = {x[0]: x for x in orders}
    perf = {}
    for oid, p in items:
        perf.setdefault(oid, []).append(p)
    hist = [((ts, sq, 0), {"order_id": oid, "customer_id": meta[oid][1], "status": st, "ts": ts,
                           "created_at": meta[oid][4], "order_number": meta[oid][3], "perfumes": perf.get(oid, [])})
            for oid, st, ts, sq in events]
    hist += [((ts, sq, 1), {"kind": "manual", "customer_id": c, "perfume": p, "unlocked": u, "ts": ts})
             for c, p, u, ts, sq in manual]
    lib, notes = reference_fold([h for _, h in sorted(hist, key=lambda x: x[0])])

    got = {(r.customer_id, r.perfume): r.source_code for r in FO.collection_sources(e, o, i, steps).collect()}
    assert got == lib
    got_n = {(r.customer_id, r.perfume, r.order_id): r.created_at
             for r in FO.unlock_notifications(e, o, i, steps).collect()}
    assert got_n == notes
    assert any(v == "MANUAL-STUDIO" for v in lib.values()) and any(k[2] is None for k in notes)


def test_fold_hot_key_spanning_many_arrow_batches(spark):
    """One (customer, perfume) with a long history: the fold must carry its state across
    Arrow batch boundaries (forced small here) and still equal the row model."""
    rnd = random.Random(31)
    t0 = dt.datetime(2024, 1, 1)
    orders = [(o, 1, Decimal("9.99"), f"P-{o:05d}", t0 + dt.timedelta(minutes=o)) for o in range(1, 31)]
    items = [(o, "Eros") for o in range(1, 31)] + [(o, "CK One") for o in range(1, 31, 3)]
    events = [(rnd.randint(1, 30), rnd.choice(["delivered", "delivered", "pending", "cancelled"]),
               t0 + dt.timedelta(seconds=s), s) for s in range(1, 3001)]
    o, i, e = _frames(spark, orders, items, events)
    lib, notes = _model(orders, items, events)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "100")
    try:
        got = {(r.customer_id, r.perfume): r.source_code for r in FO.collection_sources(e, o, i).collect()}
        got_n = {(r.customer_id, r.perfume, r.order_id): r.created_at for r in FO.unlock_notifications(e, o, i).collect()}
    finally:
        spark.conf.set(key, old)
    assert got == lib and got_n == notes
