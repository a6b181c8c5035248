"""§2.3 store: touched-bucket merges with manifest commits, durable numbering, carried ledger."""

import datetime as dt
import hashlib
import os
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from decantry.operators import catalog as C
from decantry.operators import ledger as LG
from decantry.operators import orders as O
from decantry.plans.q_catalog import catalog_changes
from decantry.sources import driver as D
from decantry.sources import store as ST


def _files(path):
    out = {}
    for root, _, names in os.walk(path):
        for n in names:
            if n.endswith(".parquet"):
                with open(os.path.join(root, n), "rb") as f:
                    out[os.path.join(root, n)] = hashlib.sha256(f.read()).hexdigest()
    return out


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture()
def catalog_store(spark, sf_small, tmp_dir):
    path = os.path.join(tmp_dir, "catalog")
    ST.create_store(D.f_catalog(spark, sf_small), path, "id", buckets=16)
    return path


def test_a_batch_rewrites_only_its_buckets(spark, sf_small, catalog_store):
    before, old = _files(catalog_store), ST.manifest_of(spark, catalog_store)
    ids = [r.id for r in D.f_catalog(spark, sf_small).limit(3).collect()]
    changes = spark.createDataFrame([(i, k, f"img/{k}") for k, i in enumerate(ids)], "catalog_id long, seq long, image_url string")
    apply = lambda cat: C.apply_image_changes(cat, changes)[0]
    keys = changes.select(F.col("catalog_id").alias("id"))
    assert ST.merge_batch(spark, catalog_store, "b1", keys, apply) == 2
    new = ST.manifest_of(spark, catalog_store)
    touched = {b for b in new.folders if new.folders[b] != old.folders.get(b)}
    assert 0 < len(touched) <= 3
    after = _files(catalog_store)
    assert {p: h for p, h in after.items() if p in before} == before
    assert _rows(ST.read_store(spark, catalog_store)) == _rows(apply(D.f_catalog(spark, sf_small)))
    assert _rows(ST.read_store(spark, catalog_store, version=1)) == _rows(D.f_catalog(spark, sf_small))
    # Again: nothing is read, written or committed.
    assert ST.merge_batch(spark, catalog_store, "b1", keys, lambda cat: 1 / 0) == 2
    assert _files(catalog_store) == after and ST.manifest_of(spark, catalog_store).version == 2


def test_all_catalogue_changes_on_the_store(spark, sf_small, catalog_store):
    ch = catalog_changes(spark, sf_small)
    of = lambda kind: ch.filter(F.col("kind") == kind)
    steps = [("prices", lambda c: C.apply_price_changes(c, of("prices"))[0]), ("status", lambda c: C.apply_status_changes(c, of("status"))[0]),
             ("stock", lambda c: C.apply_stock_counts(c, of("stock"), D.f_orders_core(spark, sf_small), D.f_items_core(spark, sf_small),
                                                      D.item_names(spark, sf_small))[0]),
             ("delete", lambda c: C.soft_delete(c, of("delete"))[0]), ("image", lambda c: C.apply_image_changes(c, of("image"))[0]),
             ("active", lambda c: C.apply_active_flags(c, of("active"))[0])]
    want = D.f_catalog(spark, sf_small)
    for kind, apply in steps:
        ST.merge_batch(spark, catalog_store, kind, of(kind).select(F.col("catalog_id").alias("id")), apply)
        want = apply(want)
    assert ST.manifest_of(spark, catalog_store).version == 7
    assert _rows(ST.read_store(spark, catalog_store)) == _rows(want)


def test_a_lost_writer_and_a_conflict(spark, catalog_store, monkeypatch):
    keys = ST.read_store(spark, catalog_store).select("id").limit(5)
    before = _rows(ST.read_store(spark, catalog_store))
    hide = lambda cat: cat.withColumn("active", F.lit(False))
    commit = ST._commit
    monkeypatch.setattr(ST, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        ST.merge_batch(spark, catalog_store, "b", keys, hide)
    monkeypatch.setattr(ST, "_commit", commit)
    assert _rows(ST.read_store(spark, catalog_store)) == before     # its files are not named
    gone = ST.vacuum(spark, catalog_store)
    assert len(gone) == 1 and _rows(ST.read_store(spark, catalog_store)) == before

    def overtaken(cat):
        ST.merge_batch(spark, catalog_store, "other", keys, lambda c: c)
        return hide(cat)
    with pytest.raises(ST.StoreConflict):
        ST.merge_batch(spark, catalog_store, "b", keys, overtaken)
    assert ST.merge_batch(spark, catalog_store, "b", keys, hide) == 3
    assert ST.read_store(spark, catalog_store).filter("not active").count() >= 5


def test_empty_batches_and_emptied_buckets(spark, catalog_store):
    n = ST.read_store(spark, catalog_store).count()
    none = spark.createDataFrame([], "id long")
    assert ST.merge_batch(spark, catalog_store, "empty", none, lambda c: c) == 2
    some = ST.read_store(spark, catalog_store).select("id").limit(1)
    drop = lambda c: c.filter("false")
    ST.merge_batch(spark, catalog_store, "drop", some, drop)
    assert len(ST.manifest_of(spark, catalog_store).folders) == 15 and ST.read_store(spark, catalog_store).count() < n
    with pytest.raises(ValueError):
        ST.merge_batch(spark, catalog_store, "stray", some, lambda c: ST.read_store(spark, catalog_store, 1))


def test_numbering_goes_on_across_batches(spark, sf_small, tmp_dir):
    path = os.path.join(tmp_dir, "orders")
    core = D.f_orders_core(spark, sf_small).select("id", "created_at")
    empty = O.number_orders(core.limit(0)).select("id", "created_at", "seq", "order_number")
    ST.create_store(empty, path, "id", buckets=4)
    number = lambda rows, start: O.number_orders(rows, start=start)
    batches = [core.filter(F.col("id") % 3 == k) for k in range(3)]
    seen = {}
    for k in (0, 1, 1, 2, 0):                      # with replays
        ST.append_numbered(spark, path, f"batch-{k}", batches[k], number, "orders")
        now = {r.id: r.seq for r in ST.read_store(spark, path).collect()}
        assert all(now[i] == s for i, s in seen.items())           # numbers never change
        seen = now
    assert sorted(seen.values()) == list(range(1, core.count() + 1))
    assert ST.manifest_of(spark, path).marks == {"orders": core.count()}
    low = {k: [seen[r.id] for r in batches[k].collect()] for k in range(3)}
    assert max(low[0]) < min(low[1]) and max(low[1]) < min(low[2])
    # A merge afterwards rewrites all folders of the bucket as one.
    ST.merge_batch(spark, path, "m", core.limit(1).select("id"), lambda c: c)
    assert ST.read_store(spark, path).count() == core.count()


def _walk(steps):
    out = {}
    for c, ts, seq, kind, v in sorted(steps, key=lambda s: (s[1], s[2])):
        out[c] = v if kind == "override" else max(Decimal(0), out.get(c, Decimal(0)) + v)
    return out


@pytest.mark.parametrize("kind", ["decimal(12,2)", "bigint"])
def test_ten_ledger_batches_equal_one_replay(spark, tmp_dir, kind):
    rnd = random.Random(kind)
    steps, path = [], os.path.join(tmp_dir, "ledger")
    cents = lambda lo, hi: Decimal(rnd.randint(lo, hi)) / 100 if kind != "bigint" else Decimal(rnd.randint(lo, hi))
    for s in range(1200):
        c = None if rnd.random() < 0.02 else rnd.randrange(40) if rnd.random() < 0.6 else 0      # one hot customer
        if rnd.random() < 0.03:
            steps.append((c, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * s), s, "override", cents(0, 900)))
        else:
            steps.append((c, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * s), s, "delta", cents(-900, 700)))
    total = "decimal(22,2)" if kind != "bigint" else "bigint"
    ST.create_store(spark.createDataFrame([], f"customer_id long, start {kind}, total {total}, low {total}"), path, "customer_id", buckets=8)
    one = lambda v: int(v) if kind == "bigint" else v
    for k in range(10):
        part = steps[k * 120:(k + 1) * 120]
        deltas = spark.createDataFrame([(c, t, s, one(v)) for c, t, s, x, v in part if x == "delta"],
                                       f"customer_id long, ts timestamp_ntz, seq long, delta {kind}")
        over = spark.createDataFrame([(c, t, s, one(v)) for c, t, s, x, v in part if x == "override"],
                                     f"customer_id long, ts timestamp_ntz, seq long, start_value {kind}")
        batch = LG.summarise(deltas, over)
        for _ in range(2):                                     # the second time nothing happens
            ST.merge_batch(spark, path, f"batch-{k}", batch.select("customer_id"), lambda c, batch=batch: LG.merged(c, batch))
    got = {r[0]: Decimal(r[1]) for r in ST.read_store(spark, path).select("customer_id", LG.balance()).collect()}
    assert got == _walk(steps)


def test_stored_items_read_back_without_a_shuffle(spark, tmp_dir):
    rows = [(1, '[{"name":" Eros ","size":"10 ml","qty":2},{"name":"x","size":"1.2.3","qty":"1"},{"name":null,"size":"","qty":"two"}]'),
            (2, "[]"), (3, None), (4, '{"name":"alone"}'), (5, '[7, {"name":"y"}]'), (6, "not json")]
    raw = spark.createDataFrame(rows, "id long, items_json string")
    path = os.path.join(tmp_dir, "items")
    ST.create_store(O.with_stored_items(raw), path, "id", buckets=4)
    stored = ST.read_store(spark, path)
    got = sorted((r.id, r.perfume, str(r.ml), str(r.qty_n), r.quarantine) for r in O.explode_stored_items(stored).collect() if r.perfume)
    assert got == [(1, "Eros", "10.0000", "2.0000", False), (1, "x", "0.0000", "1.0000", True), (5, "y", "0.0000", "1.0000", False)]
    kept = [r.rescued for r in O.explode_stored_items(stored).collect() if r.quarantine]
    assert sorted(kept) == ["7", '{"name":"x","size":"1.2.3","qty":"1"}', '{"name":null,"size":"","qty":"two"}']
    plan = O.explode_stored_items(stored, fields=("ml", "qty_n")).groupBy().agg(F.sum("ml"))
    text = O.explode_stored_items(stored, fields=("ml", "qty_n"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "items:array<struct<ml:decimal(18,4),qty_n:decimal(18,4)>>" in text
    assert plan.count() == 1
