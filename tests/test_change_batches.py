"""Change batches: applying one batch equals applying its rows one at a time in seq order."""

import datetime as dt
import random
from decimal import Decimal

from decantry.operators import catalog as C
from decantry.operators import rewards as R

CAT_SCHEMA = ("id long, name string, brand string, price_2ml decimal(10,2), price_3ml decimal(10,2), "
              "price_5ml decimal(10,2), price_10ml decimal(10,2), availability_status string, active boolean, "
              "deleted_at timestamp_ntz, image_url string, stock_initial_ml decimal(10,2), low_stock_threshold_ml decimal(10,2)")


def _catalog(spark):
    p = Decimal("2.00")
    rows = [(1, "A", "x", p, p, p, p, "published", True, None, "a.webp", Decimal(100), Decimal(15)),
            (2, "B", "x", None, None, None, None, "upcoming", True, None, None, None, Decimal(15)),
            (3, "C", "x", p, p, p, p, "hidden", False, dt.datetime(2020, 1, 1), None, Decimal(50), Decimal(15)),
            (4, "D", "x", None, p, p, p, "upcoming", True, None, None, Decimal(10), Decimal(15))]
    return spark.createDataFrame(rows, CAT_SCHEMA)


def _snap(df):
    return sorted(tuple(r) for r in df.collect())


def _sequential(spark, apply, catalog, changes):
    cur = catalog
    for row in sorted(changes.collect(), key=lambda r: r.seq):
        cur, _ = apply(cur, spark.createDataFrame([row], changes.schema))
        cur = spark.createDataFrame(cur.collect(), catalog.schema)    # materialise the snapshot
    return cur


def _random_prices(spark, n=30, seed=1):
    rnd = random.Random(seed)
    rows = []
    for s in range(1, n + 1):
        vals = [None if rnd.random() < 0.15 else Decimal(rnd.randint(-2, 40)) / 4 for _ in range(4)]
        rows.append((rnd.randint(1, 5), s, *vals))
    return spark.createDataFrame(rows, "catalog_id long, seq long, price_2ml decimal(12,4), price_3ml decimal(12,4), "
                                       "price_5ml decimal(12,4), price_10ml decimal(12,4)")


def test_price_batch_equals_sequential(spark):
    cat, ch = _catalog(spark), _random_prices(spark)
    batch, _ = C.apply_price_changes(cat, ch)
    assert _snap(batch) == _snap(_sequential(spark, C.apply_price_changes, cat, ch))


def test_status_batch_equals_sequential(spark):
    rnd = random.Random(2)
    rows = [(rnd.randint(1, 5), s, rnd.choice([" Published", "upcoming", "HIDDEN", "nope", None]))
            for s in range(1, 40)]
    ch = spark.createDataFrame(rows, "catalog_id long, seq long, new_status string")
    cat = _catalog(spark)
    batch, _ = C.apply_status_changes(cat, ch)
    assert _snap(batch) == _snap(_sequential(spark, C.apply_status_changes, cat, ch))


def test_status_with_prices_in_batch_equals_interleaved_sequence(spark):
    """A publish in the same batch as price changes sees only the earlier valid ones."""
    rnd = random.Random(4)
    cat = _catalog(spark)
    prices = _random_prices(spark, 20, seed=5)
    price_seqs = {r.seq for r in prices.collect()}
    rows = [(rnd.randint(1, 5), s, rnd.choice(["published", "upcoming"])) for s in range(1, 60) if s not in price_seqs]
    status = spark.createDataFrame(rows, "catalog_id long, seq long, new_status string")
    batch, _ = C.apply_status_changes(cat, status, prices)
    # combine with the price effects of the same batch
    batch_prices, _ = C.apply_price_changes(cat, prices)
    want = {r.id: (r.availability_status, r.active) for r in batch.collect()}
    cur = cat
    events = sorted([("p", r) for r in prices.collect()] + [("s", r) for r in status.collect()], key=lambda e: e[1].seq)
    for kind, row in events:
        if kind == "p":
            cur, _ = C.apply_price_changes(cur, spark.createDataFrame([row], prices.schema))
        else:
            cur, _ = C.apply_status_changes(cur, spark.createDataFrame([row], status.schema))
        cur = spark.createDataFrame(cur.collect(), cat.schema)
    got = {r.id: (r.availability_status, r.active) for r in cur.collect()}
    assert got == want
    assert _snap(batch_prices.select("id", *C.PRICE_COLS)) == _snap(cur.select("id", *C.PRICE_COLS))


def test_soft_delete_and_images_batch_equal_sequential(spark):
    cat = _catalog(spark)
    dels = spark.createDataFrame([(1, 1, dt.datetime(2024, 1, 1)), (1, 2, dt.datetime(2024, 1, 2)),
                                  (3, 3, dt.datetime(2024, 1, 3)), (9, 4, dt.datetime(2024, 1, 4)),
                                  (2, 5, dt.datetime(2024, 1, 5))], "catalog_id long, seq long, change_ts timestamp_ntz")
    batch, rej = C.soft_delete(cat, dels)
    assert _snap(batch) == _snap(_sequential(spark, C.soft_delete, cat, dels))
    assert {r.seq: r.reject_reason for r in rej.collect()} == {2: "already_deleted", 3: "already_deleted", 4: "not_found"}
    imgs = spark.createDataFrame([(1, 1, " b.webp "), (2, 2, "  "), (1, 3, "c.webp"), (3, 4, "d.webp")],
                                 "catalog_id long, seq long, image_url string")
    batch, _ = C.apply_image_changes(cat, imgs)
    assert _snap(batch) == _snap(_sequential(spark, C.apply_image_changes, cat, imgs))


def test_reward_edits_batch_equals_sequential(spark):
    rewards = spark.createDataFrame([("r1", 30, "a", True, 10), ("r2", 75, "b", True, 20)],
                                    "id string, threshold int, reward_label string, active boolean, sort_order int")
    edits = spark.createDataFrame([("r1", 1, 40, " x ", None, None), ("r2", 2, 0, "y", False, 5),
                                   ("r1", 3, 50, "z", False, 7), ("r9", 4, 10, "w", True, 1)],
                                  "id string, seq long, threshold int, reward_label string, active boolean, sort_order int")
    batch, res = R.apply_reward_edits(rewards, edits)
    cur = rewards
    for row in edits.collect():
        cur, _ = R.apply_reward_edits(cur, spark.createDataFrame([row], edits.schema))
        cur = spark.createDataFrame(cur.collect(), rewards.schema)
    assert _snap(batch) == _snap(cur)
    assert {r.seq: r.success for r in res.collect()} == {1: True, 2: False, 3: True, 4: False}


def test_create_batch_equals_sequential(spark):
    """A rejected request inserts nothing, so it does not take the name from a later valid one."""
    rng = random.Random(9)
    cols = ("seq long, name string, brand string, new_status string, image_url string, "
            "price_2ml double, price_3ml double, price_5ml double, price_10ml double")
    rows = []
    for k in range(60):
        prices = [rng.choice([None, -1.0, 0.004, 0.005, 2.0, 1e20]) if rng.random() < 0.2 else 3.0 for _ in range(4)]
        rows.append((k, rng.choice(["A", "N1", "N2 ", "N3", " ", "N4"]), rng.choice(["b", "b", "b", " "]),
                     rng.choice([None, "published", "Hidden ", "secret"]), None, *prices))
    catalog, requests = _catalog(spark), spark.createDataFrame(rows, cols)
    batch = {r.seq: r.reject_reason for r in C.create_products(catalog, requests).collect()}
    names = {r.name for r in catalog.collect()}
    one_by_one = C.create_products(catalog.limit(0), requests.withColumn("name", requests.seq.cast("string"))).collect()
    wrong = {r.seq: r.reject_reason for r in one_by_one}   # rules that do not look at names
    want = {}
    for seq, name, *_ in rows:
        if wrong[seq] or not name.strip():
            want[seq] = wrong[seq] or "name_brand_required"
        elif name.strip() in names:
            want[seq] = "duplicate_name"
        else:
            want[seq] = None
            names.add(name.strip())
    blank = {seq for seq, name, *_ in rows if not name.strip()}
    assert {k: v for k, v in batch.items() if k not in blank} == {k: v for k, v in want.items() if k not in blank}
    assert all(batch[k] == "name_brand_required" for k in blank)
    assert sum(v is None for v in batch.values()) >= 2


def test_a_price_that_rounds_to_nothing_is_refused(spark):
    cols = "catalog_id long, seq long, price_2ml double, price_3ml double, price_5ml double, price_10ml double"
    changes = spark.createDataFrame([(1, 1, 0.004, 2.0, 2.0, 2.0), (1, 2, 1.00499996, 2.0, 2.0, 2.0), (4, 3, 1e20, 2.0, 2.0, 2.0),
                                     (4, 4, 99_999_999.999, 2.0, 2.0, 2.0)], cols)
    new, rejects = C.apply_price_changes(_catalog(spark), changes)
    assert {r.seq: r.reject_reason for r in rejects.collect()} == {1: "price_not_positive", 3: "price_out_of_range", 4: "price_out_of_range"}
    assert {r.id: str(r.price_2ml) for r in new.collect()}[1] == "1.00"
