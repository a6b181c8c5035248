"""Hand fixtures for the semantic edges."""

from decimal import Decimal

from pyspark.sql import functions as F

from decantry.functions import exprs as X
from decantry.operators import catalog as C
from decantry.operators import codes as E
from decantry.operators import orders as O
from decantry.operators import stats as S


def _items(spark, rows):
    return spark.createDataFrame(rows, "order_id long, name string, size string, qty string")


def test_size_and_qty_edges(spark):
    rows = [(1, "A", "10 ml", "2"), (2, "A", "2.5ml", None), (3, "A", "5.", ""), (4, "A", "", "0"),
            (5, "A", "10 ml x2", "1"), (6, "A", "1.2.3", "1"), (7, "A", ".", "1"), (8, "A", "3 ml", "x")]
    got = {r.order_id: r for r in O.typed_items(_items(spark, rows)).collect()}
    assert got[1].ml == Decimal("10") and got[1].qty_n == Decimal("2")
    assert got[2].ml == Decimal("2.5") and got[2].qty_n == Decimal("1")      # absent qty -> 1
    assert got[3].ml == Decimal("5") and got[3].qty_n == Decimal("1")        # '5.' parses, '' -> 1
    assert got[4].ml == Decimal("0") and got[4].qty_n == Decimal("0")        # '' size -> 0, explicit 0 stays 0
    assert got[5].ml == Decimal("102")                                       # documented behaviour
    assert got[6].quarantine and got[7].quarantine and got[8].quarantine
    assert not any(got[i].quarantine for i in (1, 2, 3, 4, 5))


def test_json_number_qty_and_padded_names(spark):
    raw = spark.createDataFrame(
        [(1, None, "  Ana  ", None, " Centro ", "  ", '[{"name":"  Eros ","size":"5 ml","qty":2},{"name":"CK One","size":"2 ml"}]', "12.345", None, None)],
        "request_id long, customer_id long, customer_name string, customer_phone string, delivery_zone string, "
        "notes string, items_json string, order_total string, reward_ids array<string>, created_at timestamp_ntz")
    out = O.ingest_orders(raw).collect()[0]
    assert out.reject_reason is None
    assert out.customer_name == "Ana" and out.delivery_zone == "Centro" and out.notes is None
    assert out.items[0]["qty"] == "2" and out.items[1]["qty"] is None
    assert out.order_total == Decimal("12.35")                               # half-up
    assert out.reward_ids == []
    ex = O.explode_items(spark.createDataFrame([(1, out.items)], "id long, items array<struct<name:string,size:string,qty:string>>"))
    got = sorted((r.perfume, r.ml, r.qty_n) for r in ex.collect())
    assert got == [("CK One", Decimal("2"), Decimal("1")), ("Eros", Decimal("5"), Decimal("2"))]


def test_ingest_reject_reasons(spark):
    schema = ("request_id long, customer_id long, customer_name string, customer_phone string, delivery_zone string, "
              "notes string, items_json string, order_total string, reward_ids array<string>, created_at timestamp_ntz")
    good = '[{"name":"Eros","size":"5 ml","qty":"1"}]'
    rows = [(1, None, " ", None, "Z", None, good, "1", None, None),
            (2, None, "A", None, "", None, good, "1", None, None),
            (3, None, "A", None, "Z", None, "[]", "1", None, None),
            (4, None, "A", None, "Z", None, '{"a":1}', "1", None, None),
            (5, None, "A", None, "Z", None, None, "1", None, None),
            (6, None, "A", None, "Z", None, good, "-0.01", None, None),
            (7, None, "A", None, "Z", None, good, None, None, None),
            (8, None, "A", None, "Z", None, good, "0", None, None)]
    got = {r.request_id: r.reject_reason for r in O.ingest_orders(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: "name_required", 2: "zone_required", 3: "empty_order", 4: "empty_order", 5: "empty_order",
                   6: "invalid_total", 7: "total_required", 8: None}


def test_order_number_never_truncates(spark):
    df = spark.createDataFrame([(1,), (12345,), (123456,)], "n long").select(X.order_number(F.col("n")).alias("o"))
    assert [r.o for r in df.collect()] == ["P-00001", "P-12345", "P-123456"]


def test_number_orders_dense_and_ordered(spark):
    import datetime as dt
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=(i * 7919) % 500)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, created_at timestamp_ntz")
    got = O.number_orders(df, num_partitions=7).select("id", "created_at", "seq").collect()
    want = sorted(rows, key=lambda r: (r[1], r[0]))
    assert [(r.id, r.seq) for r in sorted(got, key=lambda r: r.seq)] == [(w[0], i + 1) for i, w in enumerate(want)]


def test_bookmarks_floor_per_order(spark):
    # 3.90 + 3.20: floor per order gives 6, floor of the sum would give 7.
    orders = spark.createDataFrame([(1, 9, Decimal("3.90"), "delivered"), (2, 9, Decimal("3.20"), "delivered")],
                                   "id long, customer_id long, order_total decimal(12,2), status string")
    from decantry.operators.lifecycle import loyalty_balance
    fin = orders.select(F.col("id").alias("order_id"), "status")
    r = loyalty_balance(fin, orders).collect()[0]
    assert r.bookmarks == 6 and r.total_spent == Decimal("7.10")


def test_price_nulls_are_tested_before_least(spark):
    cat = spark.createDataFrame([(1, "A", None, None, None, None, None)],
                                "id long, name string, price_2ml decimal(10,2), price_3ml decimal(10,2), "
                                "price_5ml decimal(10,2), price_10ml decimal(10,2), deleted_at timestamp_ntz")
    ch = spark.createDataFrame([(1, 1, Decimal("1"), None, Decimal("1"), Decimal("1")),
                                (1, 2, Decimal("1"), Decimal("2"), Decimal("-1"), Decimal("1")),
                                (1, 3, Decimal("1.005"), Decimal("2"), Decimal("3"), Decimal("4"))],
                               "catalog_id long, seq long, price_2ml decimal(12,4), price_3ml decimal(12,4), "
                               "price_5ml decimal(12,4), price_10ml decimal(12,4)")
    new, rej = C.apply_price_changes(cat, ch)
    assert {r.seq: r.reject_reason for r in rej.collect()} == {1: "prices_incomplete", 2: "price_not_positive"}
    assert new.collect()[0].price_2ml == Decimal("1.01")                     # round half-up


def test_code_list_labels(spark):
    codes = spark.createDataFrame([("C1", True, None, "", ["A", "B"]), ("C2", False, "Ana", "P-1", [])],
                                  "code string, is_redeemed boolean, customer_name string, order_number string, perfumes array<string>")
    got = {r.code: r for r in E.list_codes(codes).collect()}
    assert (got["C1"].status_label, got["C1"].customer_label, got["C1"].order_label, got["C1"].perfumes_text) == \
        ("Canjeado", "Sin nombre", "—", "A, B")
    assert (got["C2"].status_label, got["C2"].customer_label, got["C2"].order_label) == ("Pendiente", "Ana", "P-1")


def test_exact_ratio_half_up(spark):
    df = spark.createDataFrame([(1, 8), (5, 0), (2, 3)], "n long, d long")
    got = [r.r for r in df.select(X.exact_ratio(F.col("n"), F.col("d"), 2).alias("r")).collect()]
    assert got == [Decimal("0.13"), None, Decimal("0.67")]


def test_orders_by_status_has_zero_rows(spark):
    orders = spark.createDataFrame([(1, "delivered"), (2, "delivered")], "id long, status string")
    got = {r.status: r.orders for r in S.orders_by_status(spark, orders).collect()}
    assert got == {"pending": 0, "preparing": 0, "ready": 0, "delivered": 2, "cancelled": 0}


def test_storefront_keeps_inactive_upcoming(spark):
    cat = spark.createDataFrame(
        [(1, "B", "x", "upcoming", False, None), (2, "A", "x", "hidden", True, None), (3, "C", "x", "published", True, None),
         (4, "D", "x", "published", True, "2020-01-01 00:00:00")],
        "id long, name string, brand string, availability_status string, active boolean, deleted_at string")
    cat = cat.withColumn("deleted_at", F.col("deleted_at").cast("timestamp_ntz"))
    for c in C.PRICE_COLS:
        cat = cat.withColumn(c, F.lit(1).cast("decimal(10,2)"))
    cat = cat.withColumn("image_url", F.lit(None).cast("string"))
    assert [r.id for r in C.storefront(cat, "name").collect()] == [1, 3]


def test_out_of_range_money_is_rejected_not_fatal(spark):
    schema = ("request_id long, customer_id long, customer_name string, customer_phone string, delivery_zone string, "
              "notes string, items_json string, order_total string, reward_ids array<string>, created_at timestamp_ntz")
    good = '[{"name":"Eros","size":"5 ml","qty":"1"}]'
    raw = spark.createDataFrame([(1, None, "A", None, "Z", None, good, "123456789", None, None)], schema)
    assert O.ingest_orders(raw).collect()[0].reject_reason == "invalid_total"
    cat = spark.createDataFrame([(1, "A", None, None, None, None, None)],
                                "id long, name string, price_2ml decimal(10,2), price_3ml decimal(10,2), "
                                "price_5ml decimal(10,2), price_10ml decimal(10,2), deleted_at timestamp_ntz")
    ch = spark.createDataFrame([(1, 1, Decimal("1"), Decimal("1"), Decimal("1"), Decimal("123456789"))],
                               "catalog_id long, seq long, price_2ml decimal(12,0), price_3ml decimal(12,0), "
                               "price_5ml decimal(12,0), price_10ml decimal(12,0)")
    new, rej = C.apply_price_changes(cat, ch)
    assert [r.reject_reason for r in rej.collect()] == ["price_out_of_range"]
    assert new.collect()[0].price_10ml is None


def test_name_order_binary_or_collated(spark):
    from decantry.sources import seeds
    cat = (seeds.catalog_seed(spark).filter(F.col("name").isin("Dior Homme Intense", "Détour Noir", "Eros"))
           .select(F.monotonically_increasing_id().alias("id"), "name", "brand", *C.PRICE_COLS,
                   F.lit("published").alias("availability_status"),
                   F.lit(None).cast("timestamp_ntz").alias("deleted_at"), F.lit(None).cast("string").alias("image_url")))
    binary = [r.name for r in C.storefront(cat, "name").collect()]
    human = [r.name for r in C.storefront(cat, "name", collation="UNICODE").collect()]
    assert binary == ["Dior Homme Intense", "Détour Noir", "Eros"]
    assert human == ["Détour Noir", "Dior Homme Intense", "Eros"]


def test_cluster_conf_sizing():
    from decantry.session import cluster_conf
    small = cluster_conf(total_cores=64, largest_shuffle_bytes=1 << 30)
    assert small["spark.sql.shuffle.partitions"] == str(3 * 64)          # cores dominate small shuffles
    big = cluster_conf(total_cores=8000, largest_shuffle_bytes=100 << 40)
    assert big["spark.sql.shuffle.partitions"] == str((100 << 40) // (512 << 20))
    assert big["spark.sql.adaptive.enabled"] == "true" and "RocksDB" in big["spark.sql.streaming.stateStore.providerClass"]
