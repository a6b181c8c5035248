"""Customer page lists, the deletion rules and the search of many queries."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from decantry.operators import customer_page as P
from decantry.operators import customers as U

T0 = dt.datetime(2024, 1, 1)


def _orders(spark, n, hot):
    rows = [(1 if i % 3 or i >= hot else i % 50, f"P-{i:06d}", Decimal(i) / 100, "ready", T0 + dt.timedelta(minutes=(i * 7919) % n)) for i in range(n)]
    rows += [(None, "P-guest", None, None, T0)]
    return spark.createDataFrame(rows, "customer_id long, order_number string, order_total decimal(12,2), status string, created_at timestamp_ntz")


@pytest.mark.parametrize("page_size,parts,batch", [(100, 4, 10_000), (7, 13, 10_000), (1, 3, 50), (64, 5, 33)])
def test_pages_hold_whole_lists_in_order(spark, page_size, parts, batch):
    orders = _orders(spark, 900, 900)
    library = spark.createDataFrame([(c, f"w{k:03d}", "ORDER-1") for c in (1, 2, 3) for k in range(40)] + [(1, None, "x")],
                                    "customer_id long, perfume string, source_code string")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(batch))
    try:
        pages = P.customer_pages(P.page_rows(library=library, orders=orders), page_size, parts).collect()
    finally:
        spark.conf.set(key, old)
    assert all(0 < len(p["items"]) <= page_size for p in pages)
    lists = {}
    for p in sorted(pages, key=lambda p: (p["customer_id"], p["kind"], p["page"])):
        own = lists.setdefault((p["customer_id"], p["kind"]), [])
        assert p["offset"] == len(own)
        own += [i["label"] for i in p["items"]]
    numbers = [p["page"] for p in pages if p["customer_id"] == 1 and p["kind"] == "orders"]
    assert sorted(numbers) == list(range(len(numbers)))
    want = {}
    for r in sorted(orders.filter("customer_id is not null").collect(), key=lambda r: (-r.created_at.timestamp(), r.order_number)):
        want.setdefault((r.customer_id, "orders"), []).append(r.order_number)
    for c in (1, 2, 3):
        want[c, "library"] = [None] * (c == 1) + [f"w{k:03d}" for k in range(40)]
    assert lists == want


def test_pages_take_one_exchange_for_all_children(spark):
    orders = _orders(spark, 90, 90)
    library = spark.createDataFrame([(1, "w", "s")], "customer_id long, perfume string, source_code string")
    rows = P.page_rows(library=library, orders=orders)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    pages = P.customer_pages(rows.limit(0))
    assert pages.count() == 0


def test_delete_rules_cover_every_table(spark):
    gone = spark.createDataFrame([(1,), (1,), (None,), (9,)], "customer_id long")
    tables = {"customers": spark.createDataFrame([(1,), (2,)], "id long"),
              **{n: spark.createDataFrame([(1, n), (2, n), (None, n)], "customer_id long, _gone_too string") for n in ("members", "codes", "notifications", "orders")}}
    assert set(tables) == set(U.ON_DELETE)
    out = {n: sorted((tuple(r) for r in df.collect()), key=repr) for n, df in U.delete_customers(gone, **tables).items()}
    assert out["customers"] == [(2,)]
    for n in ("members", "codes", "notifications"):
        assert out[n] == [(2, n), (None, n)]
    assert out["orders"] == [(2, "orders"), (None, "orders"), (None, "orders")]


def test_search_many_equals_the_literal_scan(spark):
    rnd = random.Random(3)
    people = [(i, rnd.choice(["Ana", "ANNA", "Bo", "Ünal", "a%b_c", "", "x"]) + (f" {i}" if i % 2 else "") if i % 7 else None,
               rnd.choice([f"+34 600 {i:06d}", None, "", "12"])) for i in range(120)]
    people = [(i, n, p) for i, n, p in people]
    frame = spark.createDataFrame(people, "id long, customer_name string, customer_phone string")
    asked = ["an", " ANA ", "a", "%", "_", "600 0000", "34", "ü", "", "  ", None, "zzz", "nna 1", "b_c", "+34 600 000005", "1", "a%b_c 3", "ana\n+3"]
    got = {}
    for r in U.search_many(frame, spark.createDataFrame([(q,) for q in asked], "q string")).collect():
        got.setdefault(r.q, []).append(r.id)
    assert all(len(v) == len(set(v)) for v in got.values())
    for q in {q.strip(" ").lower() for q in asked if q is not None}:
        want = sorted(r.id for r in U.search_customers(frame, q).collect())
        assert sorted(got.get(q, [])) == want, q


def test_search_many_has_no_nested_loop_over_customers(spark):
    frame = spark.createDataFrame([(1, "Ana", "1")], "id long, customer_name string, customer_phone string")
    found = U.search_many(frame, spark.createDataFrame([("an",)], "q string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_search_many_looks_whole_queries_up(spark):
    """A query meets the customers that hold it whole, however many share its pieces; long queries,
    runs that repeat in a text and rows that share an id."""
    long = "x" * U.RUN
    people = [(i, f"Customer#{i:09d}", f"+34 600 {i:06d}") for i in range(400)]
    people += [(900, long + "end", None), (901, long + "und", "1"), (902, "abab abab", "abab"), (None, "nobody", None), (903, "twin", "7"), (903, "twin", "8")]
    frame = spark.createDataFrame(people, "id long, customer_name string, customer_phone string")
    asked = ["omer#000000123", "00 000321", long + "END", "bab", "nobody", "twin", "8"]
    queries = spark.createDataFrame([(q,) for q in asked], "q string")
    got = sorted((r.q, r.id) for r in U.search_many(frame, queries).collect() if r.q != "8" or r.id == 903)
    assert got == [("00 000321", 321), ("8", 903), ("bab", 902), ("omer#000000123", 123),
                   *[("twin", 903)] * 4, (long + "end", 900)]
    names = frame.filter("id < 400").select("id", F.lower("customer_name").alias("_name"), F.col("customer_phone").alias("_phone"))
    index = U.run_index(names, F.array(F.lit(14)))
    assert index.join(queries.select(F.col("q").alias("run")), "run").count() == 1
