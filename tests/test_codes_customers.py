"""Codes, customers and historic imports on hand fixtures."""

import datetime as dt
from decimal import Decimal

from decantry.operators import codes as E
from decantry.operators import customers as U
from decantry.operators import orders as O

CODE_SCHEMA = ("code string, customer_name string, customer_phone string, order_number string, "
               "order_total decimal(12,2), perfumes array<string>, bookmarks_awarded int, is_redeemed boolean")


def test_issue_codes_validation_and_collisions(spark):
    req = spark.createDataFrame(
        [(1, "P-1", "Ana", None, "10.50", ["Eros"]), (2, " ", "Ana", None, "1", ["Eros"]),
         (3, "P-3", "Bo", None, "-1", ["Eros"]), (4, "P-4", "Bo", None, "3.99", []),
         (5, "P-1", "Ana", None, "7", ["CK One"])],
        "seq long, order_number string, customer_name string, customer_phone string, order_total string, perfumes array<string>")
    got = {r.seq: r for r in E.issue_codes(req).collect()}
    assert [got[i].reject_reason for i in range(1, 6)] == [None, "fields_required", "invalid_total", "no_perfumes", None]
    assert got[1].bookmarks_awarded == 10 and got[1].order_total == Decimal("10.50")
    assert got[1].code == got[5].code and got[1].collision and got[5].collision
    assert got[1].code.startswith("PR-") and len(got[1].code) == 13


def test_redeem_codes_first_wins_and_adds_missing_perfumes(spark):
    codes = spark.createDataFrame([("C1", "Ana", None, "P-1", Decimal(1), ["Eros", " CK One "], 1, False),
                                   ("C2", "Bo", None, "P-2", Decimal(1), ["Sauvage"], 1, True)], CODE_SCHEMA)
    lib = spark.createDataFrame([(7, "Eros", "ORDER-P-9")], "customer_id long, perfume string, source_code string")
    red = spark.createDataFrame([(" C1 ", 7, 2), ("C1", 8, 1), ("C2", 7, 3), ("NOPE", 7, 4)],
                                "code string, customer_id long, seq long")
    res, adds, after = E.redeem_codes(codes, red, lib)
    assert {r.seq: r.reject_reason for r in res.collect()} == {1: None, 2: "already_redeemed", 3: "already_redeemed",
                                                               4: "unknown_code"}
    assert sorted((r.customer_id, r.perfume, r.source_code) for r in adds.collect()) == \
        [(8, "CK One", "CODE-C1"), (8, "Eros", "CODE-C1")]
    assert {r.code: r.is_redeemed for r in after.collect()} == {"C1": True, "C2": True}


def test_delete_codes_counts(spark):
    codes = spark.createDataFrame([("C1", None, None, None, None, [], None, False),
                                   ("C2", None, None, None, None, [], None, False)], CODE_SCHEMA)
    req = spark.createDataFrame([(1, " C1 "), (2, "C1"), (3, "C9")], "seq long, code string")
    res, remaining = E.delete_codes(codes, req)
    assert {r.seq: (r.deleted, r.success) for r in res.collect()} == {1: (1, True), 2: (0, False), 3: (0, False)}
    assert [r.code for r in remaining.collect()] == ["C2"]


def test_customer_codes_match_on_phone_digits(spark):
    codes = spark.createDataFrame([("C1", "Ana", "+34 600-000-001", "P-1", None, [], None, False)], CODE_SCHEMA)
    cust = spark.createDataFrame([(1, "Ana", "34600000001")], "id long, customer_name string, customer_phone string")
    r = E.customer_codes(codes, cust).collect()[0]
    assert (r.customer_id, r.order_total, r.bookmarks_awarded) == (1, Decimal("0.00"), 0)


def test_customer_edits_delete_and_reset(spark):
    cust = spark.createDataFrame([(1, "Ana", "600", dt.datetime(2020, 1, 1)), (2, "Bo", "601", dt.datetime(2020, 1, 2))],
                                 "id long, customer_name string, customer_phone string, created_at timestamp_ntz")
    bal = spark.createDataFrame([(1, Decimal("10.00"), 10), (2, Decimal("5.00"), 5)],
                                "customer_id long, total_spent decimal(18,2), bookmarks bigint")
    edits = spark.createDataFrame([(1, 1, "A1", "700", 3, Decimal("1.00")), (1, 2, "A2", "701", 4, Decimal("2.00"))],
                                  "customer_id long, seq long, customer_name string, customer_phone string, "
                                  "bookmarks bigint, total_spent decimal(18,2)")
    got = {r.customer_id: tuple(r)[1:] for r in U.apply_customer_edits(cust, bal, edits).collect()}
    assert got == {1: ("A2", "701", 4, Decimal("2.00")), 2: ("Bo", "601", 5, Decimal("5.00"))}
    orders = spark.createDataFrame([(10, 1), (11, 2), (12, None)], "id long, customer_id long")
    out = U.delete_customers(spark.createDataFrame([(1,)], "customer_id long"), customers=cust, orders=orders)
    assert sorted((r.id, r.customer_id) for r in out["orders"].collect()) == [(10, None), (11, 2), (12, None)]
    assert [r.id for r in out["customers"].collect()] == [2]
    members = spark.createDataFrame([(1, "Eros"), (2, "CK One")], "customer_id long, perfume string")
    after, lib = U.reset_customers(cust, members, bal, spark.createDataFrame([(2,)], "customer_id long"))
    assert {r.customer_id: (r.bookmarks, r.total_spent) for r in after.collect()} == \
        {1: (10, Decimal("10.00")), 2: (0, Decimal("0.00"))}
    assert [(r.customer_id, r.perfume) for r in lib.collect()] == [(1, "Eros")]


def test_import_historic_prefix_and_existing_numbers(spark):
    orders = spark.createDataFrame([("P-H001",)], "order_number string")
    cust = spark.createDataFrame([(1, "Alfonso Ruiz", dt.datetime(2021, 1, 1)), (2, "alfonsina", dt.datetime(2020, 1, 1)),
                                  (3, "Luis", dt.datetime(2022, 1, 1)), (4, "LUISA", dt.datetime(2019, 1, 1))],
                                 "id long, customer_name string, created_at timestamp_ntz")
    imports = spark.createDataFrame([("P-H001", 1, "alfonso", "Alfonso", "x", None, Decimal("24.37")),
                                     ("P-H002", 2, "luis", "Luis", "x", None, Decimal("3.06")),
                                     ("P-H003", 3, "zed", "Zed", "x", None, Decimal("1"))],
                                    "order_number string, seq long, prefix string, customer_name string, delivery_zone string, "
                                    "notes string, order_total decimal(12,2)")
    got = {r.order_number: r.customer_id for r in O.import_historic(orders, imports, cust).collect()}
    # P-H001 already exists; 'luis' matches Luis and LUISA, the earlier profile wins; 'zed' matches none.
    assert got == {"P-H002": 4, "P-H003": None}


def test_unlocked_rewards_and_claims_brute(spark):
    import random

    from decantry.operators import rewards as R
    rng = random.Random(4)
    thresholds = [rng.choice([5, 4095, 4096, 4097, 70_000, 2**24 - 1, 2**24, 2**31 - 1, rng.randint(1, 2**31 - 1), rng.randint(1, 9000)]) for _ in range(90)]
    rewards = spark.createDataFrame([("r%d" % i, t, "L%d" % i, i % 5 != 0, i) for i, t in enumerate(thresholds)],
                                    "id string, threshold int, reward_label string, active boolean, sort_order int")
    values = [None, -7, 0, 1, 2**40, 2**31 - 1, *thresholds, *[t - 1 for t in thresholds], *[t + 1 for t in thresholds], 0, 0]
    bal = spark.createDataFrame(list(enumerate(values)), "customer_id long, bookmarks long")
    live = [t for i, t in enumerate(thresholds) if i % 5]
    want = sorted((c, str(b), sum(t <= b for t in live) if b is not None else 0,
                   str(max([t for t in live if b is not None and t <= b], default=None)),
                   str(min([t for t in live if t > b], default=None) if b is not None else None)) for c, b in enumerate(values))
    out = R.unlocked_rewards(bal, rewards)
    got = sorted((r.customer_id, str(r.bookmarks), r.n_unlocked, str(r.top_threshold), str(r.next_threshold)) for r in out.collect())
    assert got == want
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    claims = [(rng.randrange(len(values)), "r%d" % rng.randrange(95), "P-%d" % k, k) for k in range(400)]
    rows = R.claim_rewards(spark.createDataFrame(claims, "customer_id long, reward_id string, order_number string, seq long"), rewards, bal).collect()
    first = {}
    for c, r, num, _ in claims:
        i = int(r[1:])
        if i < 90 and i % 5 and values[c] is not None and thresholds[i] <= values[c]:
            first.setdefault((c, r), num)
    assert {(r.customer_id, r.reward_id): r.claimed_order_number for r in rows} == first and len(rows) == len(first)


def test_rewards_at_a_million_by_a_million(spark):
    """No pairs: a million rewards and a million customers are a few bounded windows."""
    from pyspark.sql import functions as F

    from decantry.operators import rewards as R
    n = 1_000_000
    rewards = spark.range(n).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("id"), (F.col("id") * 3 + 1).cast("int").alias("threshold"),
                                    F.lit("x").alias("reward_label"), F.lit(True).alias("active"), F.lit(0).alias("sort_order"))
    bal = spark.range(n).select(F.col("id").alias("customer_id"), (F.col("id") * 3).alias("bookmarks"))
    wrong = R.unlocked_rewards(bal, rewards).where("n_unlocked <> customer_id or not next_threshold <=> cast(bookmarks + 1 as int)")
    assert wrong.count() == 0


def test_import_keeps_the_first_of_one_number(spark):
    from decantry.operators import orders as O
    cols = "order_number string, seq long, prefix string, customer_name string, delivery_zone string, notes string, order_total double"
    imports = spark.createDataFrame([("P-H1", 2, "b", "B", "z", None, 2.0), ("P-H1", 1, "a", "A", "z", None, 1.004999), ("P-H2", 3, "", "C", "z", "n", 1e20)], cols)
    customers = spark.createDataFrame([(1, "Ana", "2024-01-01"), (2, "bea", "2023-01-01")], "id long, customer_name string, created_at string")
    out = O.import_historic(spark.createDataFrame([], "order_number string"), imports, customers)
    assert "NestedLoop" not in out._jdf.queryExecution().toString()
    got = {r.order_number: (r.customer_name, r.customer_id, str(r.order_total)) for r in out.collect()}
    assert got == {"P-H1": ("A", 1, "1.00"), "P-H2": ("C", 2, "None")}


def test_profile_without_a_phone_matches_no_request(spark):
    from decantry.operators import orders as O
    customers = spark.createDataFrame([(1, None, "t", "2024-01-01"), (2, "600 1", "t", "2024-01-02")],
                                      "id long, customer_phone string, access_token string, created_at string")
    asked = spark.createDataFrame([(1, "", "t"), (2, None, "t"), (3, "6001", "t")], "request_id long, phone string, token string")
    assert {r.request_id: r.customer_id for r in O.resolve_profiles(asked, customers).collect()} == {1: None, 2: None, 3: 2}


def test_history_of_credentials_comes_newest_first_and_once(spark):
    from decantry.operators import orders as O
    customers = spark.createDataFrame([(1, "1", "t", "2024-01-01"), (2, "2", "t", "2024-01-01")],
                                      "id long, customer_phone string, access_token string, created_at string")
    asked = spark.createDataFrame([(k, str(1 + k % 2), "t") for k in range(10)], "request_id long, phone string, token string")
    orders = spark.createDataFrame([(k, "P-%d" % k, 1 + k % 2, "2024-01-%02d" % (1 + k * 7 % 28)) for k in range(20)],
                                   "id long, order_number string, customer_id long, created_at string")
    rows = O.orders_for_credentials(asked, customers, orders).collect()
    assert len(rows) == 20
    assert [(r.customer_id, r.created_at) for r in rows] == sorted(((r.customer_id, r.created_at) for r in rows), key=lambda x: (x[0], [-ord(c) for c in x[1]]))


def test_codes_floor_and_round_the_raw_total(spark):
    from decantry.operators import codes as E
    req = spark.createDataFrame([(1, "o1", "n", 24.99996, ["p"]), (2, "o2", "n", -0.00001, ["p"]), (3, "o3", "n", 1e20, ["p"])],
                                "seq long, order_number string, customer_name string, order_total double, perfumes array<string>")
    got = {r.seq: (str(r.order_total), r.bookmarks_awarded, r.reject_reason) for r in E.issue_codes(req).collect()}
    assert got[1] == ("25.00", 24, None) and got[2][2] == got[3][2] == "invalid_total"
