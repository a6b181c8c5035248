"""Every reject reason and outcome that the driver's data should reach has a row."""

import pytest

from decantry.plans.registry import load_all

Q = load_all()


@pytest.mark.parametrize("name,column,wanted", [
    ("ingest_orders", "reject_reason", {None, "name_required", "zone_required", "empty_order", "invalid_total", "total_required"}),
    ("validate_status_events", "reject_reason", {None, "invalid_status", "order_not_found"}),
    ("manual_unlock_rejects", "reject_reason", {"customer_not_found", "invalid_perfume"}),
    ("status_change_rejects", "reject_reason", {"invalid_status", "not_found", "prices_required"}),
    ("stock_count_rejects", "reject_reason", {"not_found", "invalid_stock"}),
    ("price_change_rejects", "reject_reason", {"not_found", "deleted", "prices_incomplete", "price_not_positive"}),
    ("museum_edit_results", "reject_reason", {None, "not_found"}),
    ("redeem_code_results", "reject_reason", {None, "unknown_code", "already_redeemed"}),
    ("list_codes", "status_label", {"Canjeado", "Pendiente"}),
])
def test_each_branch_has_a_row(spark, name, column, wanted):
    seen = {r[0] for r in Q[name].fn(spark, "/root/testdata/sf0.01").select(column).distinct().collect()}
    assert wanted <= seen, seen


def test_the_ownership_fold_meets_transfers_and_several_owners(spark):
    """The views give customers that hold one perfume by several orders, over much of the catalogue."""
    from pyspark.sql import functions as F

    from decantry.sources import driver as D
    d = "/root/testdata/sf0.01"
    held = D.f_lifecycle_items(spark, d).join(D.f_lifecycle_orders(spark, d).select(F.col("id").alias("order_id"), "customer_id"), "order_id")
    per = held.filter("name is not null").groupBy("customer_id", "name").agg(F.count_distinct("order_id").alias("n"))
    assert per.filter("n > 2").count() > 1000
    assert held.select("name").distinct().count() > D.row_count(spark, d, "part") / 3


def test_validate_status_events_lays_rows_out_by_number(spark):
    """The layout follows the number of rows, which AQE does not merge again; odd keys keep their reasons."""
    from decantry.operators import lifecycle as L
    from decantry.session import parts_for
    events = spark.createDataFrame([(1, 1, "ready"), (1, 2, "lost"), (1, 3, None), (None, 4, "ready"), (9, 5, "pending"), (9, 6, "lost")],
                                   "order_id long, seq long, new_status string")
    orders = spark.createDataFrame([(1,), (1,), (None,), (2,)], "id long")
    assert parts_for(spark, 10 ** 8) == 200
    for parts in (None, 13):
        valid, rejected = L.validate_status_events(events, orders, parts)
        assert [(r.order_id, r.seq) for r in valid.collect()] == [(1, 1)]
        assert sorted((r.seq, r.reject_reason) for r in rejected.collect()) == [
            (2, "invalid_status"), (3, "invalid_status"), (4, "order_not_found"), (5, "order_not_found"), (6, "invalid_status")]
    assert "REPARTITION_BY_NUM" in valid._jdf.queryExecution().executedPlan().toString()
