"""The second outputs of change batches: rejects, results, and the tables left behind."""

from __future__ import annotations

from pyspark.sql import functions as F

from decantry.operators import catalog as C
from decantry.operators import codes as E
from decantry.operators import customers as U
from decantry.operators import lifecycle as L
from decantry.operators import rewards as R
from decantry.plans import q_catalog as QC
from decantry.plans import q_codes as QK
from decantry.plans import q_lifecycle as QL
from decantry.plans import q_rewards as QR
from decantry.plans.q_rewards import snapshot_balances
from decantry.plans.registry import query
from decantry.sources import driver as D


@query("manual_unlock_rejects", "O-B7", oracle="""
SELECT * FROM (SELECT customer_id, trim(perfume) AS perfume, seq,
                      CASE WHEN customer_id NOT IN (SELECT id FROM f_customers) THEN 'customer_not_found'
                           WHEN coalesce(trim(perfume), '') = '' THEN 'invalid_perfume' END AS reject_reason FROM changes)
WHERE reject_reason IS NOT NULL""", extra_views={"changes": QL.CHANGES_SQL})
def manual_unlock_rejects(spark, d):
    return L.apply_manual_unlocks(QL._library_snapshot(spark, d), D.f_notifications(spark, d), D.f_customers(spark, d),
                                  QL.manual_changes(spark, d))[2]


@query("status_change_rejects", "O-C5", oracle="""
, st AS (
  SELECT ch.catalog_id, ch.seq, lower(trim(coalesce(ch.new_status, ''))) AS norm, c.id IS NOT NULL AND c.deleted_at IS NULL AS live,
         (c.price_2ml IS NOT NULL AND c.price_3ml IS NOT NULL AND c.price_5ml IS NOT NULL AND c.price_10ml IS NOT NULL) AS has_prices,
         (SELECT min(v.seq) FROM valid_prices v WHERE v.catalog_id = ch.catalog_id) AS first_price_seq
  FROM changes ch LEFT JOIN f_catalog c ON c.id = ch.catalog_id WHERE ch.kind = 'status')
SELECT catalog_id, seq, CASE WHEN norm NOT IN ('published', 'upcoming', 'hidden') THEN 'invalid_status' WHEN NOT live THEN 'not_found'
                             ELSE 'prices_required' END AS reject_reason
FROM st WHERE NOT (norm IN ('published', 'upcoming', 'hidden') AND live
                   AND (norm <> 'published' OR has_prices OR coalesce(first_price_seq < seq, false)))""",
       extra_views={**QC.CH_VIEWS, "valid_prices": QC.VALID_PRICES_SQL})
def status_change_rejects(spark, d):
    return C.apply_status_changes(D.f_catalog(spark, d), QC._changes(spark, d, "status"), QC._changes(spark, d, "prices"))[1]


@query("stock_count_rejects", "O-C7", oracle="""
SELECT * FROM (SELECT ch.catalog_id, ch.seq,
                      CASE WHEN c.id IS NULL THEN 'not_found'
                           WHEN ch.available_ml < 0 OR ch.threshold_ml < 0 OR ch.available_ml >= 10000000 OR ch.threshold_ml >= 100000000
                           THEN 'invalid_stock' END AS reject_reason
               FROM changes ch LEFT JOIN f_catalog c ON c.id = ch.catalog_id WHERE ch.kind = 'stock') WHERE reject_reason IS NOT NULL""",
       extra_views=QC.CH_VIEWS)
def stock_count_rejects(spark, d):
    return C.apply_stock_counts(D.f_catalog(spark, d), QC._changes(spark, d, "stock"), D.f_orders_core(spark, d),
                                D.f_items_core(spark, d), D.item_names(spark, d))[1]


@query("image_change_rejects", "O-C9", oracle="""
SELECT ch.catalog_id, ch.seq, 'not_found' AS reject_reason FROM changes ch LEFT JOIN f_catalog c ON c.id = ch.catalog_id
WHERE ch.kind = 'image' AND (c.id IS NULL OR c.deleted_at IS NOT NULL)""", extra_views=QC.CH_VIEWS)
def image_change_rejects(spark, d):
    return C.apply_image_changes(D.f_catalog(spark, d), QC._changes(spark, d, "image"))[1]


@query("active_flag_rejects", "O-C10", oracle="""
SELECT ch.catalog_id, ch.seq, 'not_found' AS reject_reason FROM changes ch
WHERE ch.kind = 'active' AND ch.catalog_id NOT IN (SELECT id FROM f_catalog)""", extra_views=QC.CH_VIEWS)
def active_flag_rejects(spark, d):
    return C.apply_active_flags(D.f_catalog(spark, d), QC._changes(spark, d, "active"))[1]


def _storefront(key):
    @query(f"storefront_by_{key}", "O-C12", oracle=f"""
SELECT id, name, brand, availability_status, {QC._PRICES}, image_url, availability_status = 'upcoming' AS is_upcoming
FROM f_catalog WHERE availability_status <> 'hidden' AND deleted_at IS NULL""")
    def storefront(spark, d):
        return C.storefront(D.f_catalog(spark, d), key)
    return storefront


for _key in ("brand", "name"):
    _storefront(_key)


@query("rewards_after_deletes", "O-D5", oracle="""
SELECT id, threshold, reward_label, active FROM f_rewards
WHERE id NOT IN (SELECT 'reward-' || CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal > 5000)""")
def rewards_after_deletes(spark, d):
    """Rewards left when those of suppliers with a balance above 5000 are deleted."""
    s = D.read(spark, d, "supplier").filter(F.col("s_acctbal") > 5000)
    asked = s.select(F.concat(F.lit("reward-"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_suppkey").alias("seq"))
    return R.delete_rewards(D.f_rewards(spark, d), asked)[0].select("id", "threshold", "reward_label", "active")


@query("public_museum", "O-D9", oracle=f"SELECT {QR._MW} FROM f_museum")
def public_museum(spark, d):
    """The final form: every work with its flag."""
    return R.public_museum(D.f_museum(spark, d))


@query("museum_edit_results", "O-D10", oracle="""
SELECT perfume_name, seq, perfume_name IN (SELECT perfume_name FROM f_museum) AS success,
       CASE WHEN perfume_name NOT IN (SELECT perfume_name FROM f_museum) THEN 'not_found' END AS reject_reason
FROM (SELECT coalesce(CASE WHEN e.value > 120 THEN 'unknown #' || CAST(e.event_id AS VARCHAR) ELSE c.name END, '') AS perfume_name, e.event_id AS seq
      FROM events e LEFT JOIN f_catalog c ON c.id = e.event_id % (SELECT count(*) FROM part) WHERE e.event_type = 'click')""")
def museum_edit_results(spark, d):
    res = R.apply_museum_edits(D.f_museum(spark, d), QR.museum_edits(spark, d))[1]
    return res.withColumn("perfume_name", F.coalesce("perfume_name", F.lit("")))


@query("note_profile", "O-D12", oracle="""
SELECT m.customer_id, a.note, count(*) AS n_works
FROM members m JOIN (SELECT perfume_name, unnest(list_distinct(notes)) AS note FROM f_museum) a ON a.perfume_name = m.perfume
GROUP BY m.customer_id, a.note""", extra_views=QL.LIFE_VIEWS)
def note_profile(spark, d):
    return R.accord_profile(QL._members(spark, d), D.f_museum(spark, d), "notes", "note")


@query("codes_after_redemptions", "O-E2", oracle="""
SELECT code, is_redeemed OR code IN (SELECT code FROM redeem_results WHERE reject_reason IS NULL) AS is_redeemed FROM f_codes""",
       extra_views={"redemptions": QK.REDEMPTIONS_SQL, "redeem_results": QK.REDEEM_RESULTS_SQL})
def codes_after_redemptions(spark, d):
    after = E.redeem_codes(D.f_codes(spark, d), QK.redemptions(spark, d), QL._members(spark, d))[2]
    return after.select("code", "is_redeemed")


@query("codes_remaining", "O-E4", oracle="""
SELECT code, order_number FROM f_codes WHERE code NOT IN (
  SELECT 'PR-' || upper(substr(sha256('P-' || lpad(CAST((user_id * 20 + event_id % 20) * 5 + event_id % 5 AS VARCHAR), 8, '0')), 1, 10))
  FROM events WHERE event_type = 'error')""")
def codes_remaining(spark, d):
    return E.delete_codes(D.f_codes_core(spark, d), QK.delete_requests(spark, d))[1].select("code", "order_number")


@query("library_after_resets", "O-F7", oracle="""
SELECT customer_id, perfume FROM members WHERE customer_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)""",
       extra_views=QL.LIFE_VIEWS)
def library_after_resets(spark, d):
    """Collections of the customers that a reset of all with a balance above 5000 leaves alone."""
    asked = D.read(spark, d, "customer").filter(F.col("c_acctbal") > 5000).select(F.col("c_custkey").alias("customer_id"))
    return U.reset_customers(D.f_customers(spark, d), QL._members(spark, d), snapshot_balances(spark, d), asked)[1]
