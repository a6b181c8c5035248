"""Rewards and museum queries (O-A7 lives in q_orders; O-D* here)."""

from __future__ import annotations

from pyspark.sql import functions as F

from decantry.operators import rewards as R
from decantry.plans.q_lifecycle import LIFE_VIEWS, _members
from decantry.plans.registry import query
from decantry.sources import driver as D
from decantry.sources.driver import memo_view

_RW = "id, threshold, reward_label, active, sort_order"


@query("list_rewards", "O-D1", oracle=f"SELECT {_RW}, updated_at FROM f_rewards")
def list_rewards(spark, d):
    return R.list_rewards(D.f_rewards(spark, d))


@query("active_rewards", "O-D2", oracle=f"SELECT {_RW} FROM f_rewards WHERE active")
def active_rewards(spark, d):
    return R.active_rewards(D.f_rewards(spark, d))


def reward_edits(spark, d):
    e = D.read(spark, d, "events").filter(F.col("event_type") == "view")
    v = F.col("value")
    return e.select(F.concat(F.lit("reward-"), (F.col("user_id") % 150).cast("string")).alias("id"),
                    F.col("event_id").alias("seq"),
                    (F.floor(v * 1000) - 1000).cast("int").alias("threshold"),
                    F.concat(F.lit("  Edited "), F.col("event_id").cast("string"), F.lit("  ")).alias("reward_label"),
                    F.when(v > 100, F.lit(None).cast("boolean")).otherwise(v > 30).alias("active"),
                    F.when(v < 10, F.lit(None).cast("int")).otherwise(F.floor(v).cast("int")).alias("sort_order"))


EDITS_SQL = """
SELECT 'reward-' || CAST(user_id % 150 AS VARCHAR) AS id, event_id AS seq,
       CAST(floor(value * 1000) - 1000 AS INTEGER) AS threshold,
       '  Edited ' || CAST(event_id AS VARCHAR) || '  ' AS reward_label,
       CASE WHEN value > 100 THEN NULL ELSE value > 30 END AS active,
       CASE WHEN value < 10 THEN NULL ELSE CAST(floor(value) AS INTEGER) END AS sort_order
FROM events WHERE event_type = 'view'"""


@query("apply_reward_edits", "O-D3", oracle="""
SELECT r.id, coalesce(l.threshold, r.threshold) AS threshold, coalesce(l.reward_label, r.reward_label) AS reward_label,
       coalesce(l.active, r.active) AS active, coalesce(l.sort_order, r.sort_order) AS sort_order
FROM f_rewards r LEFT JOIN (
  SELECT id, arg_max(threshold, seq) AS threshold, arg_max(trim(reward_label), seq) AS reward_label,
         arg_max(coalesce(active, true), seq) AS active, arg_max(coalesce(sort_order, 0), seq) AS sort_order
  FROM edits WHERE id IN (SELECT id FROM f_rewards) AND threshold > 0 AND reward_label IS NOT NULL
  GROUP BY id) l ON l.id = r.id""", extra_views={"edits": EDITS_SQL})
def apply_reward_edits(spark, d):
    out, _ = R.apply_reward_edits(D.f_rewards(spark, d), reward_edits(spark, d))
    return out


@query("reward_edit_results", "O-D3", oracle="""
SELECT id, seq, (id IN (SELECT id FROM f_rewards) AND threshold > 0 AND reward_label IS NOT NULL) AS success,
       CASE WHEN id NOT IN (SELECT id FROM f_rewards) THEN 'not_found'
            WHEN threshold IS NULL OR threshold <= 0 THEN 'invalid_threshold'
            WHEN reward_label IS NULL THEN 'label_required' END AS reject_reason
FROM edits""", extra_views={"edits": EDITS_SQL})
def reward_edit_results(spark, d):
    _, res = R.apply_reward_edits(D.f_rewards(spark, d), reward_edits(spark, d))
    return res


@query("create_rewards", "O-D4", oracle="""
SELECT event_id AS seq,
       'reward_' || substr(sha256(CAST(event_id AS VARCHAR) || '|' || CAST(CAST(floor(value) AS INTEGER) - 10 AS VARCHAR) || '|'
                          || trim(CASE WHEN value < 25 THEN '   ' ELSE 'Reward ' || CAST(event_id AS VARCHAR) END)), 1, 32) AS id,
       CAST(floor(value) AS INTEGER) - 10 AS threshold,
       trim(CASE WHEN value < 25 THEN '   ' ELSE 'Reward ' || CAST(event_id AS VARCHAR) END) AS reward_label,
       NOT (value > 100) AS active, CAST(floor(value) AS INTEGER) - 10 AS sort_order,
       CASE WHEN CAST(floor(value) AS INTEGER) - 10 < 1 OR value < 25 THEN 'invalid_reward' END AS reject_reason
FROM events WHERE event_type = 'purchase'""")
def create_rewards(spark, d):
    e = D.read(spark, d, "events").filter(F.col("event_type") == "purchase")
    v = F.col("value")
    req = e.select(F.col("event_id").alias("seq"), (F.floor(v).cast("int") - 10).alias("threshold"),
                   F.when(v < 25, F.lit("   ")).otherwise(F.concat(F.lit("Reward "), F.col("event_id").cast("string"))).alias("reward_label"),
                   (~(v > 100)).alias("active"))
    return R.create_rewards(req)


@query("delete_rewards", "O-D5", oracle="""
SELECT q.id, q.seq, q.seq = coalesce(f.first_seq, -1) AS success
FROM (SELECT 'reward-' || CAST(event_id % (SELECT count(*) * 6 // 5 FROM supplier) AS VARCHAR) AS id, event_id AS seq FROM events WHERE event_type = 'error') q
LEFT JOIN (SELECT 'reward-' || CAST(event_id % (SELECT count(*) * 6 // 5 FROM supplier) AS VARCHAR) AS id, min(event_id) AS first_seq
           FROM events WHERE event_type = 'error' AND 'reward-' || CAST(event_id % (SELECT count(*) * 6 // 5 FROM supplier) AS VARCHAR) IN (SELECT id FROM f_rewards)
           GROUP BY 1) f ON f.id = q.id""")
def delete_rewards(spark, d):
    e = D.read(spark, d, "events").filter(F.col("event_type") == "error")
    req = e.select(F.concat(F.lit("reward-"), (F.col("event_id") % (D.row_count(spark, d, "supplier") * 6 // 5)).cast("string")).alias("id"),
                   F.col("event_id").alias("seq"))
    _, res = R.delete_rewards(D.f_rewards(spark, d), req)
    return res


@memo_view
def snapshot_balances(spark, d):
    """Customer balances implied by the order snapshot: accounted (delivered, non-guest) orders."""
    o = D.f_orders_core(spark, d).filter(F.col("accounted_at").isNotNull())
    return (o.groupBy("customer_id")
            .agg(F.sum("order_total").cast("decimal(18,2)").alias("total_spent"),
                 F.sum(F.floor("order_total")).cast("bigint").alias("bookmarks")))


BALANCES_SQL = """
SELECT customer_id, CAST(sum(order_total) AS DECIMAL(18,2)) AS total_spent,
       CAST(sum(floor(order_total)) AS BIGINT) AS bookmarks
FROM f_orders WHERE accounted_at IS NOT NULL GROUP BY customer_id"""


@query("unlocked_rewards", "O-D6", oracle="""
SELECT b.customer_id, b.bookmarks,
       (SELECT count(*) FROM f_rewards r WHERE r.active AND r.threshold <= b.bookmarks) AS n_unlocked,
       (SELECT max(threshold) FROM f_rewards r WHERE r.active AND r.threshold <= b.bookmarks) AS top_threshold,
       (SELECT min(threshold) FROM f_rewards r WHERE r.active AND r.threshold > b.bookmarks) AS next_threshold
FROM balances b""", extra_views={"balances": BALANCES_SQL})
def unlocked_rewards(spark, d):
    return R.unlocked_rewards(snapshot_balances(spark, d), D.f_rewards(spark, d))


def reward_claims(spark, d):
    """Orders that chose rewards claim them (first order per customer and reward wins)."""
    o = D.f_orders_core(spark, d).filter(F.col("customer_id").isNotNull())
    return o.select("customer_id", F.explode("reward_ids").alias("reward_id"), "order_number",
                    F.col("id").alias("seq"))


@query("claim_rewards", "O-D7", oracle="""
SELECT f.customer_id, f.reward_id, r.threshold, r.reward_label, 'claimed' AS status, f.num AS claimed_order_number
FROM (SELECT customer_id, reward_id, arg_min(order_number, id) AS num
      FROM (SELECT customer_id, unnest(reward_ids) AS reward_id, order_number, id FROM f_orders WHERE customer_id IS NOT NULL)
      GROUP BY customer_id, reward_id) f
JOIN f_rewards r ON r.id = f.reward_id AND r.active
JOIN balances b ON b.customer_id = f.customer_id AND r.threshold <= b.bookmarks""",
       extra_views={"balances": BALANCES_SQL})
def claim_rewards(spark, d):
    return R.claim_rewards(reward_claims(spark, d), D.f_rewards(spark, d), snapshot_balances(spark, d))


_MW = "perfume_name, brand, artwork_path, description, published"


@query("list_museum", "O-D8", oracle=f"SELECT {_MW}, updated_at FROM f_museum")
def list_museum(spark, d):
    return R.list_museum(D.f_museum(spark, d))


@query("public_museum_published", "O-D9", oracle=f"SELECT {_MW} FROM f_museum WHERE published")
def public_museum_published(spark, d):
    return R.public_museum(D.f_museum(spark, d), published_only=True)


def museum_edits(spark, d):
    e = D.read(spark, d, "events").filter(F.col("event_type") == "click")
    cat = D.f_catalog(spark, d).select(F.col("id").alias("_pk"), F.col("name").alias("_name"))
    v = F.col("value")
    base = e.select((F.col("event_id") % D.row_count(spark, d, "part")).alias("_pk"), F.col("event_id").alias("seq"), v.alias("_v"))
    return (base.join(cat, "_pk", "left").select(
        F.when(F.col("_v") > 120, F.concat(F.lit("unknown #"), F.col("seq").cast("string"))).otherwise(F.col("_name")).alias("perfume_name"),
        "seq",
        F.concat(F.lit("  art/"), F.col("seq").cast("string"), F.lit(".webp ")).alias("artwork_path"),
        F.concat(F.lit(" edited "), F.col("seq").cast("string")).alias("description"),
        F.when(F.col("_v") < 20, F.lit(None).cast("boolean")).otherwise(F.col("_v") > 50).alias("published")))


@query("apply_museum_edits", "O-D10", oracle="""
SELECT m.perfume_name, m.brand, coalesce(l.artwork_path, m.artwork_path) AS artwork_path,
       coalesce(l.description, m.description) AS description, coalesce(l.published, m.published) AS published
FROM f_museum m LEFT JOIN (
  SELECT perfume_name, arg_max(trim(artwork_path), seq) AS artwork_path, arg_max(trim(description), seq) AS description,
         arg_max(coalesce(published, true), seq) AS published
  FROM (SELECT CASE WHEN e.value > 120 THEN 'unknown #' || CAST(e.event_id AS VARCHAR) ELSE c.name END AS perfume_name,
               e.event_id AS seq, '  art/' || CAST(e.event_id AS VARCHAR) || '.webp ' AS artwork_path,
               ' edited ' || CAST(e.event_id AS VARCHAR) AS description,
               CASE WHEN e.value < 20 THEN NULL ELSE e.value > 50 END AS published
        FROM events e LEFT JOIN f_catalog c ON c.id = e.event_id % (SELECT count(*) FROM part) WHERE e.event_type = 'click')
  GROUP BY perfume_name) l ON l.perfume_name = m.perfume_name""")
def apply_museum_edits(spark, d):
    out, _ = R.apply_museum_edits(D.f_museum(spark, d), museum_edits(spark, d))
    return out


@query("museum_image_fallback", "O-D13", oracle="""
SELECT m.perfume_name, m.artwork_path, c.image_url, coalesce(nullif(m.artwork_path, ''), c.image_url) AS display_image
FROM f_museum m LEFT JOIN f_catalog c ON c.name = m.perfume_name""")
def museum_image_fallback(spark, d):
    return R.museum_image_fallback(D.f_museum(spark, d), D.f_catalog(spark, d))


@query("accord_profile", "O-D12", oracle="""
SELECT m.customer_id, a.accord, count(*) AS n_works
FROM members m JOIN (SELECT perfume_name, unnest(list_distinct(accords)) AS accord FROM f_museum) a ON a.perfume_name = m.perfume
GROUP BY m.customer_id, a.accord""", extra_views=LIFE_VIEWS)
def accord_profile(spark, d):
    return R.accord_profile(_members(spark, d), D.f_museum(spark, d))


@query("artwork_corpus", "O-D11", oracle="""
SELECT perfume_name AS id, perfume_name AS name, brand, artwork_path AS artwork, description,
       array_to_string(accords, ', ') AS accords, array_to_string(notes, ', ') AS notes
FROM f_museum""")
def artwork_corpus(spark, d):
    """Museum works written as JSON documents ({"works": [...]}, one per line) under the
    checkpoint folder by Spark, then read back through the corpus reader (explicit schema)."""
    import uuid

    from decantry.session import ensure_checkpoint_dir
    from decantry.sources import artworks as A
    path = ensure_checkpoint_dir(spark).rstrip("/") + f"/artworks-{uuid.uuid4().hex[:12]}"
    A.write_artworks(D.f_museum(spark, d), path)
    works = A.read_artworks(spark, path, multi_line=False)
    return works.select("id", "name", "brand", "artwork", "description", F.array_join("accords", ", ").alias("accords"),
                        F.array_join("notes", ", ").alias("notes"))
