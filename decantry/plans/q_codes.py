"""Codes ledger queries (O-E*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from decantry.operators import codes as E
from decantry.plans.q_lifecycle import LIFE_VIEWS, _members
from decantry.plans.registry import query
from decantry.sources import driver as D


def code_requests(spark, d):
    """Codes are issued for delivered orders, naming the perfumes of the order."""
    o = D.f_orders(spark, d).filter(F.col("status") == "delivered")
    names = (D.f_items(spark, d).groupBy("order_id")
             .agg(F.array_sort(F.collect_set(F.trim("name"))).alias("perfumes")))
    return (o.join(names, o.id == names.order_id, "left")
            .select(F.col("id").alias("seq"), "order_number", "customer_name", "customer_phone", "order_total", "perfumes"))


@query("issue_codes", "O-E1", oracle="""
, req AS (
  SELECT o.id AS seq, trim(o.order_number) AS order_number, trim(o.customer_name) AS customer_name,
         'PR-' || upper(substr(sha256(trim(o.order_number) || '|' || trim(o.customer_name)), 1, 10)) AS code,
         CAST(round(o.order_total, 2) AS DECIMAL(12,2)) AS order_total,
         CAST(floor(o.order_total) AS BIGINT) AS bookmarks_awarded,
         coalesce(n.n, 0) AS n_perfumes,
         CASE WHEN coalesce(trim(o.order_number), '') = '' OR coalesce(trim(o.customer_name), '') = '' THEN 'fields_required'
              WHEN o.order_total IS NULL OR o.order_total < 0 THEN 'invalid_total'
              WHEN coalesce(n.n, 0) < 1 THEN 'no_perfumes' END AS reject_reason
  FROM f_orders o LEFT JOIN (SELECT order_id, count(DISTINCT trim(name)) AS n FROM f_items GROUP BY order_id) n ON n.order_id = o.id
  WHERE o.status = 'delivered')
SELECT r.*, coalesce(c.collision, false) AS collision
FROM req r LEFT JOIN (SELECT code, count(*) > 1 AS collision FROM req WHERE reject_reason IS NULL GROUP BY code) c
  ON c.code = r.code""")
def issue_codes(spark, d):
    return E.issue_codes(code_requests(spark, d))


def redemptions(spark, d):
    """'purchase' events redeem the code of order (user*20 + event%20)*5; some codes are unknown."""
    e = D.read(spark, d, "events").filter(F.col("event_type") == "purchase")
    num = F.concat(F.lit("P-"), F.lpad(((F.col("user_id") * 20 + F.col("event_id") % 20) * 5 + F.col("event_id") % 5).cast("string"), 8, "0"))
    code = F.concat(F.lit("PR-"), F.upper(F.substring(F.sha2(num, 256), 1, 10)))
    code = F.when(F.col("value") > 100, F.concat(F.lit("PR-UNKNOWN"), F.col("event_id").cast("string"))).otherwise(code)
    return e.select(code.alias("code"), F.col("user_id").alias("customer_id"), F.col("event_id").alias("seq"))


REDEMPTIONS_SQL = """
SELECT CASE WHEN value > 100 THEN 'PR-UNKNOWN' || CAST(event_id AS VARCHAR)
            ELSE 'PR-' || upper(substr(sha256('P-' || lpad(CAST((user_id * 20 + event_id % 20) * 5 + event_id % 5 AS VARCHAR), 8, '0')), 1, 10)) END AS code,
       user_id AS customer_id, event_id AS seq
FROM events WHERE event_type = 'purchase'"""

REDEEM_RESULTS_SQL = """
SELECT r.code, r.customer_id, r.seq,
       CASE WHEN c.code IS NULL THEN 'unknown_code'
            WHEN c.is_redeemed OR r.seq <> f.first_seq THEN 'already_redeemed' END AS reject_reason
FROM redemptions r LEFT JOIN f_codes c ON c.code = r.code
LEFT JOIN (SELECT r2.code, min(r2.seq) AS first_seq FROM redemptions r2 JOIN f_codes c2 ON c2.code = r2.code
           WHERE NOT c2.is_redeemed GROUP BY r2.code) f ON f.code = r.code"""


@query("redeem_code_results", "O-E2", oracle="SELECT * FROM redeem_results",
       extra_views={"redemptions": REDEMPTIONS_SQL, "redeem_results": REDEEM_RESULTS_SQL})
def redeem_code_results(spark, d):
    res, _, _ = E.redeem_codes(D.f_codes(spark, d), redemptions(spark, d), _members(spark, d))
    return res


@query("redeem_codes_library", "O-E2", oracle="""
SELECT a.customer_id, a.perfume, 'CODE-' || min(a.code) AS source_code
FROM (SELECT r.customer_id, trim(unnest(c.perfumes)) AS perfume, r.code
      FROM redeem_results r JOIN f_codes c ON c.code = r.code WHERE r.reject_reason IS NULL) a
WHERE a.perfume <> '' AND NOT EXISTS (SELECT 1 FROM members m WHERE m.customer_id = a.customer_id AND m.perfume = a.perfume)
GROUP BY a.customer_id, a.perfume""",
       extra_views={**LIFE_VIEWS, "redemptions": REDEMPTIONS_SQL, "redeem_results": REDEEM_RESULTS_SQL})
def redeem_codes_library(spark, d):
    _, lib, _ = E.redeem_codes(D.f_codes(spark, d), redemptions(spark, d), _members(spark, d))
    return lib


@query("list_codes", "O-E3", oracle="""
SELECT code, CASE WHEN is_redeemed THEN 'Canjeado' ELSE 'Pendiente' END AS status_label,
       coalesce(nullif(customer_name, ''), 'Sin nombre') AS customer_label,
       coalesce(nullif(order_number, ''), '—') AS order_label,
       array_to_string(perfumes, ', ') AS perfumes_text
FROM f_codes""")
def list_codes(spark, d):
    return E.list_codes(D.f_codes(spark, d))


def delete_requests(spark, d):
    """'error' events delete the code of an order; some come with blanks around it."""
    e = D.read(spark, d, "events").filter(F.col("event_type") == "error")
    num = F.concat(F.lit("P-"), F.lpad(((F.col("user_id") * 20 + F.col("event_id") % 20) * 5 + F.col("event_id") % 5).cast("string"), 8, "0"))
    code = F.concat(F.lit("PR-"), F.upper(F.substring(F.sha2(num, 256), 1, 10)))
    padded = F.when(F.col("value") > 40, F.concat(F.lit("  "), code, F.lit(" "))).otherwise(code)
    return e.select(F.col("event_id").alias("seq"), padded.alias("code"))


@query("delete_codes", "O-E4", oracle="""
, req AS (
  SELECT event_id AS seq,
         trim(CASE WHEN value > 40 THEN '  ' ELSE '' END
              || 'PR-' || upper(substr(sha256('P-' || lpad(CAST((user_id * 20 + event_id % 20) * 5 + event_id % 5 AS VARCHAR), 8, '0')), 1, 10))
              || CASE WHEN value > 40 THEN ' ' ELSE '' END) AS code
  FROM events WHERE event_type = 'error')
SELECT r.seq, r.code, CAST(CASE WHEN r.seq = f.first_seq THEN f.n ELSE 0 END AS BIGINT) AS deleted,
       r.seq = f.first_seq AND f.n > 0 AS success
FROM req r LEFT JOIN (SELECT r2.code, c.n, min(r2.seq) AS first_seq
                      FROM req r2 JOIN (SELECT code, count(*) AS n FROM f_codes GROUP BY code) c ON c.code = r2.code
                      GROUP BY r2.code, c.n) f ON f.code = r.code""")
def delete_codes(spark, d):
    res, _ = E.delete_codes(D.f_codes(spark, d), delete_requests(spark, d))
    return res.select("seq", "code", "deleted", F.coalesce("success", F.lit(False)).alias("success"))


@query("customer_codes", "O-E5", oracle="""
SELECT c.id AS customer_id, k.code, CAST(coalesce(k.order_total, 0) AS DECIMAL(12,2)) AS order_total,
       CAST(coalesce(k.bookmarks_awarded, 0) AS BIGINT) AS bookmarks_awarded, k.is_redeemed
FROM f_codes k JOIN f_customers c
  ON regexp_replace(coalesce(k.customer_phone, ''), '[^0-9]', '', 'g') = regexp_replace(coalesce(c.customer_phone, ''), '[^0-9]', '', 'g')
WHERE regexp_replace(coalesce(k.customer_phone, ''), '[^0-9]', '', 'g') <> ''""")
def customer_codes(spark, d):
    return E.customer_codes(D.f_codes_core(spark, d), D.f_customers(spark, d)).drop("order_number")
