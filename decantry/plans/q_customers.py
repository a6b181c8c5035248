"""Customer and ranking queries (O-F*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from decantry.operators import codes as E
from decantry.operators import customers as U
from decantry.operators import rewards as R
from decantry.plans.q_lifecycle import LIFE_VIEWS, _members
from decantry.plans.q_rewards import BALANCES_SQL, snapshot_balances
from decantry.plans.registry import query
from decantry.session import parts_for
from decantry.sources import driver as D

_LEVEL_SQL = "['Initiate', 'Explorer', 'Connoisseur', 'Collector', 'Curator'][least(4, ({n} * 4) // greatest({t}, 1)) + 1]"


RANKING_SQL = f"""
SELECT row_number() OVER (ORDER BY library_count DESC, created_at, customer_id) AS position, customer_id,
       substr(customer_name, 1, 3) || '*** #' || CAST(customer_id AS VARCHAR) AS alias, library_count,
       {_LEVEL_SQL.format(n='library_count', t='(SELECT count(*) FROM f_museum)')} AS level,
       customer_id = 7 AS is_caller
FROM (SELECT c.id AS customer_id, c.customer_name, c.created_at, count(*) AS library_count
      FROM f_customers c JOIN members m ON m.customer_id = c.id WHERE c.ranking_opt_in
      GROUP BY c.id, c.customer_name, c.created_at
      ORDER BY library_count DESC, c.created_at, c.id LIMIT 10)"""

# The ranking as seen by customer 7 (whose row, if in the top 10, is highlighted).
RANKING_CALLER = 7


@query("collection_ranking", "O-F1", oracle="SELECT * FROM ranking", extra_views={**LIFE_VIEWS, "ranking": RANKING_SQL})
def collection_ranking(spark, d):
    return U.collection_ranking(_members(spark, d), D.f_customers(spark, d), D.f_museum(spark, d), top_k=10,
                                caller_id=RANKING_CALLER)


@query("ranking_header", "O-F1", oracle="""
SELECT count(*) AS participants, coalesce(arg_min(alias, position), '—') AS leader,
       CAST(coalesce(arg_min(library_count, position), 0) AS BIGINT) AS largest_library
FROM ranking""", extra_views={**LIFE_VIEWS, "ranking": RANKING_SQL})
def ranking_header(spark, d):
    return U.ranking_header(collection_ranking(spark, d))


@query("list_customers", "O-F2", oracle="""
SELECT c.id AS customer_id, c.customer_name, c.customer_phone, CAST(coalesce(w.n, 0) AS BIGINT) AS works,
       CAST(coalesce(b.bookmarks, 0) AS BIGINT) AS bookmarks, CAST(coalesce(b.total_spent, 0) AS DECIMAL(18,2)) AS total_spent
FROM f_customers c LEFT JOIN (SELECT customer_id, count(*) AS n FROM members GROUP BY customer_id) w ON w.customer_id = c.id
LEFT JOIN balances b ON b.customer_id = c.id""", extra_views={**LIFE_VIEWS, "balances": BALANCES_SQL})
def list_customers(spark, d):
    return U.list_customers(D.f_customers(spark, d), _members(spark, d), snapshot_balances(spark, d))


SEARCH_Q = " #0000001 "


@query("search_customers", "O-F3", oracle="""
SELECT id, customer_name, customer_phone FROM f_customers
WHERE contains(lower(customer_name), '#0000001') OR contains(customer_phone, '#0000001')""")
def search_customers(spark, d):
    return U.search_customers(D.f_customers(spark, d), SEARCH_Q).select("id", "customer_name", "customer_phone")


def _codes_by_customer(spark, d):
    return E.customer_codes(D.f_codes_core(spark, d), D.f_customers(spark, d))


@query("customer_360", "O-F4", oracle=f"""
SELECT c.id AS customer_id, c.customer_name, c.customer_phone,
       CAST(coalesce(o.n_orders, 0) AS BIGINT) AS n_orders, CAST(coalesce(o.n_delivered, 0) AS BIGINT) AS n_delivered,
       CAST(coalesce(b.total_spent, 0) AS DECIMAL(18,2)) AS total_spent, CAST(coalesce(b.bookmarks, 0) AS BIGINT) AS bookmarks,
       CAST(coalesce(l.n, 0) AS BIGINT) AS n_library, CAST(coalesce(k.n, 0) AS BIGINT) AS n_codes,
       CAST(coalesce(u.n_unlocked, 0) AS BIGINT) AS n_unlocked,
       {_LEVEL_SQL.format(n='coalesce(l.n, 0)', t='(SELECT count(*) FROM f_museum)')} AS level
FROM f_customers c
LEFT JOIN (SELECT customer_id, count(*) AS n_orders, count(*) FILTER (WHERE status = 'delivered') AS n_delivered
           FROM f_orders WHERE customer_id IS NOT NULL GROUP BY customer_id) o ON o.customer_id = c.id
LEFT JOIN balances b ON b.customer_id = c.id
LEFT JOIN (SELECT customer_id, count(*) AS n FROM members GROUP BY customer_id) l ON l.customer_id = c.id
LEFT JOIN (SELECT c2.id AS customer_id, count(*) AS n FROM f_codes k2 JOIN f_customers c2
             ON regexp_replace(k2.customer_phone, '[^0-9]', '', 'g') = regexp_replace(c2.customer_phone, '[^0-9]', '', 'g')
           GROUP BY c2.id) k ON k.customer_id = c.id
LEFT JOIN (SELECT b2.customer_id, (SELECT count(*) FROM f_rewards r WHERE r.active AND r.threshold <= b2.bookmarks) AS n_unlocked
           FROM balances b2) u ON u.customer_id = c.id""", extra_views={**LIFE_VIEWS, "balances": BALANCES_SQL})
def customer_360(spark, d):
    bal = snapshot_balances(spark, d)
    return U.customer_360(D.f_customers(spark, d), D.f_orders_core(spark, d), _members(spark, d), bal,
                          _codes_by_customer(spark, d), R.unlocked_rewards(bal, D.f_rewards(spark, d)),
                          D.f_museum(spark, d))


@query("apply_customer_edits", "O-F5", oracle="""
SELECT c.id AS customer_id,
       CASE WHEN e.customer_id IS NOT NULL THEN e.customer_name ELSE c.customer_name END AS customer_name,
       CASE WHEN e.customer_id IS NOT NULL THEN e.customer_phone ELSE c.customer_phone END AS customer_phone,
       CAST(CASE WHEN e.customer_id IS NOT NULL THEN e.bookmarks ELSE coalesce(b.bookmarks, 0) END AS BIGINT) AS bookmarks,
       CAST(CASE WHEN e.customer_id IS NOT NULL THEN e.total_spent ELSE coalesce(b.total_spent, 0) END AS DECIMAL(18,2)) AS total_spent
FROM f_customers c LEFT JOIN balances b ON b.customer_id = c.id
LEFT JOIN (SELECT user_id AS customer_id, arg_max('Edited ' || CAST(event_id AS VARCHAR), event_id) AS customer_name,
                  arg_max('+34 611 ' || lpad(CAST(user_id AS VARCHAR), 6, '0'), event_id) AS customer_phone,
                  arg_max(CAST(floor(value) AS BIGINT), event_id) AS bookmarks,
                  arg_max(CAST(value AS DECIMAL(18,2)), event_id) AS total_spent
           FROM events WHERE event_type = 'view' GROUP BY user_id) e ON e.customer_id = c.id""",
       extra_views={"balances": BALANCES_SQL})
def apply_customer_edits(spark, d):
    e = D.read(spark, d, "events").filter(F.col("event_type") == "view")
    edits = e.select(F.col("user_id").alias("customer_id"), F.col("event_id").alias("seq"),
                     F.concat(F.lit("Edited "), F.col("event_id").cast("string")).alias("customer_name"),
                     F.concat(F.lit("+34 611 "), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("customer_phone"),
                     F.floor("value").cast("bigint").alias("bookmarks"),
                     F.col("value").cast("decimal(18,2)").alias("total_spent"))
    return U.apply_customer_edits(D.f_customers(spark, d), snapshot_balances(spark, d), edits)


def _delete_requests(spark, d):
    """Profiles to delete: customers in debt."""
    return D.read(spark, d, "customer").filter(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("customer_id"))


@query("delete_customers_orders", "O-F6", oracle="""
SELECT id, CASE WHEN customer_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
                THEN NULL ELSE customer_id END AS customer_id
FROM f_orders""")
def delete_customers_orders(spark, d):
    out = U.delete_customers(_delete_requests(spark, d), orders=D.f_orders_core(spark, d))
    return out["orders"].select("id", "customer_id")


@query("delete_customers_remaining", "O-F6", oracle="""
SELECT id, customer_name FROM f_customers
WHERE id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def delete_customers_remaining(spark, d):
    out = U.delete_customers(_delete_requests(spark, d), customers=D.f_customers(spark, d))
    return out["customers"].select("id", "customer_name")


@query("delete_customers_members", "O-F6", oracle="""
SELECT customer_id, perfume FROM members WHERE customer_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""",
       extra_views=LIFE_VIEWS)
def delete_customers_members(spark, d):
    return U.delete_customers(_delete_requests(spark, d), members=_members(spark, d))["members"]


@query("delete_customers_codes", "O-F6", oracle="""
SELECT c.id AS customer_id, k.code FROM f_codes k JOIN f_customers c
  ON regexp_replace(k.customer_phone, '[^0-9]', '', 'g') = regexp_replace(c.customer_phone, '[^0-9]', '', 'g')
WHERE c.id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def delete_customers_codes(spark, d):
    return U.delete_customers(_delete_requests(spark, d), codes=_codes_by_customer(spark, d))["codes"].select("customer_id", "code")


@query("delete_customers_notifications", "O-F6", oracle="""
SELECT id, customer_id FROM f_notifications WHERE customer_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def delete_customers_notifications(spark, d):
    out = U.delete_customers(_delete_requests(spark, d), notifications=D.f_notifications(spark, d))
    return out["notifications"].select("id", "customer_id")


SEARCHES_SQL = """
SELECT CASE event_type WHEN 'view' THEN ' ' || upper(substr('customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0'), 5 + event_id % 3, 10 + event_id % 4)) || ' '
                       WHEN 'click' THEN lpad(CAST(user_id * 7 % 1000 AS VARCHAR), 4, '0')
                       WHEN 'purchase' THEN '00 ' || lpad(CAST(user_id AS VARCHAR), 6, '0')
                       WHEN 'signup' THEN CAST(event_id % 100 AS VARCHAR) ELSE 'no such ' || CAST(event_id AS VARCHAR) END AS q
FROM events"""


@query("search_many_customers", "O-F3", oracle="""
SELECT s.q, c.id FROM (SELECT DISTINCT lower(trim(q)) AS q FROM searches) s
JOIN f_customers c ON contains(lower(c.customer_name), s.q) OR contains(c.customer_phone, s.q)""", extra_views={"searches": SEARCHES_SQL})
def search_many_customers(spark, d):
    """One search an event: parts of names in upper case, of phones, short ones and ones without a match."""
    e = D.read(spark, d, "events")
    text = lambda c: c.cast("string")
    name = F.concat(F.lit("customer#"), F.lpad(text(F.col("user_id")), 9, "0"))
    kind = F.col("event_type")
    part = F.substr(name, (5 + F.col("event_id") % 3).cast("int"), (10 + F.col("event_id") % 4).cast("int"))
    q = (F.when(kind == "view", F.concat(F.lit(" "), F.upper(part), F.lit(" ")))
         .when(kind == "click", F.lpad(text(F.col("user_id") * 7 % 1000), 4, "0"))
         .when(kind == "purchase", F.concat(F.lit("00 "), F.lpad(text(F.col("user_id")), 6, "0")))
         .when(kind == "signup", text(F.col("event_id") % 100)).otherwise(F.concat(F.lit("no such "), text(F.col("event_id")))))
    return U.search_many(D.f_customers(spark, d), e.select(q.alias("q")), parts_for(spark, D.row_count(spark, d, "customer"), each=20_000))


_LISTS_SQL = {
    "library": """SELECT customer_id, row_number() OVER (PARTITION BY customer_id ORDER BY encode(perfume)) - 1 AS position, perfume AS label,
       'ORDER-' || min_number AS status
FROM (SELECT o.customer_id, trim(i.name) AS perfume, min(o.order_number) AS min_number FROM final_status f
      JOIN f_lifecycle_orders o ON o.id = f.order_id JOIN f_lifecycle_items i ON i.order_id = o.id
      WHERE f.status = 'delivered' AND nullif(trim(i.name), '') IS NOT NULL GROUP BY ALL)""",
    "codes": """SELECT c.id AS customer_id, row_number() OVER (PARTITION BY c.id ORDER BY encode(k.code)) - 1 AS position, k.code AS label,
       k.order_number AS number, CAST(k.order_total AS DECIMAL(18,2)) AS amount, CAST(k.bookmarks_awarded AS BIGINT) AS marks,
       CASE WHEN k.is_redeemed THEN 'Canjeado' ELSE 'Pendiente' END AS status
FROM f_codes k JOIN f_customers c ON regexp_replace(k.customer_phone, '[^0-9]', '', 'g') = regexp_replace(c.customer_phone, '[^0-9]', '', 'g')""",
    "rewards": """SELECT customer_id, row_number() OVER (PARTITION BY customer_id ORDER BY threshold, encode(reward_id)) - 1 AS position,
       reward_label AS label, num AS number, CAST(threshold AS BIGINT) AS marks, 'claimed' AS status
FROM (SELECT f.customer_id, f.reward_id, r.threshold, r.reward_label, f.num
      FROM (SELECT customer_id, reward_id, arg_min(order_number, id) AS num
            FROM (SELECT customer_id, unnest(reward_ids) AS reward_id, order_number, id FROM f_orders WHERE customer_id IS NOT NULL)
            GROUP BY customer_id, reward_id) f
      JOIN f_rewards r ON r.id = f.reward_id AND r.active
      JOIN balances b ON b.customer_id = f.customer_id AND r.threshold <= b.bookmarks)""",
    "orders": """SELECT customer_id, row_number() OVER (PARTITION BY customer_id ORDER BY created_at DESC, order_number) - 1 AS position,
       order_number AS label, CAST(order_total AS DECIMAL(18,2)) AS amount, status, created_at AS at
FROM f_orders WHERE customer_id IS NOT NULL""",
}


def _pages(spark, d):
    from decantry.operators import customer_page as P
    from decantry.plans.q_lifecycle import _library_snapshot
    from decantry.plans.q_rewards import reward_claims
    bal = snapshot_balances(spark, d)
    library = _library_snapshot(spark, d).filter(F.col("perfume").isNotNull() & (F.col("perfume") != ""))
    rows = P.page_rows(library, _codes_by_customer(spark, d), R.claim_rewards(reward_claims(spark, d), D.f_rewards(spark, d), bal),
                       D.f_orders_core(spark, d))
    return P.customer_pages(rows)


def _list_query(kind, columns):
    @query(f"customer_page_{kind}", "O-F4", oracle=_LISTS_SQL[kind], extra_views={**LIFE_VIEWS, "balances": BALANCES_SQL})
    def one_list(spark, d):
        from decantry.operators import customer_page as P
        return P.listed(_pages(spark, d), kind).select("customer_id", "position", *columns)
    return one_list


for _kind, _columns in {"library": ["label", "status"], "codes": ["label", "number", "amount", "marks", "status"],
                        "rewards": ["label", "number", "marks", "status"], "orders": ["label", "amount", "status", "at"]}.items():
    _list_query(_kind, _columns)


@query("reset_customers", "O-F7", oracle="""
SELECT c.id AS customer_id,
       CAST(CASE WHEN r.id IS NOT NULL THEN 0 ELSE coalesce(b.bookmarks, 0) END AS BIGINT) AS bookmarks,
       CAST(CASE WHEN r.id IS NOT NULL THEN 0 ELSE coalesce(b.total_spent, 0) END AS DECIMAL(18,2)) AS total_spent
FROM f_customers c LEFT JOIN balances b ON b.customer_id = c.id
LEFT JOIN (SELECT DISTINCT user_id AS id FROM events WHERE event_type = 'signup') r ON r.id = c.id""",
       extra_views={"balances": BALANCES_SQL})
def reset_customers(spark, d):
    e = D.read(spark, d, "events").filter(F.col("event_type") == "signup")
    out, _ = U.reset_customers(D.f_customers(spark, d), _members(spark, d), snapshot_balances(spark, d),
                               e.select(F.col("user_id").alias("customer_id")))
    return out
