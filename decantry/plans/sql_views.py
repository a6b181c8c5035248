"""DuckDB text of the driver-table views (twins of ``decantry.sources.driver``).

Oracle queries are written against these names; ``with_views`` prefixes the
definitions as CTEs so the oracle reads only the pre-registered base tables.
Money is cast to decimal(12,2) before any arithmetic, as on the Spark side.
"""

from __future__ import annotations

VIEWS: dict[str, str] = {}

VIEWS["f_catalog"] = """
SELECT p_partkey AS id,
       p_name || ' #' || CAST(p_partkey AS VARCHAR) AS name,
       p_brand AS brand,
       CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE CAST(ROUND(CAST(p_retailprice AS DECIMAL(12,2)) * CAST(0.01 AS DECIMAL(3,2)), 2) AS DECIMAL(10,2)) END AS price_2ml,
       CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE CAST(ROUND(CAST(p_retailprice AS DECIMAL(12,2)) * CAST(0.02 AS DECIMAL(3,2)), 2) AS DECIMAL(10,2)) END AS price_3ml,
       CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE CAST(ROUND(CAST(p_retailprice AS DECIMAL(12,2)) * CAST(0.03 AS DECIMAL(3,2)), 2) AS DECIMAL(10,2)) END AS price_5ml,
       CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE CAST(ROUND(CAST(p_retailprice AS DECIMAL(12,2)) * CAST(0.05 AS DECIMAL(3,2)), 2) AS DECIMAL(10,2)) END AS price_10ml,
       CASE WHEN p_partkey % 10 = 0 THEN 'upcoming' WHEN p_partkey % 10 = 1 THEN 'hidden' ELSE 'published' END AS availability_status,
       p_partkey % 10 <> 1 AS active,
       CASE WHEN p_partkey % 50 = 7 THEN TIMESTAMP '2001-01-01 00:00:00' END AS deleted_at,
       CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(500 + 100 * (p_partkey % 20) AS DECIMAL(10,2)) END AS stock_initial_ml,
       CAST(15 AS DECIMAL(10,2)) AS low_stock_threshold_ml,
       1000 AS display_order,
       TIMESTAMP '2000-01-01 00:00:00' + to_minutes(p_partkey) AS created_at,
       CASE WHEN p_size > 25 THEN 'img/' || CAST(p_partkey AS VARCHAR) || '.webp' END AS image_url,
       p_type AS description, string_split(p_name, ' ') AS accords, string_split(p_type, ' ') AS notes,
       CASE WHEN p_size % 2 = 0 THEN lower(p_brand) END AS journey_theme, 'Journey ' || p_name AS journey_title,
       CASE WHEN p_size > 10 THEN p_type || ' · ' || p_name END AS journey_copy
FROM part"""

VIEWS["f_items"] = """
SELECT l.l_orderkey AS order_id,
       l.l_linenumber AS line,
       p.p_name || ' #' || CAST(l.l_partkey AS VARCHAR) AS name,
       CASE WHEN l.l_linenumber % 4 = 0 THEN '2 ml' WHEN l.l_linenumber % 4 = 1 THEN '3 ml'
            WHEN l.l_linenumber % 4 = 2 THEN '5 ml' ELSE '10 ml' END AS size,
       CASE WHEN l.l_linenumber = 7 THEN '' ELSE CAST(CAST(trunc(l.l_quantity) AS BIGINT) AS VARCHAR) END AS qty
FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey"""

VIEWS["f_orders"] = """
SELECT o.o_orderkey AS id,
       'P-' || lpad(CAST(o.o_orderkey AS VARCHAR), 8, '0') AS order_number,
       CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE o.o_custkey END AS customer_id,
       c.c_name AS customer_name,
       '+34 600 ' || lpad(CAST(o.o_custkey AS VARCHAR), 6, '0') AS customer_phone,
       n.n_name AS delivery_zone,
       CAST(NULL AS VARCHAR) AS notes,
       CASE WHEN o.o_orderpriority = '1-URGENT' THEN ['reward-' || CAST(o.o_orderkey % s.n AS VARCHAR)]
            WHEN o.o_orderpriority = '2-HIGH' THEN ['reward-' || CAST(o.o_orderkey * 7 % s.n AS VARCHAR), 'reward-' || CAST((o.o_orderkey * 7 + 1) % s.n AS VARCHAR)]
            ELSE CAST([] AS VARCHAR[]) END AS reward_ids,
       CAST(o.o_totalprice AS DECIMAL(12,2)) AS order_total,
       CASE WHEN o.o_orderstatus = 'F' THEN 'delivered'
            WHEN o.o_orderstatus = 'P' THEN CASE WHEN o.o_orderpriority = '1-URGENT' THEN 'ready' ELSE 'preparing' END
            WHEN o.o_orderstatus = 'O' THEN CASE WHEN o.o_orderpriority = '5-LOW' THEN 'cancelled' ELSE 'pending' END
       END AS status,
       CASE WHEN o.o_orderstatus = 'F' AND o.o_orderkey % 11 <> 0 THEN o.o_orderdate END AS accounted_at,
       CASE WHEN o.o_orderstatus = 'F' THEN o.o_orderdate END AS delivered_at,
       o.o_orderdate AS created_at,
       o.o_orderdate AS updated_at
FROM orders o
CROSS JOIN (SELECT count(*) AS n FROM supplier) s
LEFT JOIN customer c ON o.o_custkey = c.c_custkey
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey"""

VIEWS["f_customers"] = """
SELECT c_custkey AS id,
       c_name AS customer_name,
       '+34 600 ' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS customer_phone,
       'tok-' || CAST(c_custkey AS VARCHAR) AS access_token,
       TIMESTAMP '1995-01-01 00:00:00' + to_minutes(c_custkey) AS created_at,
       c_acctbal >= 0 AS ranking_opt_in,
       c_mktsegment AS segment
FROM customer"""

VIEWS["f_rewards"] = """
SELECT 'reward-' || CAST(s_suppkey AS VARCHAR) AS id,
       CAST(300000 + 100000 * (s_suppkey % 23) AS INTEGER) AS threshold,
       'Discovery ' || s_name AS reward_label,
       s_acctbal >= 0 AS active,
       CAST((s_suppkey % 4) * 10 AS INTEGER) AS sort_order,
       TIMESTAMP '2002-01-01 00:00:00' + to_minutes(s_suppkey) AS updated_at
FROM supplier"""

VIEWS["f_status_events"] = """
SELECT user_id * 20 + event_id % 20 AS order_id,
       user_id AS customer_id,
       CASE event_type WHEN 'purchase' THEN 'delivered' WHEN 'view' THEN 'preparing'
            WHEN 'click' THEN 'ready' WHEN 'signup' THEN 'pending' WHEN 'error' THEN 'cancelled' END AS new_status,
       ts,
       event_id AS seq,
       CAST(CAST(((user_id * 20 + event_id % 20) * 37) % 9973 AS DECIMAL(12,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(12,2)) AS order_total
FROM events"""

VIEWS["f_lifecycle_orders"] = """
SELECT order_id AS id, customer_id,
       CAST(CAST((order_id * 37) % 9973 AS DECIMAL(12,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(12,2)) AS order_total,
       min(ts) AS created_at,
       'P-' || lpad(CAST(order_id AS VARCHAR), 8, '0') AS order_number
FROM f_status_events GROUP BY order_id, customer_id"""

VIEWS["f_lifecycle_items"] = """
SELECT k.order_id, c.name
FROM (SELECT id AS order_id, unnest([(customer_id * 31 + (id * 7) % 11) % n, (customer_id * 31 + (id * 7 + 13) % 11) % n,
                                     (customer_id * 31 + (id * 7 + 26) % 11) % n]) AS pk
      FROM f_lifecycle_orders, (SELECT count(*) AS n FROM part)) k
LEFT JOIN f_catalog c ON c.id = k.pk"""

VIEWS["f_transitions"] = """
SELECT order_id, ts, seq, new_status = 'delivered' AS entered
FROM (SELECT *, coalesce(lag(new_status) OVER (PARTITION BY order_id ORDER BY ts, seq), 'pending') AS prev
      FROM f_status_events)
WHERE (new_status = 'delivered') <> (prev = 'delivered')"""

VIEWS["f_codes"] = """
SELECT 'PR-' || upper(substr(sha256(o.order_number), 1, 10)) AS code,
       o.customer_name, o.customer_phone, o.order_number, o.order_total,
       coalesce(n.perfumes, CAST([] AS VARCHAR[])) AS perfumes,
       CAST(floor(o.order_total) AS INTEGER) AS bookmarks_awarded,
       o.id % 10 = 0 AS is_redeemed,
       o.created_at
FROM f_orders o
LEFT JOIN (SELECT order_id, list_sort(list(DISTINCT trim(name))) AS perfumes FROM f_items GROUP BY order_id) n
  ON o.id = n.order_id"""

VIEWS["f_museum"] = """
SELECT p_name || ' #' || CAST(p_partkey AS VARCHAR) AS perfume_name,
       p_brand AS brand,
       CASE WHEN p_size % 3 = 0 THEN '' ELSE 'assets/artworks/' || CAST(p_partkey AS VARCHAR) || '.webp' END AS artwork_path,
       p_type || ' ' || p_name AS description,
       p_size > 5 AS published,
       string_split(p_name, ' ') AS accords, string_split(p_type, ' ') AS notes,
       TIMESTAMP '2002-01-01 00:00:00' + to_minutes(p_partkey) AS updated_at
FROM part"""

VIEWS["f_notifications"] = """
SELECT e.event_id AS id, e.user_id AS customer_id, e.user_id * 20 + e.event_id % 20 AS order_id,
       c.name AS perfume,
       'P-' || lpad(CAST(e.user_id * 20 + e.event_id % 20 AS VARCHAR), 8, '0') AS order_number,
       CASE WHEN e.event_type IN ('view', 'click') THEN e.ts END AS seen_at,
       e.ts AS created_at
FROM events e LEFT JOIN f_catalog c ON c.id = (e.user_id * 31 + e.event_id % 11) % (SELECT count(*) FROM part)"""

_ORDER = list(VIEWS)


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """``WITH <all views> [, extra...] <body>``; DuckDB drops unreferenced CTEs."""
    parts = [f"{name} AS ({VIEWS[name]}\n)" for name in _ORDER]
    for name, text in (extra or {}).items():
        parts.append(f"{name} AS ({text}\n)")
    # RECURSIVE is harmless for plain CTEs and lets oracles simulate step-by-step folds.
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body
