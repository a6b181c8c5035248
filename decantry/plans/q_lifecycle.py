"""Lifecycle, loyalty and collection queries (O-B*) over the status-event model."""

from __future__ import annotations

from pyspark.sql import functions as F

from decantry.operators import fold as FO
from decantry.operators import lifecycle as L
from decantry.operators import orders as O
from decantry.plans.q_orders import CREDENTIALS_SQL, credentials
from decantry.plans.registry import query
from decantry.session import parts_for
from decantry.sources import driver as D
from decantry.sources.driver import memo_view

# DuckDB: final status per order with the current delivered run start (window formulation).
FINAL_SQL = """
SELECT f.order_id, f.status,
       CASE WHEN f.status = 'delivered' THEN s.run_start END AS delivered_at, f.updated_at
FROM (SELECT order_id, new_status AS status, ts AS updated_at
      FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY ts DESC, seq DESC) AS rn FROM f_status_events)
      WHERE rn = 1) f
LEFT JOIN (SELECT order_id, max(ts) AS run_start
           FROM (SELECT *, lag(new_status) OVER (PARTITION BY order_id ORDER BY ts, seq) AS prev FROM f_status_events)
           WHERE new_status = 'delivered' AND coalesce(prev, 'pending') <> 'delivered'
           GROUP BY order_id) s ON f.order_id = s.order_id"""

MEMBERS_SQL = """
SELECT DISTINCT o.customer_id, trim(i.name) AS perfume
FROM final_status f JOIN f_lifecycle_orders o ON o.id = f.order_id
JOIN f_lifecycle_items i ON i.order_id = o.id
WHERE f.status = 'delivered' AND o.customer_id IS NOT NULL AND nullif(trim(i.name), '') IS NOT NULL"""

LIFE_VIEWS = {"final_status": FINAL_SQL, "members": MEMBERS_SQL}

# DuckDB: the ownership fold as a step-by-step recursive walk per (customer, perfume), an
# independent row-at-a-time formulation of the same rules (state: delivered orders with their
# run start, the owner, the live notifications).
FOLD_VIEWS = {
    "fold_steps": """
SELECT o.customer_id, i.perfume, t.order_id, o.order_number, o.created_at, t.ts, t.seq, t.entered,
       row_number() OVER (PARTITION BY o.customer_id, i.perfume ORDER BY t.ts, t.seq) AS k
FROM f_transitions t
JOIN f_lifecycle_orders o ON o.id = t.order_id
JOIN (SELECT DISTINCT order_id, trim(name) AS perfume FROM f_lifecycle_items WHERE nullif(trim(name), '') IS NOT NULL) i
  ON i.order_id = t.order_id
WHERE o.customer_id IS NOT NULL""",
    "fold_walk": """
SELECT customer_id, perfume, k,
       [{'d': ts, 'c': created_at, 'n': order_number, 'o': order_id}] AS dl,
       {'o': order_id, 'n': order_number} AS owner,
       [{'o': order_id, 'n': order_number, 't': ts}] AS notes
FROM fold_steps WHERE k = 1
UNION ALL
SELECT s.customer_id, s.perfume, s.k,
       CASE WHEN s.entered THEN list_append(w.dl, {'d': s.ts, 'c': s.created_at, 'n': s.order_number, 'o': s.order_id})
            ELSE list_filter(w.dl, lambda x: x.o <> s.order_id) END,
       CASE WHEN s.entered THEN coalesce(w.owner, {'o': s.order_id, 'n': s.order_number})
            WHEN w.owner.o = s.order_id THEN
              (SELECT CASE WHEN b.o IS NULL THEN NULL ELSE {'o': b.o, 'n': b.n} END
               FROM (SELECT list_reverse_sort(list_filter(w.dl, lambda x: x.o <> s.order_id))[1] AS b))
            ELSE w.owner END,
       CASE WHEN s.entered AND w.owner IS NULL THEN list_append(w.notes, {'o': s.order_id, 'n': s.order_number, 't': s.ts})
            WHEN s.entered THEN w.notes
            ELSE list_filter(w.notes, lambda x: x.o <> s.order_id) END
FROM fold_walk w JOIN fold_steps s ON s.customer_id = w.customer_id AND s.perfume = w.perfume AND s.k = w.k + 1""",
    "fold_final": """
SELECT w.* FROM fold_walk w
JOIN (SELECT customer_id, perfume, max(k) AS mk FROM fold_steps GROUP BY customer_id, perfume) m
  ON m.customer_id = w.customer_id AND m.perfume = w.perfume AND w.k = m.mk""",
}
FOLD_LIBRARY_SQL = """
SELECT customer_id, perfume, 'ORDER-' || owner.n AS source_code FROM fold_final WHERE owner IS NOT NULL"""


@memo_view
def _events(spark, d):
    valid, _ = L.validate_status_events(D.f_status_events(spark, d), D.f_orders_core(spark, d), _by_order(spark, d))
    return valid


def _by_order(spark, d):
    """Tasks that share the status events and the orders."""
    return parts_for(spark, D.row_count(spark, d, "events") + D.row_count(spark, d, "orders"))


@memo_view
def _final(spark, d):
    return L.order_status_final(_events(spark, d))


@memo_view
def _members(spark, d):
    return L.collection_members(_final(spark, d), D.f_lifecycle_orders(spark, d), D.f_lifecycle_items(spark, d))


def status_requests(spark, d):
    """Status changes as they are asked for: some name no status, or an order that is not there."""
    e, v = D.f_status_events(spark, d), D.read(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("value").alias("_v"))
    parts = parts_for(spark, 2 * D.row_count(spark, d, "events"))
    e = e.repartition(parts, "seq").join(v.repartition(parts, "seq"), "seq")
    status = F.when(F.col("_v") < 5, F.lit("lost")).when(F.col("_v") >= 8, F.col("new_status"))
    return e.select(F.when(F.col("_v") > 120, F.col("order_id") + 10 ** 9).otherwise(F.col("order_id")).alias("order_id"), "seq",
                    status.alias("new_status"), "ts")


@query("validate_status_events", "O-B1", oracle="""
SELECT e.order_id, e.seq, e.new_status,
       CASE WHEN e.new_status IS NULL OR e.new_status NOT IN ('pending', 'preparing', 'ready', 'delivered', 'cancelled') THEN 'invalid_status'
            WHEN e.order_id NOT IN (SELECT id FROM f_orders) THEN 'order_not_found' END AS reject_reason
FROM (SELECT CASE WHEN v.value > 120 THEN s.order_id + 1000000000 ELSE s.order_id END AS order_id, s.seq,
             CASE WHEN v.value < 5 THEN 'lost' WHEN v.value >= 8 THEN s.new_status END AS new_status
      FROM f_status_events s JOIN events v ON v.event_id = s.seq) e""")
def validate_status_events(spark, d):
    valid, rej = L.validate_status_events(status_requests(spark, d), D.f_orders_core(spark, d), _by_order(spark, d))
    cols = ["order_id", "seq", "new_status"]
    return valid.select(*cols, F.lit(None).cast("string").alias("reject_reason")).unionByName(
        rej.select(*cols, "reject_reason"))


@query("order_status_final", "O-B2", oracle="SELECT * FROM final_status", extra_views=LIFE_VIEWS)
def order_status_final(spark, d):
    return _final(spark, d)


@query("loyalty_balance", "O-B3", oracle="""
SELECT o.customer_id, CAST(sum(o.order_total) AS DECIMAL(18,2)) AS total_spent,
       CAST(sum(floor(o.order_total)) AS BIGINT) AS bookmarks, count(*) AS delivered_orders
FROM final_status f JOIN f_lifecycle_orders o ON o.id = f.order_id
WHERE f.status = 'delivered' AND o.customer_id IS NOT NULL
GROUP BY o.customer_id""", extra_views=LIFE_VIEWS)
def loyalty_balance(spark, d):
    return L.loyalty_balance(_final(spark, d), D.f_lifecycle_orders(spark, d))


def _resets(spark, d):
    """Bookmark resets (O-F7) arrive as 'signup' events: the balance restarts at 0."""
    e = D.read(spark, d, "events").filter(F.col("event_type") == "signup")
    return e.select(F.col("user_id").alias("customer_id"), "ts", F.col("event_id").alias("seq"),
                    F.lit(0).cast("bigint").alias("start_value"))


@query("loyalty_with_resets", "O-B3+O-F7", oracle="""
, deltas AS (
  SELECT o.customer_id, t.ts, t.seq,
         CASE WHEN t.entered THEN 1 ELSE -1 END * CAST(floor(o.order_total) AS BIGINT) AS delta
  FROM f_transitions t JOIN f_lifecycle_orders o ON o.id = t.order_id),
resets AS (SELECT user_id AS customer_id, ts, event_id AS seq FROM events WHERE event_type = 'signup'),
steps AS (
  SELECT customer_id, ts, seq, delta, 0 AS is_reset FROM deltas
  UNION ALL SELECT customer_id, ts, seq, 0 AS delta, 1 AS is_reset FROM resets),
ordered AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY ts, seq, is_reset) AS k FROM steps),
walk AS (
  SELECT customer_id, k, CASE WHEN is_reset = 1 THEN 0 ELSE greatest(0, delta) END AS bal FROM ordered WHERE k = 1
  UNION ALL
  SELECT w.customer_id, o.k, CASE WHEN o.is_reset = 1 THEN 0 ELSE greatest(0, w.bal + o.delta) END
  FROM walk w JOIN ordered o ON o.customer_id = w.customer_id AND o.k = w.k + 1)
SELECT w.customer_id, w.bal AS balance
FROM walk w JOIN (SELECT customer_id, max(k) AS mk FROM ordered GROUP BY customer_id) m
  ON m.customer_id = w.customer_id AND w.k = m.mk""")
def loyalty_with_resets(spark, d):
    ev = _events(spark, d)
    tr = L.transitions(ev).filter(F.col("entered") | F.col("left")).select("order_id", "customer_id", "ts", "seq", "entered")
    orders = D.f_lifecycle_orders(spark, d)
    deltas = (tr.join(orders.select(F.col("id").alias("order_id"), "customer_id", "order_total"), ["order_id", "customer_id"])
              .select("customer_id", "ts", "seq",
                      (F.when(F.col("entered"), 1).otherwise(-1) * F.floor("order_total")).cast("bigint").alias("delta")))
    return L.clamped_balance(deltas, _resets(spark, d)).select("customer_id", F.col("balance").cast("bigint").alias("balance"))


@query("collection_members", "O-B4", oracle="SELECT * FROM members", extra_views=LIFE_VIEWS)
def collection_members(spark, d):
    return _members(spark, d)


@query("collection_sources", "O-B5", oracle=FOLD_LIBRARY_SQL, extra_views=FOLD_VIEWS)
def collection_sources(spark, d):
    return FO.collection_sources(_events(spark, d), D.f_lifecycle_orders(spark, d), D.f_lifecycle_items(spark, d))


@query("unlock_notifications", "O-B6", oracle="""
SELECT customer_id, perfume, n.o AS order_id, n.n AS order_number, n.t AS created_at
FROM (SELECT customer_id, perfume, unnest(notes) AS n FROM fold_final)""", extra_views=FOLD_VIEWS)
def unlock_notifications(spark, d):
    return FO.unlock_notifications(_events(spark, d), D.f_lifecycle_orders(spark, d), D.f_lifecycle_items(spark, d))


def _library_snapshot(spark, d):
    """Library snapshot for the manual-unlock batch: members sourced from their lowest
    delivered order number (a fixture rule; the exact owner is O-B5's job)."""
    fin = _final(spark, d).filter(F.col("status") == "delivered").select(F.col("order_id").alias("id"))
    orders = D.f_lifecycle_orders(spark, d).join(fin, "id", "left_semi")
    items = D.f_lifecycle_items(spark, d)
    return (orders.join(items, orders.id == items.order_id)
            .groupBy("customer_id", F.trim("name").alias("perfume"))
            .agg(F.concat(F.lit("ORDER-"), F.min("order_number")).alias("source_code")))


LIBRARY_SQL = """
SELECT o.customer_id, trim(i.name) AS perfume, 'ORDER-' || min(o.order_number) AS source_code
FROM final_status f JOIN f_lifecycle_orders o ON o.id = f.order_id JOIN f_lifecycle_items i ON i.order_id = o.id
WHERE f.status = 'delivered' GROUP BY o.customer_id, trim(i.name)"""


def manual_changes_of(events, catalog, parts):
    """Admin unlock (click) / lock (error) requests from raw events (batch or streaming);
    some name unknown customers or blank perfumes. ``catalog`` is static."""
    e = events.filter(F.col("event_type").isin("click", "error"))
    cat = catalog.select(F.col("id").alias("_pk"), F.col("name").alias("_name"))
    base = e.select(F.when(F.col("value") > 150, F.col("user_id") + 1000000).otherwise(F.col("user_id")).alias("customer_id"),
                    D.product_of(F.col("user_id"), F.col("event_id"), parts).alias("_pk"), (F.col("event_id") % 97 == 0).alias("_blank"),
                    (F.col("event_type") == "click").alias("unlocked"), "ts", F.col("event_id").alias("seq"))
    return (base.join(cat, "_pk", "left")
            .select("customer_id", F.when(F.col("_blank"), F.lit("  ")).otherwise(F.col("_name")).alias("perfume"),
                    "unlocked", "ts", "seq"))


def manual_changes(spark, d):
    return manual_changes_of(D.read(spark, d, "events"), D.f_catalog(spark, d), D.row_count(spark, d, "part"))


CHANGES_SQL = """
SELECT CASE WHEN e.value > 150 THEN e.user_id + 1000000 ELSE e.user_id END AS customer_id,
       CASE WHEN e.event_id % 97 = 0 THEN '  ' ELSE c.name END AS perfume,
       e.event_type = 'click' AS unlocked, e.ts, e.event_id AS seq
FROM events e LEFT JOIN f_catalog c ON c.id = (e.user_id * 31 + e.event_id % 11) % (SELECT count(*) FROM part)
WHERE e.event_type IN ('click', 'error')"""


@query("apply_manual_unlocks", "O-B7", oracle="""
, ok AS (SELECT customer_id, trim(perfume) AS perfume, unlocked, seq FROM changes
         WHERE customer_id IN (SELECT id FROM f_customers) AND coalesce(trim(perfume), '') <> ''),
per_key AS (SELECT customer_id, perfume, arg_max(unlocked, seq) AS last_unlock, bool_or(NOT unlocked) AS any_lock
            FROM ok GROUP BY customer_id, perfume)
SELECT coalesce(l.customer_id, k.customer_id) AS customer_id, coalesce(l.perfume, k.perfume) AS perfume,
       CASE WHEN k.last_unlock IS NULL THEN l.source_code WHEN k.any_lock THEN 'MANUAL-STUDIO'
            ELSE coalesce(l.source_code, 'MANUAL-STUDIO') END AS source_code
FROM library l FULL JOIN per_key k ON l.customer_id = k.customer_id AND l.perfume = k.perfume
WHERE coalesce(k.last_unlock, l.customer_id IS NOT NULL)""",
       extra_views={**LIFE_VIEWS, "library": LIBRARY_SQL, "changes": CHANGES_SQL})
def apply_manual_unlocks(spark, d):
    lib, _, _ = L.apply_manual_unlocks(_library_snapshot(spark, d), D.f_notifications(spark, d),
                                      D.f_customers(spark, d), manual_changes(spark, d))
    return lib


@query("pending_notifications", "O-B8", oracle="""
SELECT n.customer_id, n.id, n.perfume, n.order_number, n.created_at
FROM f_notifications n WHERE n.seen_at IS NULL AND n.customer_id IN (SELECT customer_id FROM resolved WHERE matched)""",
       extra_views={"credentials": CREDENTIALS_SQL, "resolved": """
SELECT r.request_id, c.id AS customer_id, true AS matched
FROM credentials r JOIN f_customers c
  ON regexp_replace(r.phone, '[^0-9]', '', 'g') = regexp_replace(c.customer_phone, '[^0-9]', '', 'g')
 AND r.token = c.access_token"""})
def pending_notifications(spark, d):
    prof = O.resolve_profiles(credentials(spark, d), D.f_customers(spark, d))
    return L.pending_notifications(prof, D.f_notifications(spark, d))


def seen_requests(spark, d):
    """'click' events mark five recent notification ids as seen (some belong to others)."""
    e = D.read(spark, d, "events").filter(F.col("event_type") == "click")
    ids = F.array(*[F.col("event_id") - k for k in (1, 2, 3, 5, 8)])
    return e.select(F.col("event_id").alias("request_id"), "ts", F.col("event_id").alias("seq"), ids.alias("ids"))


@query("mark_seen", "O-B9", oracle="""
SELECT q.event_id AS request_id, count(n.id) AS updated
FROM (SELECT e.event_id, e.user_id, x.id
      FROM events e, unnest([e.event_id - 1, e.event_id - 2, e.event_id - 3, e.event_id - 5, e.event_id - 8]) AS x(id)
      WHERE e.event_type = 'click') q
LEFT JOIN f_notifications n ON n.id = q.id AND n.customer_id = q.user_id
GROUP BY q.event_id""")
def mark_seen(spark, d):
    cred = credentials(spark, d)
    reqs = seen_requests(spark, d)
    prof = O.resolve_profiles(cred.join(reqs.select("request_id"), "request_id", "left_semi"), D.f_customers(spark, d))
    counts, _ = L.mark_seen(prof, D.f_notifications(spark, d), reqs)
    return counts


@query("collection_completeness", "O-B10", oracle="""
SELECT c.id AS customer_id, CAST(coalesce(m.n, 0) AS BIGINT) AS discovered, t.total AS total_works,
       CAST(CAST((CAST(coalesce(m.n, 0) AS HUGEINT) * 10000 * 2 + t.total) // (t.total * 2) AS DECIMAL(38,0)) * CAST(0.0001 AS DECIMAL(5,4)) AS DECIMAL(18,4)) AS progress,
       ['Initiate', 'Explorer', 'Connoisseur', 'Collector', 'Curator'][least(4, (coalesce(m.n, 0) * 4) // greatest(t.total, 1)) + 1] AS level
FROM f_customers c
LEFT JOIN (SELECT customer_id, count(*) AS n FROM members GROUP BY customer_id) m ON m.customer_id = c.id,
(SELECT count(*) AS total FROM f_museum) t""", extra_views=LIFE_VIEWS)
def collection_completeness(spark, d):
    return L.collection_completeness(D.f_customers(spark, d), _members(spark, d), D.f_museum(spark, d))


def _streamed(spark, d, name, with_manual=False):
    """The lifecycle stream over the events in eight arrivals; the current views."""
    import uuid

    from decantry.session import delete_folder, ensure_checkpoint_dir
    from decantry.streaming import lifecycle_stream as S
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/arrivals-{uuid.uuid4().hex[:12]}"
    files = D.event_arrivals(spark, d, folder)
    raw = D.stream_events(spark, d, folder, files)
    events = S.with_perfumes(D.status_events_of(raw, D.row_count(spark, d, "part")), D.f_catalog(spark, d))
    manual = None
    if with_manual:
        steps = FO.manual_steps(manual_changes_of(raw, D.f_catalog(spark, d), D.row_count(spark, d, "part")), D.f_customers(spark, d))
        manual = steps.withColumn("unlocked", F.col("kind") == "unlock")
    out = S.run_to_parquet(spark, S.stream_lifecycle(events, manual), name)
    delete_folder(spark, folder)
    return S.latest_views(spark, out)


@query("stream_lifecycle", "O-B11", oracle=FOLD_LIBRARY_SQL, extra_views=FOLD_VIEWS)
def stream_lifecycle(spark, d):
    """Final library rows per customer, read back from the stream's change rows."""
    return _streamed(spark, d, "lifecycle").filter(F.col("record") == "library").select("customer_id", "perfume", "source_code")


@query("stream_lifecycle_notifications", "O-B11+O-B6", oracle="""
SELECT customer_id, perfume, n.o AS order_id, n.t AS created_at
FROM (SELECT customer_id, perfume, unnest(notes) AS n FROM fold_final)""", extra_views=FOLD_VIEWS)
def stream_lifecycle_notifications(spark, d):
    """Notifications still present after the last micro-batch."""
    views = _streamed(spark, d, "lifecycle-notes")
    return views.filter(F.col("record") == "notification").select("customer_id", "perfume", "order_id", "created_at")


@query("manual_unlock_notifications", "O-B7", oracle="""
, ok AS (SELECT customer_id, trim(perfume) AS perfume, unlocked, ts, seq FROM changes
         WHERE customer_id IN (SELECT id FROM f_customers) AND coalesce(trim(perfume), '') <> ''),
per_key AS (SELECT customer_id, perfume, arg_max(unlocked, seq) AS last_unlock,
                   max(CASE WHEN NOT unlocked THEN seq END) AS last_lock
            FROM ok GROUP BY customer_id, perfume),
first_unlock AS (SELECT o.customer_id, o.perfume, arg_min(o.ts, o.seq) AS uts
                 FROM ok o JOIN per_key k ON k.customer_id = o.customer_id AND k.perfume = o.perfume
                 WHERE o.unlocked AND (k.last_lock IS NULL OR o.seq > k.last_lock)
                 GROUP BY o.customer_id, o.perfume)
SELECT n.customer_id, n.perfume, n.order_number, n.seen_at, n.created_at
FROM f_notifications n
WHERE n.seen_at IS NOT NULL OR NOT EXISTS (
  SELECT 1 FROM per_key k WHERE k.customer_id = n.customer_id AND k.perfume = n.perfume AND k.last_lock IS NOT NULL)
UNION ALL
SELECT k.customer_id, k.perfume, 'MANUAL', CAST(NULL AS TIMESTAMP), f.uts
FROM per_key k JOIN first_unlock f ON f.customer_id = k.customer_id AND f.perfume = k.perfume
WHERE k.last_unlock AND (k.last_lock IS NOT NULL OR NOT EXISTS (
  SELECT 1 FROM f_notifications n WHERE n.customer_id = k.customer_id AND n.perfume = k.perfume AND n.seen_at IS NULL))""",
       extra_views={**LIFE_VIEWS, "library": LIBRARY_SQL, "changes": CHANGES_SQL})
def manual_unlock_notifications(spark, d):
    """Notifications after the manual batch: unseen ones of locked keys are gone, a MANUAL one
    appears where the batch ends unlocked and no unseen notification survives."""
    _, notes, _ = L.apply_manual_unlocks(_library_snapshot(spark, d), D.f_notifications(spark, d),
                                         D.f_customers(spark, d), manual_changes(spark, d))
    return notes.select("customer_id", "perfume", "order_number", "seen_at", "created_at")


@query("mark_seen_notifications", "O-B9", oracle="""
SELECT n.id, n.customer_id, coalesce(n.seen_at, s.first_seen) AS seen_at
FROM f_notifications n LEFT JOIN (
  SELECT x.id, min(e.ts) AS first_seen
  FROM events e, unnest([e.event_id - 1, e.event_id - 2, e.event_id - 3, e.event_id - 5, e.event_id - 8]) AS x(id),
       f_notifications n2
  WHERE e.event_type = 'click' AND n2.id = x.id AND n2.customer_id = e.user_id
  GROUP BY x.id) s ON s.id = n.id""")
def mark_seen_notifications(spark, d):
    """Notifications after the mark-seen requests: seen_at = the first request time that listed
    the id (for the caller's own notifications), unless already seen."""
    cred = credentials(spark, d)
    reqs = seen_requests(spark, d)
    prof = O.resolve_profiles(cred.join(reqs.select("request_id"), "request_id", "left_semi"), D.f_customers(spark, d))
    _, after = L.mark_seen(prof, D.f_notifications(spark, d), reqs)
    return after.select("id", "customer_id", "seen_at")


# DuckDB: the same walk with admin unlock/lock steps interleaved (transitions first at equal
# (ts, seq)); every key starts from an empty state at k = 0.
FOLD_MANUAL_VIEWS = {
    **LIFE_VIEWS, "changes": CHANGES_SQL,
    "fm_steps": """
SELECT *, row_number() OVER (PARTITION BY customer_id, perfume ORDER BY ts, seq, rk) AS k FROM (
  SELECT o.customer_id, i.perfume, t.order_id, o.order_number, o.created_at, t.ts, t.seq,
         CASE WHEN t.entered THEN 'enter' ELSE 'leave' END AS kind, 0 AS rk
  FROM f_transitions t
  JOIN f_lifecycle_orders o ON o.id = t.order_id
  JOIN (SELECT DISTINCT order_id, trim(name) AS perfume FROM f_lifecycle_items WHERE nullif(trim(name), '') IS NOT NULL) i
    ON i.order_id = t.order_id
  WHERE o.customer_id IS NOT NULL
  UNION ALL
  SELECT customer_id, trim(perfume), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS TIMESTAMP), ts, seq,
         CASE WHEN unlocked THEN 'unlock' ELSE 'lock' END, 1
  FROM changes WHERE customer_id IN (SELECT id FROM f_customers) AND nullif(trim(perfume), '') IS NOT NULL)""",
    "fm_walk": """
SELECT customer_id, perfume, 0 AS k,
       CAST([] AS STRUCT(d TIMESTAMP, c TIMESTAMP, n VARCHAR, o BIGINT)[]) AS dl,
       CAST(NULL AS STRUCT(o BIGINT, n VARCHAR, m BOOLEAN)) AS owner,
       CAST([] AS STRUCT(o BIGINT, n VARCHAR, t TIMESTAMP)[]) AS notes
FROM (SELECT DISTINCT customer_id, perfume FROM fm_steps)
UNION ALL
SELECT s.customer_id, s.perfume, s.k,
       CASE s.kind WHEN 'enter' THEN list_append(w.dl, {'d': s.ts, 'c': s.created_at, 'n': s.order_number, 'o': s.order_id})
                   WHEN 'leave' THEN list_filter(w.dl, lambda x: x.o <> s.order_id) ELSE w.dl END,
       CASE s.kind
         WHEN 'enter' THEN coalesce(w.owner, {'o': s.order_id, 'n': s.order_number, 'm': false})
         WHEN 'leave' THEN CASE WHEN w.owner.o = s.order_id THEN
              (SELECT CASE WHEN b.o IS NULL THEN NULL ELSE {'o': b.o, 'n': b.n, 'm': false} END
               FROM (SELECT list_reverse_sort(list_filter(w.dl, lambda x: x.o <> s.order_id))[1] AS b))
              ELSE w.owner END
         WHEN 'unlock' THEN coalesce(w.owner, {'o': CAST(NULL AS BIGINT), 'n': CAST(NULL AS VARCHAR), 'm': true})
         ELSE NULL END,
       CASE s.kind
         WHEN 'enter' THEN CASE WHEN w.owner IS NULL THEN list_append(w.notes, {'o': s.order_id, 'n': s.order_number, 't': s.ts})
                                ELSE w.notes END
         WHEN 'leave' THEN list_filter(w.notes, lambda x: x.o IS DISTINCT FROM s.order_id)
         WHEN 'unlock' THEN CASE WHEN len(w.notes) = 0
                                 THEN list_append(w.notes, {'o': CAST(NULL AS BIGINT), 'n': 'MANUAL', 't': s.ts})
                                 ELSE w.notes END
         ELSE CAST([] AS STRUCT(o BIGINT, n VARCHAR, t TIMESTAMP)[]) END
FROM fm_walk w JOIN fm_steps s ON s.customer_id = w.customer_id AND s.perfume = w.perfume AND s.k = w.k + 1""",
    "fm_final": """
SELECT w.* FROM fm_walk w
JOIN (SELECT customer_id, perfume, max(k) AS mk FROM fm_steps GROUP BY customer_id, perfume) m
  ON m.customer_id = w.customer_id AND m.perfume = w.perfume AND w.k = m.mk""",
}


def _manual_fold_inputs(spark, d):
    return (_events(spark, d), D.f_lifecycle_orders(spark, d), D.f_lifecycle_items(spark, d),
            FO.manual_steps(manual_changes(spark, d), D.f_customers(spark, d)))


@query("collection_sources_with_manual", "O-B5+O-B7", oracle="""
SELECT customer_id, perfume, CASE WHEN owner.m THEN 'MANUAL-STUDIO' ELSE 'ORDER-' || owner.n END AS source_code
FROM fm_final WHERE owner IS NOT NULL""", extra_views=FOLD_MANUAL_VIEWS)
def collection_sources_with_manual(spark, d):
    """Exact library when admin unlocks/locks interleave with deliveries and reversals."""
    return FO.collection_sources(*_manual_fold_inputs(spark, d))


@query("unlock_notifications_with_manual", "O-B6+O-B7", oracle="""
SELECT customer_id, perfume, n.o AS order_id, n.n AS order_number, n.t AS created_at
FROM (SELECT customer_id, perfume, unnest(notes) AS n FROM fm_final)""", extra_views=FOLD_MANUAL_VIEWS)
def unlock_notifications_with_manual(spark, d):
    return FO.unlock_notifications(*_manual_fold_inputs(spark, d))


@query("stream_lifecycle_with_manual", "O-B11+O-B7", oracle="""
SELECT customer_id, perfume, CASE WHEN owner.m THEN 'MANUAL-STUDIO' ELSE 'ORDER-' || owner.n END AS source_code
FROM fm_final WHERE owner IS NOT NULL""", extra_views=FOLD_MANUAL_VIEWS)
def stream_lifecycle_with_manual(spark, d):
    """One event stream feeds both status changes and admin unlocks/locks into the keyed
    lifecycle state; returns the final library per customer."""
    views = _streamed(spark, d, "lifecycle-manual", with_manual=True)
    return views.filter(F.col("record") == "library").select("customer_id", "perfume", "source_code")
