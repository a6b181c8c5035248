"""Customers and ranking (O-F*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from decantry.operators.lifecycle import LEVELS


def _level(count_col, total_works):
    band = F.least(F.lit(len(LEVELS) - 1),
                   F.floor(count_col * F.lit(len(LEVELS) - 1) / F.greatest(total_works, F.lit(1))).cast("int"))
    return F.element_at(F.array(*[F.lit(x) for x in LEVELS]), band + 1)


def collection_ranking(members: DataFrame, customers: DataFrame, museum: DataFrame, top_k: int = 10,
                       caller_id: int | None = None) -> DataFrame:
    """Top-k opt-in customers by discovered works: ties go to the earlier profile, then id
    **[choice]**. The sort+limit (TakeOrderedAndProject) runs first, so the position window
    only ever sees k rows. ``is_caller`` marks the requesting customer's own row."""
    total = museum.select(F.count(F.lit(1))).scalar()
    counts = members.groupBy("customer_id").agg(F.count(F.lit(1)).alias("library_count"))
    part = (customers.filter(F.col("ranking_opt_in"))
            .select(F.col("id").alias("customer_id"), "customer_name", "created_at")
            .join(counts, "customer_id"))
    top = part.orderBy(F.col("library_count").desc(), "created_at", "customer_id").limit(top_k)
    w = Window.orderBy(F.col("library_count").desc(), "created_at", "customer_id")
    return top.select(
        F.row_number().over(w).cast("bigint").alias("position"), "customer_id",
        F.concat(F.substring("customer_name", 1, 3), F.lit("*** #"), F.col("customer_id").cast("string")).alias("alias"),
        F.col("library_count").cast("bigint").alias("library_count"),
        _level(F.col("library_count"), total).alias("level"),
        (F.col("customer_id") == F.lit(caller_id)).alias("is_caller") if caller_id is not None
        else F.lit(False).alias("is_caller"))


def ranking_header(ranking: DataFrame) -> DataFrame:
    """The three figures above the ranking: participants (rows shown), the leader's alias and
    the largest collection (the leader's count); '—' and 0 when nobody takes part."""
    return ranking.agg(F.count(F.lit(1)).alias("participants"),
                       F.coalesce(F.min_by("alias", F.col("position")), F.lit("—")).alias("leader"),
                       F.coalesce(F.min_by("library_count", F.col("position")), F.lit(0)).cast("bigint")
                        .alias("largest_library"))


def list_customers(customers: DataFrame, members: DataFrame, balances: DataFrame) -> DataFrame:
    """Name, phone, works, bookmarks and total per customer (children pre-aggregated)."""
    works = members.groupBy("customer_id").agg(F.count(F.lit(1)).alias("works"))
    return (customers.select(F.col("id").alias("customer_id"), "customer_name", "customer_phone", "created_at")
            .join(works, "customer_id", "left").join(balances, "customer_id", "left")
            .select("customer_id", "customer_name", "customer_phone",
                    F.coalesce("works", F.lit(0)).cast("bigint").alias("works"),
                    F.coalesce("bookmarks", F.lit(0)).cast("bigint").alias("bookmarks"),
                    F.coalesce("total_spent", F.lit(0)).cast("decimal(18,2)").alias("total_spent"))
            .orderBy("customer_name", "customer_id"))


def search_customers(customers: DataFrame, q: str) -> DataFrame:
    """lower(name) contains lower(trim(q)) or the phone contains it; literal match (no LIKE)."""
    needle = F.lit(q.strip().lower())
    hit = F.lower("customer_name").contains(needle) | F.col("customer_phone").contains(needle)
    return customers.filter(hit)


#: Customers are indexed by runs of at most this many characters, so a text of n characters has at
#: most ``RUN`` * n of them.
RUN = 32


def run_index(people: DataFrame, sizes: F.Column, *more: str) -> DataFrame:
    """``run, id`` and ``more``: which rows' name or phone (``_name``, ``_phone``) hold a run of one
    of ``sizes`` characters, each run of a row once (where it stands first)."""
    name, phone = F.col("_name"), F.col("_phone")
    texts = F.array(F.struct(name.alias("text"), F.lit(None).cast("string").alias("before")), F.struct(phone.alias("text"), name.alias("before")))
    each = (people.withColumn("_sizes", sizes).select("id", *more, F.explode(texts).alias("_t"), "_sizes")
            .select("id", *more, "_t.text", "_t.before", F.explode("_sizes").alias("_size")).filter(F.length("text") >= F.col("_size")))
    at = F.explode(F.sequence(F.lit(1), F.length("text") - F.col("_size") + 1)).alias("_at")
    runs = each.select("id", *more, "text", "before", "_size", at).withColumn("run", F.substr("text", "_at", "_size"))
    first = (F.position("run", "text") == F.col("_at")) & ~F.coalesce(F.col("before").contains(F.col("run")), F.lit(False))
    return runs.filter(first).select("id", *more, "run")


def search_many(customers: DataFrame, queries: DataFrame, parts: int | None = None) -> DataFrame:
    """``search_customers`` for a frame of queries (``q``): ``q, id`` of every match, each distinct
    query once, as ``lower(trim(q))``.

    A query is looked up as a whole: customers are laid out by their runs of the lengths that
    queries have, and a query meets exactly the customers that hold it, by an equi-join. So the
    work follows the characters of the customers and the matches, not customers times queries.
    A query longer than ``RUN`` meets the customers that hold its first ``RUN`` characters, and
    ``contains`` decides. The blank query matches every customer, and a null one none.
    Rows that share an id answer a query together: each matching row once for every matching row.
    ``parts`` lays the customers out in so many tasks and their runs in twice as many: a small
    row has some hundred runs.
    """
    def holds(name, phone):
        return F.coalesce(name.contains(F.col("q")), F.lit(False)) | F.coalesce(phone.contains(F.col("q")), F.lit(False))

    q = F.lower(F.trim("q"))
    size = F.least(F.length(q), F.lit(RUN))
    sizes = queries.filter(size > 0).select(F.collect_set(size)).scalar()
    asked = queries.select(q.alias("q")).filter(F.col("q").isNotNull()).distinct()
    row = F.struct(F.lower("customer_name").alias("_name"), F.col("customer_phone").alias("_phone"))
    named = customers.filter(F.col("id").isNotNull())
    rows = (named if parts is None else named.repartition(parts, "id")).groupBy("id").agg(F.collect_list(row).alias("_rows"))
    people = rows.select("id", F.when(F.size("_rows") > 1, F.col("_rows")).alias("_rows"), F.explode("_rows").alias("_row")).select("id", "_rows", "_row.*")

    short = asked.filter((F.length("q") > 0) & (F.length("q") <= RUN))
    index = run_index(people, sizes, "_rows")
    if parts is not None:
        short, index = short.repartition(2 * parts, "q"), index.repartition(2 * parts, "run")
    # a merge join: the runs are many times the size that Spark estimates from the customers
    found = short.join(index.hint("merge"), F.col("q") == F.col("run")).select("q", "id", "_rows")
    wide = people.filter((F.length("_name") > RUN) | (F.length("_phone") > RUN))
    heads = run_index(wide, F.array(F.lit(RUN)), "_rows", "_name", "_phone")
    rest = (asked.filter(F.length("q") > RUN).join(heads.hint("merge"), F.substring("q", 1, RUN) == F.col("run"))
            .filter(holds(F.col("_name"), F.col("_phone"))).select("q", "id", "_rows"))
    hits = found.unionByName(rest)
    times = F.when(F.col("_rows").isNull(), F.lit(1)).otherwise(F.size(F.filter("_rows", lambda r: holds(r["_name"], r["_phone"]))))
    hits = hits.select("q", "id", F.explode(F.array_repeat(F.lit(0), times))).select("q", "id")

    blank = asked.filter("q = ''").select(F.count(F.lit(1))).scalar()
    texts = F.col("customer_name").isNotNull() | F.col("customer_phone").isNotNull()
    return hits.unionByName(customers.filter(texts & (blank > 0)).select(F.lit("").alias("q"), "id"))


def customer_360(customers: DataFrame, orders: DataFrame, members: DataFrame, balances: DataFrame,
                 codes: DataFrame, unlocked: DataFrame, museum: DataFrame) -> DataFrame:
    """Profile plus per-child counts and the collection level, each child aggregated to one
    row per customer before the joins, so no multi-way row fan-out."""
    total = museum.select(F.count(F.lit(1))).scalar()
    o = (orders.filter(F.col("customer_id").isNotNull()).groupBy("customer_id")
         .agg(F.count(F.lit(1)).alias("n_orders"),
              F.count(F.when(F.col("status") == "delivered", True)).alias("n_delivered")))
    lib = members.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n_library"))
    cd = codes.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n_codes"))
    rw = unlocked.select("customer_id", "n_unlocked")
    base = customers.select(F.col("id").alias("customer_id"), "customer_name", "customer_phone")
    j = (base.join(o, "customer_id", "left").join(lib, "customer_id", "left").join(balances, "customer_id", "left")
         .join(cd, "customer_id", "left").join(rw, "customer_id", "left"))
    z = lambda c, t="bigint": F.coalesce(F.col(c), F.lit(0)).cast(t).alias(c)
    return j.select("customer_id", "customer_name", "customer_phone", z("n_orders"), z("n_delivered"),
                    z("total_spent", "decimal(18,2)"), z("bookmarks"), z("n_library"), z("n_codes"), z("n_unlocked"),
                    _level(F.coalesce(F.col("n_library"), F.lit(0)), total).alias("level"))


def apply_customer_edits(customers: DataFrame, balances: DataFrame, edits: DataFrame) -> DataFrame:
    """Admin edits set name, phone, bookmarks and total absolutely; the last edit wins."""
    vals = F.struct("customer_name", "customer_phone", F.col("bookmarks").cast("bigint").alias("bookmarks"),
                    F.col("total_spent").cast("decimal(18,2)").alias("total_spent"))
    last = edits.groupBy("customer_id").agg(F.max_by(vals, F.col("seq")).alias("_e"))
    base = (customers.select(F.col("id").alias("customer_id"), "customer_name", "customer_phone")
            .join(balances, "customer_id", "left").join(last, "customer_id", "left"))
    edited = F.col("_e").isNotNull()
    return base.select(
        "customer_id",
        *[F.when(edited, F.col(f"_e.{c}")).otherwise(F.col(c)).alias(c) for c in ["customer_name", "customer_phone"]],
        F.when(edited, F.col("_e.bookmarks")).otherwise(F.coalesce("bookmarks", F.lit(0))).cast("bigint").alias("bookmarks"),
        F.when(edited, F.col("_e.total_spent")).otherwise(F.coalesce("total_spent", F.lit(0)))
         .cast("decimal(18,2)").alias("total_spent"))


#: What happens to a table's rows when their customer's profile goes: the key that names the
#: customer and the action. Orders stay without their customer; everything else goes with it.
ON_DELETE = {"customers": ("id", "delete"), "members": ("customer_id", "delete"), "codes": ("customer_id", "delete"),
             "notifications": ("customer_id", "delete"), "orders": ("customer_id", "set null")}


def delete_customers(requests: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """The named tables (keys of ``ON_DELETE``) after the profiles of ``requests`` are gone.

    One frame of keys drives all rules. Only the tables passed in are rewritten, each as an
    independent plan with one join on the keys; null keys belong to nobody and stay.
    """
    gone = requests.select(F.col("customer_id").alias("_gone")).filter(F.col("_gone").isNotNull()).distinct()
    out: dict[str, DataFrame] = {}
    for name, table in tables.items():
        key, action = ON_DELETE[name]
        if action == "delete":
            out[name] = table.join(gone, table[key] == gone["_gone"], "left_anti")
        else:
            kept = F.when(F.col("_gone").isNull(), F.col(key)).alias(key)
            out[name] = (table.join(gone, table[key] == gone["_gone"], "left")
                         .select(*[kept if c == key else F.col(c) for c in table.columns]))
    return out


def reset_customers(customers: DataFrame, members: DataFrame, balances: DataFrame,
                    requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clear collection, bookmarks and total of the listed customers; keep the profile."""
    ids = requests.select("customer_id").distinct().withColumn("_reset", F.lit(True))
    b = (customers.select(F.col("id").alias("customer_id")).join(balances, "customer_id", "left")
         .join(ids, "customer_id", "left"))
    hit = F.coalesce(F.col("_reset"), F.lit(False))
    out = b.select("customer_id",
                   F.when(hit, F.lit(0)).otherwise(F.coalesce("bookmarks", F.lit(0))).cast("bigint").alias("bookmarks"),
                   F.when(hit, F.lit(0)).otherwise(F.coalesce("total_spent", F.lit(0))).cast("decimal(18,2)").alias("total_spent"))
    return out, members.join(ids.select("customer_id"), "customer_id", "left_anti")
