"""Rewards, museum works and the artwork corpus (O-D*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from decantry.functions import exprs as X
from decantry.session import cut_lineage

REWARD_COLUMNS = ["id", "threshold", "reward_label", "active", "sort_order"]


# ---------------------------------------------------------------- O-D1 / O-D2
def list_rewards(rewards: DataFrame) -> DataFrame:
    """The admin's list, with the time of the last edit."""
    return rewards.select(*REWARD_COLUMNS, "updated_at").orderBy("sort_order", "threshold", "id")


def active_rewards(rewards: DataFrame) -> DataFrame:
    return rewards.filter(F.col("active")).select(*REWARD_COLUMNS).orderBy("sort_order", "threshold", "id")


# ---------------------------------------------------------------- O-D3 / O-D4 / O-D5
def apply_reward_edits(rewards: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Update by id: label trimmed, null active -> true, null sort -> 0. A miss is
    ``success = false`` (no error); a threshold that breaks ``threshold > 0`` is rejected.
    The last valid edit per id wins. Returns (rewards, per-edit results)."""
    ids = rewards.select("id").withColumn("_found", F.lit(True))
    ed = edits.join(ids, "id", "left")
    reason = (F.when(F.col("_found").isNull(), F.lit("not_found"))
              .when(F.col("threshold").isNull() | (F.col("threshold") <= 0), F.lit("invalid_threshold"))
              .when(F.col("reward_label").isNull(), F.lit("label_required")))
    ed = ed.withColumn("reject_reason", reason)
    new_vals = F.struct(F.col("threshold").cast("int").alias("threshold"),
                        F.trim("reward_label").alias("reward_label"),
                        F.coalesce("active", F.lit(True)).alias("active"),
                        F.coalesce(F.col("sort_order").cast("int"), F.lit(0)).alias("sort_order"))
    last = (ed.filter(F.col("reject_reason").isNull()).groupBy("id")
            .agg(F.max_by(new_vals, F.col("seq")).alias("_v")))
    out = rewards.join(last, "id", "left").select(
        "id", *[F.coalesce(F.col(f"_v.{c}"), F.col(c)).alias(c) for c in REWARD_COLUMNS[1:]])
    results = ed.select("id", "seq", F.col("reject_reason").isNull().alias("success"), "reject_reason")
    return out, results


def create_rewards(requests: DataFrame) -> DataFrame:
    """threshold >= 1 and a non-blank label; sort_order = threshold; active defaults to true.
    Ids are a digest of (seq, threshold, label) so a replay gives the same ids **[choice]**."""
    reason = F.when(F.col("threshold").isNull() | (F.col("threshold") < 1) | X.is_blank("reward_label"),
                    F.lit("invalid_reward"))
    digest = F.sha2(F.concat_ws("|", F.col("seq").cast("string"), F.col("threshold").cast("string"),
                                F.trim("reward_label")), 256)
    return requests.select(
        "seq", F.concat(F.lit("reward_"), F.substring(digest, 1, 32)).alias("id"),
        F.col("threshold").cast("int").alias("threshold"), F.trim("reward_label").alias("reward_label"),
        F.coalesce("active", F.lit(True)).alias("active"), F.col("threshold").cast("int").alias("sort_order"),
        reason.alias("reject_reason"))


def delete_rewards(rewards: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hard delete; success = the row existed when the request ran (first request per id)."""
    ids = rewards.select("id").withColumn("_found", F.lit(True))
    req = requests.join(ids, "id", "left")
    first = req.filter(F.col("_found")).groupBy("id").agg(F.min("seq").alias("_first"))
    req = req.join(first, "id", "left")
    results = req.select("id", "seq", (F.col("seq") == F.coalesce(F.col("_first"), F.lit(-1))).alias("success"))
    remaining = rewards.join(first.select("id"), "id", "left_anti")
    return remaining, results


# ---------------------------------------------------------------- O-D6 / O-D7
STEP_BITS = 12   # a value's node on each level: 4096 values, 4096 nodes, and the rest at the top


def _threshold_ranks(values: DataFrame, thresholds: DataFrame) -> DataFrame:
    """For each distinct ``v``: how many ``threshold`` rows are <= v, the largest of them and
    the smallest one > v.

    A prefix scan over a radix tree of the value range: a value's place inside its node of
    4096 values, the node's place among 4096 nodes, and the node above among at most 128
    (thresholds are ints). Each window therefore holds a bounded number of rows whatever the
    number of rewards or customers, and nothing pairs values with thresholds.
    """
    t = (thresholds.where("threshold is not null").groupBy(F.col("threshold").cast("bigint").alias("v"))
         .agg(F.count(F.lit(1)).alias("n")))
    points = (t.select("v", "n", F.col("v").alias("t")).unionByName(
        values.where("v is not null").select("v").distinct().select("v", F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("t"))))
    # Written once: three scans read it, and its inputs go down to the orders.
    points = cut_lineage(points.groupBy("v").agg(F.sum("n").alias("n"), F.max("t").alias("t")))
    points = points.withColumn("a", F.shiftright("v", STEP_BITS)).withColumn("b", F.shiftright("v", 2 * STEP_BITS))

    def scanned(df: DataFrame, by: list[str], order: str, upto: int, tag: str) -> DataFrame:
        below = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, upto)
        # From the other end, so that this too is a running frame: a frame up to the last row is
        # built anew for every row.
        above = Window.partitionBy(*by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
        return (df.withColumn(f"n_{tag}", F.coalesce(F.sum("n").over(below), F.lit(0)))
                .withColumn(f"top_{tag}", F.max("hi").over(below)).withColumn(f"next_{tag}", F.min("lo").over(above)))

    def nodes(keys: list[str]) -> DataFrame:
        return points.groupBy(*keys).agg(F.sum("n").alias("n"), F.max("t").alias("hi"), F.min("t").alias("lo"))

    inside = scanned(points.withColumn("hi", F.col("t")).withColumn("lo", F.col("t")), ["a", "b"], "v", 0, "v")
    mid = scanned(nodes(["a", "b"]), ["b"], "a", -1, "a").select("a", "b", "n_a", "top_a", "next_a")
    top = scanned(nodes(["b"]).withColumn("one", F.lit(0)), ["one"], "b", -1, "b").select("b", "n_b", "top_b", "next_b")
    return (inside.join(mid, ["a", "b"]).join(top, "b").select(
        "v", (F.col("n_v") + F.col("n_a") + F.col("n_b")).cast("bigint").alias("n_unlocked"),
        F.coalesce("top_v", "top_a", "top_b").cast("int").alias("top_threshold"),
        F.coalesce("next_v", "next_a", "next_b").cast("int").alias("next_threshold")))


def unlocked_rewards(balances: DataFrame, rewards: DataFrame) -> DataFrame:
    """Per customer: active rewards reached (threshold <= bookmarks) **[choice]**, the highest
    reached threshold and the next one to reach; null bookmarks reach nothing."""
    # Thresholds are ints: a balance beyond them ranks like the largest int.
    value = F.greatest(F.lit(-1), F.least(F.col("bookmarks"), F.lit((1 << 31) - 1))).cast("bigint")
    value = F.when(F.col("bookmarks").isNotNull(), value)
    b = balances.select("customer_id", "bookmarks", value.alias("v"))
    ranks = _threshold_ranks(b.select("v"), rewards.filter(F.col("active")))
    return b.join(ranks, "v", "left").select("customer_id", "bookmarks", F.coalesce("n_unlocked", F.lit(0)).cast("bigint").alias("n_unlocked"),
                                             "top_threshold", "next_threshold")


def claim_rewards(claims: DataFrame, rewards: DataFrame, balances: DataFrame) -> DataFrame:
    """Claimed rewards: the first claim (by seq) of each (customer, reward) whose active reward
    the customer's bookmarks reach. What is still pending is ``unlocked_rewards``' count
    less these rows; the pairs themselves are not stored."""
    act = rewards.filter(F.col("active")).select(F.col("id").alias("reward_id"), "threshold", "reward_label")
    first = (claims.groupBy("customer_id", "reward_id")
             .agg(F.min_by("order_number", F.col("seq")).alias("claimed_order_number")))
    return (first.join(act, "reward_id").join(balances.select("customer_id", "bookmarks"), "customer_id")
            .where(F.col("threshold") <= F.col("bookmarks"))
            .select("customer_id", "reward_id", "threshold", "reward_label", F.lit("claimed").alias("status"), "claimed_order_number"))


# ---------------------------------------------------------------- museum O-D8..O-D13
MUSEUM_COLUMNS = ["perfume_name", "brand", "artwork_path", "description", "published"]


def list_museum(museum: DataFrame) -> DataFrame:
    """The admin's list, with the time of the last edit."""
    return museum.select(*MUSEUM_COLUMNS, "updated_at").orderBy("perfume_name")


def public_museum(museum: DataFrame, published_only: bool = False) -> DataFrame:
    """Final version returns every work with its flag; ``published_only`` gives the older form."""
    m = museum.filter(F.col("published")) if published_only else museum
    return m.select(*MUSEUM_COLUMNS).orderBy("perfume_name")


def apply_museum_edits(museum: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Update by name: trimmed path and text, null published -> true; a miss is success=false."""
    names = museum.select("perfume_name").withColumn("_found", F.lit(True))
    ed = edits.join(names, "perfume_name", "left")
    reason = (F.when(F.col("_found").isNull(), F.lit("not_found"))
              .when(F.col("artwork_path").isNull() | F.col("description").isNull(), F.lit("text_required")))
    ed = ed.withColumn("reject_reason", reason)
    vals = F.struct(F.trim("artwork_path").alias("artwork_path"), F.trim("description").alias("description"),
                    F.coalesce("published", F.lit(True)).alias("published"))
    last = ed.filter(F.col("reject_reason").isNull()).groupBy("perfume_name").agg(F.max_by(vals, F.col("seq")).alias("_v"))
    out = museum.join(last, "perfume_name", "left").select(
        "perfume_name", "brand",
        *[F.coalesce(F.col(f"_v.{c}"), F.col(c)).alias(c) for c in ["artwork_path", "description", "published"]])
    return out, ed.select("perfume_name", "seq", F.col("reject_reason").isNull().alias("success"), "reject_reason")


def museum_image_fallback(museum: DataFrame, catalog: DataFrame) -> DataFrame:
    """Show the catalogue image while a work's artwork is missing."""
    cat = catalog.select(F.col("name").alias("perfume_name"), "image_url")
    return (museum.join(cat, "perfume_name", "left")
            .select("perfume_name", "artwork_path", "image_url",
                    F.coalesce(F.nullif(F.col("artwork_path"), F.lit("")), F.col("image_url")).alias("display_image")))


def accord_profile(members: DataFrame, museum: DataFrame, of: str = "accords", name: str = "accord") -> DataFrame:
    """How many works of each accord (or, ``of="notes"``, each note) every customer has
    discovered **[choice]**; a work that names one twice counts once."""
    acc = museum.select(F.col("perfume_name").alias("perfume"), F.explode(F.array_distinct(of)).alias(name))
    return (members.join(acc, "perfume").groupBy("customer_id", name)
            .agg(F.count(F.lit(1)).alias("n_works")))
