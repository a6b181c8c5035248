"""Cross-site line dedup: lines that many distinct sites share are boilerplate.

Each line is a 128-bit key (two xxhash64 with different seeds) of its text without blanks
at the ends. Per key, HyperLogLog sketches of the sites merge by aggregation (partial
sketches before the shuffle). Keys whose estimate is clearly above the threshold are
boilerplate, clearly below are not; keys near the threshold get exact distinct counts.
Then the boilerplate lines leave every text.

DataFrame functions only. A text is named by its own 128-bit key, so copies are treated
once and no row number is needed; the lines found in a text come back to it by that key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decantry.llm.common import written

MIN_SITES = 10
LG_K = 10  # 2^10 registers: about 3.3 % standard error
NEAR = 0.15  # beyond four standard errors of the estimate
BLANKS = " \t\r"


def _key(value: Column) -> tuple[Column, Column]:
    return F.xxhash64(value), F.xxhash64(F.lit(1), value)


def _line(raw: Column) -> Column:
    return F.btrim(raw, F.lit(BLANKS))


def site_spread(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, near: float = NEAR) -> DataFrame:
    """``k1, k2`` of lines on at least ``min_sites`` distinct sites; from ``k1, k2, site``.

    A null site is no site.
    """
    sketched = (lines.where("site is not null").groupBy("k1", "k2")
                .agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites")))
    sketched = written(sketched.where(F.col("sites") >= F.floor(F.lit(min_sites * (1 - near)))), "line-spread")
    clear = sketched.where(F.col("sites") > F.ceil(F.lit(min_sites * (1 + near)))).select("k1", "k2")
    close = sketched.where(F.col("sites") <= F.ceil(F.lit(min_sites * (1 + near)))).select("k1", "k2")
    # Distinct first: a line that a site repeats a million times is one row a task.
    exact = (lines.where("site is not null").join(close, ["k1", "k2"], "left_semi")
             .select("k1", "k2", "site").distinct().groupBy("k1", "k2").agg(F.count("*").alias("n"))
             .where(F.col("n") >= min_sites).select("k1", "k2"))
    return written(clear.union(exact), "boilerplate")


def line_dedup(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: ``doc_id``, the ``carry`` columns, ``n_lines``, ``n_removed``, ``kept_text``.

    Lines are parts between ``\\n``; a line without anything but blanks, tabs and carriage
    returns is never boilerplate. All occurrences of a boilerplate line leave, whatever the
    row's own site; the other lines stay as they are, in order, joined by ``\\n``.

    A null text counts as empty: one empty line, nothing removed. Rows with a null site add
    no site but lose boilerplate lines like the rest. Repeated rows come out as often as
    they came in. An empty table gives no rows. ``carry`` names must not be the above.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    t1, t2 = _key(text)
    rows = docs.select("doc_id", *carry, text.alias("_text"), F.col(site).cast("string").alias("_site"),
                       t1.alias("_t1"), t2.alias("_t2"))
    line = F.explode(F.array_distinct(F.transform(F.split("_text", "\n", -1), _line))).alias("line")
    own = rows.select(line, F.col("_site").alias("site"), "_t1", "_t2").where("line <> ''")
    k1, k2 = _key(F.col("line"))
    keyed = own.select(k1.alias("k1"), k2.alias("k2"), "site", "_t1", "_t2")
    boilerplate = site_spread(keyed.select("k1", "k2", "site"), min_sites)
    # The lines to remove of each distinct text, by key; a set, so copies of a text add nothing.
    hits = (keyed.select("k1", "k2", "_t1", "_t2").join(boilerplate, ["k1", "k2"])
            .groupBy("_t1", "_t2").agg(F.collect_set(F.struct("k1", "k2")).alias("gone")))
    hits = written(hits, "line-hits")
    found = rows.join(hits, ["_t1", "_t2"], "left")
    parts = F.split("_text", "\n", -1)

    def stays(raw: Column) -> Column:
        a, b = _key(_line(raw))
        return F.col("gone").isNull() | ~F.array_contains("gone", F.struct(a.alias("k1"), b.alias("k2")))

    return (found.select("doc_id", *carry, parts.alias("_parts"), "gone")
            .withColumn("_kept", F.when(F.col("gone").isNull(), F.col("_parts")).otherwise(F.filter("_parts", stays)))
            .select("doc_id", *carry, F.size("_parts").cast("long").alias("n_lines"),
                    (F.size("_parts") - F.size("_kept")).cast("long").alias("n_removed"),
                    F.array_join("_kept", "\n").alias("kept_text")))
