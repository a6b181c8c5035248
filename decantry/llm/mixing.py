"""Mixing sources to target weights by hash thresholds, without sorting documents.

Targets: each source has a weight; the mix holds ``share`` times all words; a source gets
at most ``max_repeat`` times its own words and what it cannot give is reshared by weight.
That fixed point is the water level L of ``sum(min(cap_i, L * w_i)) = total``: in the order
of ``cap_i / w_i`` the first sources stand at their cap and the rest share what is left.

Documents: every document has a 60-bit hash. Of a source with ``target = c * size + rest``
(0 <= rest < size) every document is taken c times and those below a hash threshold once
more, so the sets taken once, twice, ... are nested. The threshold is found from
histograms: words summed by source and leading 12 hash bits, the bucket in which the
budget runs out, then the next 12 bits of that bucket alone, and so on to the last bits.
Each histogram is a pre-aggregated sum; nothing is sorted but 4,096 sums a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decantry.llm.common import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEAT = 2
LEVEL_BITS = 12
LEVELS = 5


def word_count(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def doc_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of MD5 over id and text: the same row hashes alike in every run and engine."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"),
                   F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
                   max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``source, source_size`` (one row a source) with ``weight`` and ``target``.

    Weights go round in code-point order of the sources, null last. One row a source is
    what a mixing table holds, so the ordered windows here see that many rows.
    """
    order = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    n = len(weights)
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), ((F.row_number().over(order) - 1) % n + 1).cast("int"))
    s = sizes.select("source", "source_size", w.cast("long").alias("weight"))
    s = s.withColumn("cap", F.col("source_size") * F.lit(max_repeat))
    rank = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").cast("binary").asc_nulls_last())
    before = rank.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = (s.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
         .withColumn("caps_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
         .withColumn("weight_left", F.sum("weight").over(everything)
                     - F.coalesce(F.sum("weight").over(before), F.lit(0)))
         # The level if this source and all after it in the order were below their caps.
         .withColumn("level_here", (F.col("total") - F.col("caps_before")) / F.col("weight_left"))
         .withColumn("open_here", F.col("level_here") * F.col("weight") <= F.col("cap"))
         .withColumn("level", F.min(F.when(F.col("open_here"), F.struct((F.col("cap") / F.col("weight")).alias("r"),
                                                                         "level_here"))).over(everything)["level_here"]))
    level = F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double"))
    return s.select("source", "source_size", "weight",
                    F.least(F.col("cap").cast("double"), level).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
                max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row per input row: ``doc_id, size, source, source_size, target, copies, taken``.

    ``size`` is the number of words (null and blank texts: 0), ``target`` the words its
    source should give, ``copies`` how often the mix takes the document (0 to
    ``max_repeat``) and ``taken = copies * size``. Documents are taken in hash order while
    the middle of the document lies within the budget, so a source misses its target by
    at most half of one document (or of several with one hash: repeated rows of the same
    id and text are taken or left together). A null source is a source of its own. Sources
    without words get target 0 and are never taken. An empty table gives no rows.
    Other columns are ignored.
    """
    narrow, threshold = _plan(docs, weights, share, max_repeat)
    return (narrow.join(threshold, narrow["source"].eqNullSafe(threshold["t_source"]))
            .withColumn("copies", _copies())
            .select("doc_id", "size", "source", "source_size", "target", "copies",
                    (F.col("copies") * F.col("size")).alias("taken")))


def repeat_mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
                 max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The rows of ``docs``, with all their columns, as often as ``mix_sources`` takes them.

    The thresholds (one row a source) come to the documents; texts are not shuffled.
    """
    _, threshold = _plan(docs, weights, share, max_repeat)
    # The row travels as one struct, so that no name of it can clash.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("source").alias("key"),
                       doc_hash(F.col("doc_id"), F.col("text").cast("string")).alias("h"))
    taken = (rows.join(threshold, rows["key"].eqNullSafe(threshold["t_source"]))
             .select("row", _copies().alias("copies")).where("copies > 0")
             .select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")))
    return taken.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def _copies() -> Column:
    return F.when(F.col("source_size") > 0, F.col("whole") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0)).otherwise(0).cast("long")


def _plan(docs: DataFrame, weights: tuple[int, ...], share: float, max_repeat: int) -> tuple[DataFrame, DataFrame]:
    """Sizes and hashes of all documents, and one row a source with its threshold."""
    text = F.col("text").cast("string")
    narrow = written(docs.select("doc_id", "source", word_count(text).alias("size"),
                                 doc_hash(F.col("doc_id"), text).alias("h")), "mix-sizes")
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, share, max_repeat)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = written(targets.withColumn("whole", whole.cast("long"))
                   .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets")
    return narrow, _thresholds(narrow, plan)


def _thresholds(narrow: DataFrame, plan: DataFrame) -> DataFrame:
    """The first hash not taken, a source: documents below it fit the rest of the budget."""
    state = plan.select(F.col("source").alias("t_source"), "source_size", "target", "whole", "rest",
                        F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("spent"))
    for level in range(LEVELS):
        shift = 60 - LEVEL_BITS * (level + 1)
        inside = (narrow.join(state.select("t_source", "prefix"),
                              narrow["source"].eqNullSafe(state["t_source"])
                              & (F.shiftrightunsigned("h", shift + LEVEL_BITS) == F.col("prefix")))
                  .groupBy("t_source", F.shiftrightunsigned("h", shift).alias("bucket"))
                  .agg(F.sum("size").alias("words")))
        order = Window.partitionBy("t_source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = inside.withColumn("below", F.coalesce(F.sum("words").over(order), F.lit(0)))
        joined = sums.select(F.col("t_source").alias("s"), "bucket", "words", "below")
        last = level == LEVELS - 1
        # The budget runs out in the last bucket that begins within it; in the last level a
        # bucket is one hash, taken when its middle lies within the budget.
        begins = (F.col("spent") + F.col("below")) <= F.col("rest")
        if last:
            begins = (2 * (F.col("spent") + F.col("below")) + F.col("words")) <= 2 * F.col("rest")
        found = (state.join(joined, state["t_source"].eqNullSafe(joined["s"]), "left")
                 .groupBy("t_source")
                 .agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"),
                      F.first("whole").alias("whole"), F.first("rest").alias("rest"),
                      F.first("prefix").alias("old_prefix"), F.first("spent").alias("old_spent"),
                      F.max(F.when(begins, F.struct("bucket", "below"))).alias("hit")))
        prefix = F.col("hit.bucket") + 1 if last else F.col("hit.bucket")
        # In the last level nothing taken of the boundary bucket means: all below it.
        floor = F.shiftleft("old_prefix", LEVEL_BITS)
        state = written(found.select(
            "t_source", "source_size", "target", "whole", "rest",
            F.coalesce(prefix, floor).cast("long").alias("prefix"),
            (F.col("old_spent") + F.coalesce("hit.below", F.lit(0))).cast("long").alias("spent")),
            f"mix-level{level}")
    return state.withColumnRenamed("prefix", "threshold")
