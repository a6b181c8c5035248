"""The ownership fold of a (customer, perfume) whose history is too long for one task.

``fold`` walks a key's steps in order. Here the steps of the longest keys are laid out by
range (key, ts, seq), so that a key lies in as many partitions (*parts*) as its length asks
for, and the walk is replaced by questions that parts answer side by side:

* **intervals**: the step that ends each delivery (next step of the same order);
* **resets**: moments without a row: the last lock, and after it every moment at which the
  running number of live deliveries (prefix sums of parts, then of steps) is 0;
* **grabs**: the first delivery or unlock after each reset takes the row. An unlock keeps it
  to the end; otherwise only the deliveries after the last reset, and those that were live
  at it, matter (the *live stretch*);
* **links**: when an owner leaves, the latest live delivery takes over. In a part that is the
  best of the deliveries that begin or end there and of one *cover*, the best delivery that
  spans the whole part; covers come from maxima over dyadic ranges of parts. A part returns,
  for every delivery that ends in it, the owner at the part's end;
* the owner is found from the first grab by squaring these links, in as many rounds as the
  logarithm of the number of parts.

Windows are over one key in one part, or over one row a part; no step sees a whole key.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decantry.functions import exprs as X
from decantry.session import cut_lineage, ship_package

KEY = ["customer_id", "perfume"]
ORDER = [*KEY, "ts", "seq", "_k"]
PART_BITS = 33          # monotonically_increasing_id puts the partition above these bits
_LINKS = "customer_id bigint, perfume string, at bigint, next bigint"


def lay_out(steps: DataFrame, num_partitions: int) -> DataFrame:
    """The steps with ``pos``, their place in the order of all keys, and ``part``."""
    laid = steps.repartitionByRange(num_partitions, *ORDER).sortWithinPartitions(*ORDER)
    laid = cut_lineage(laid.withColumn("pos", F.monotonically_increasing_id()))
    return laid.withColumn("part", F.shiftright("pos", PART_BITS))


def _before(value: Column) -> Column:
    """``value`` summed or maximised over a key's earlier parts (for frames of one row a part)."""
    return value.over(Window.partitionBy(*KEY).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))


def _in_part() -> Window:
    return Window.partitionBy(*KEY, "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)


def intervals(laid: DataFrame) -> DataFrame:
    """Deliveries ``at`` (position of the enter step) .. ``until`` (of the leave step; null: live)."""
    moves = laid.filter(F.col("kind").isin("enter", "leave"))
    own = Window.partitionBy(*KEY, "order_id", "part").orderBy("pos")
    moves = moves.withColumn("_next", F.lead("pos").over(own))
    later = (moves.groupBy(*KEY, "order_id", "part").agg(F.min("pos").alias("_first"))
             .withColumn("_carry", F.lead("_first").over(Window.partitionBy(*KEY, "order_id").orderBy("part"))).drop("_first"))
    return (moves.filter(F.col("kind") == "enter").join(later, [*KEY, "order_id", "part"])
            .select(*KEY, "order_id", "order_number", "created_at", "ts", F.col("pos").alias("at"),
                    F.coalesce("_next", "_carry").alias("until")))


def segments(laid: DataFrame, spans: DataFrame) -> DataFrame:
    """Steps after a key's last lock with ``seg``, the position of the last reset before them
    (-1: none). A step that resets belongs to the segment it opens."""
    locks = laid.filter(F.col("kind") == "lock").groupBy(*KEY).agg(F.max("pos").alias("_lock"))
    live = (spans.join(locks, KEY).filter((F.col("at") < F.col("_lock")) & (F.col("until").isNull() | (F.col("until") > F.col("_lock"))))
            .groupBy(*KEY).agg(F.count(F.lit(1)).alias("_live")))
    after = (laid.join(locks, KEY, "left").filter(F.col("_lock").isNull() | (F.col("pos") > F.col("_lock")))
             .join(live, KEY, "left"))
    delta = F.when(F.col("kind") == "enter", 1).when(F.col("kind") == "leave", -1).otherwise(0)
    after = after.withColumn("_run", F.sum(delta).over(_in_part()))
    carried = (after.groupBy(*KEY, "part").agg(F.max_by("_run", "pos").alias("_sum"))
               .withColumn("_offset", F.coalesce(_before(F.sum("_sum")), F.lit(0))).drop("_sum"))
    after = after.join(carried, [*KEY, "part"])
    count = F.coalesce(F.col("_live"), F.lit(0)) + F.col("_offset") + F.col("_run")
    after = after.withColumn("_reset", F.max(F.when((F.col("kind") == "leave") & (count == 0), F.col("pos"))).over(_in_part()))
    carried = (after.groupBy(*KEY, "part").agg(F.max("_reset").alias("_last")).withColumn("_back", _before(F.max("_last"))).drop("_last"))
    return (after.join(carried, [*KEY, "part"])
            .withColumn("seg", F.coalesce("_reset", "_back", "_lock", F.lit(-1)))
            .drop("_run", "_offset", "_live", "_reset", "_back", "_lock"))


def _ranges(lo: Column, hi: Column, levels: int) -> Column:
    """The dyadic ranges (level, number) that make up ``lo`` .. ``hi`` (both included)."""
    nodes = []
    for k in range(levels):
        low, high = F.shiftright(lo + F.lit((1 << k) - 1), k), F.shiftright(hi + F.lit(1), k)
        some = low < high
        nodes += [F.when(some & (low % 2 == 1), F.struct(F.lit(k).alias("level"), low.alias("node"))),
                  F.when(some & (high % 2 == 1), F.struct(F.lit(k).alias("level"), (high - 1).alias("node")))]
    return F.filter(F.array(*nodes), lambda x: x.isNotNull())


def _rank() -> Column:
    """Later delivery, later order, greater number [choice]."""
    return F.struct(F.col("ts"), F.coalesce("created_at", F.lit("1700-01-01").cast("timestamp_ntz")).alias("c"),
                    F.coalesce("order_number", F.lit("")).alias("n"), "order_id")


def covers(spans: DataFrame, parts: DataFrame, levels: int) -> DataFrame:
    """For each (key, part) of ``parts`` the best delivery that begins before it and ends after it."""
    last = F.lit((1 << levels) - 1)
    begin, end = F.shiftright("at", PART_BITS), F.shiftright("until", PART_BITS)
    wide = (spans.withColumn("_lo", begin + 1).withColumn("_hi", F.coalesce(end - 1, last)).filter("_lo <= _hi")
            .groupBy(*KEY, "_lo", "_hi").agg(F.max(F.struct(_rank().alias("r"), "at", "until")).alias("_best")))
    nodes = (wide.withColumn("_n", F.explode(_ranges(F.col("_lo"), F.col("_hi"), levels)))
             .groupBy(*KEY, F.col("_n.level").alias("level"), F.col("_n.node").alias("node")).agg(F.max("_best").alias("_best")))
    asked = (parts.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
             .withColumn("node", F.expr("shiftright(part, level)")))
    best = asked.join(nodes, [*KEY, "level", "node"]).groupBy(*KEY, "part").agg(F.max("_best").alias("_best"))
    return best.select(*KEY, "part", F.col("_best.at").alias("at"), F.col("_best.until").alias("until"),
                       F.col("_best.r").alias("r"))


def _part_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """One key in one part: who owns the row at the part's end, for every delivery that ends here."""
    part = int(pdf["part"].iloc[0])
    rank = list(zip(pdf["ts"].tolist(), pdf["c"].tolist(), pdf["n"].tolist(), pdf["order_id"].tolist()))
    order = {r: i for i, r in enumerate(sorted(set(rank)))}
    spans = {int(a): (None if u != u or u is None else int(u), -order[r])
             for a, u, r in zip(pdf["at"].tolist(), pdf["until"].astype(object).tolist(), rank)}
    begins = sorted(a for a in spans if a >> PART_BITS == part)
    heap = [(r, a) for a, (_, r) in spans.items() if a >> PART_BITS < part]
    heapq.heapify(heap)
    ends = sorted((u, a) for a, (u, _) in spans.items() if u is not None and u >> PART_BITS == part)
    next_of, k = {}, 0
    for until, a in ends:
        while k < len(begins) and begins[k] < until:
            heapq.heappush(heap, (spans[begins[k]][1], begins[k]))
            k += 1
        while heap and spans[heap[0][1]][0] is not None and spans[heap[0][1]][0] <= until:
            heapq.heappop(heap)
        if heap:
            next_of[a] = heap[0][1]
    leaving = dict((a, u) for u, a in ends)
    for _, a in reversed(ends):
        if a in next_of and next_of[a] in leaving:
            # A later owner that ends in this part without a successor leaves no row behind.
            next_of[a] = next_of.get(next_of[a], next_of[a])
    key = {c: pdf[c].iloc[0] for c in KEY}
    return pd.DataFrame({**{c: [v] * len(next_of) for c, v in key.items()}, "at": list(next_of), "next": list(next_of.values())},
                        columns=["customer_id", "perfume", "at", "next"])


def links(spans: DataFrame, levels: int) -> DataFrame:
    begin, end = F.shiftright("at", PART_BITS), F.shiftright("until", PART_BITS)
    cols = [*KEY, "part", "at", "until", _rank().alias("r")]
    here = spans.withColumn("part", F.explode(F.array_distinct(F.filter(F.array(begin, end), lambda x: x.isNotNull())))).select(*cols)
    parts = here.filter(F.shiftright("until", PART_BITS) == F.col("part")).select(*KEY, "part").distinct()
    rows = here.join(parts, [*KEY, "part"], "left_semi").unionByName(covers(spans, parts, levels))
    return (rows.select(*KEY, "part", "at", "until", "r.ts", "r.c", "r.n", "r.order_id")
            .groupBy(*KEY, "part").applyInPandas(_part_links, _LINKS))


def _followed(start: DataFrame, jumps: DataFrame, levels: int) -> DataFrame:
    """``start`` (key, at) moved along the links to their ends."""
    jumps = cut_lineage(jumps)
    for k in range(levels + 1):
        hop = jumps.select(*KEY, "at", F.col("next").alias("_next"))
        start = cut_lineage(start.join(hop, [*KEY, "at"], "left").select(*KEY, F.coalesce("_next", "at").alias("at")))
        if k < levels:
            again = jumps.select(*KEY, F.col("at").alias("next"), F.col("next").alias("_over"))
            jumps = cut_lineage(jumps.join(again, [*KEY, "next"], "left").select(*KEY, "at", F.coalesce("_over", "next").alias("next")))
    return start


def hot_fold(steps: DataFrame, num_partitions: int) -> DataFrame:
    """Library rows and live notifications of the keys of ``steps`` (the columns of
    ``fold.collection_fold``'s steps and ``_k``), as ``fold`` gives them."""
    ship_package(steps.sparkSession)
    laid = lay_out(steps, num_partitions)
    levels = max(1, (num_partitions - 1).bit_length())
    spans = cut_lineage(intervals(laid))
    after = cut_lineage(segments(laid, spans))
    taker = F.struct("pos", "kind", "ts")
    grabs = after.filter(F.col("kind").isin("enter", "unlock")).groupBy(*KEY, "seg").agg(F.min(taker).alias("g"))
    last_seg = after.groupBy(*KEY).agg(F.max("seg").alias("seg"))
    manual = grabs.filter("g.kind = 'unlock'").select(*KEY).distinct()

    # The first unlock that found no notification: its segment's taker was an unlock or had left.
    ends = spans.select(*KEY, F.col("at").alias("_at"), F.col("until").alias("_until"))
    held = (grabs.select(*KEY, "seg", F.col("g.pos").alias("_at"), F.col("g.kind").alias("_kind")).join(ends, [*KEY, "_at"], "left"))
    noted = (after.filter(F.col("kind") == "unlock").join(held, [*KEY, "seg"])
             .filter((F.col("_kind") == "unlock") | (F.col("_until") < F.col("pos")))
             .groupBy(*KEY).agg(F.min_by("ts", "pos").alias("created_at")))

    # Owners by delivery: from the taker of the last segment along the links of the live stretch.
    first = (grabs.join(last_seg, [*KEY, "seg"]).filter("g.kind = 'enter'").join(manual, KEY, "left_anti")
             .select(*KEY, F.col("g.pos").alias("at"), "seg"))
    stretch = (spans.join(first.select(*KEY, "seg"), KEY).filter(F.col("until").isNull() | (F.col("until") > F.col("seg"))).drop("seg"))
    owner = _followed(first.select(*KEY, "at"), links(stretch, levels), levels)
    owned = owner.join(spans, [*KEY, "at"]).filter(F.col("until").isNull())
    fresh = first.join(spans, [*KEY, "at"]).filter(F.col("until").isNull())

    def rows(df, record, order_id, number, source, created):
        return df.select(F.lit(record).alias("record"), *KEY, order_id.cast("bigint").alias("order_id"), number.alias("order_number"),
                         source.alias("source_code"), created.cast("timestamp_ntz").alias("created_at"))

    none = F.lit(None).cast("string")
    return (rows(manual, "library", F.lit(None), none, F.lit(X.MANUAL_SOURCE), F.lit(None))
            .unionByName(rows(owned, "library", F.col("order_id"), F.col("order_number"),
                              F.concat(F.lit(X.ORDER_SOURCE_PREFIX), "order_number"), F.lit(None)))
            .unionByName(rows(noted, "notification", F.lit(None), F.lit(X.MANUAL_NOTE_NUMBER), none, F.col("created_at")))
            .unionByName(rows(fresh, "notification", F.col("order_id"), F.col("order_number"), none, F.col("ts"))))
