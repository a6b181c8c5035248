"""O-B3 carried on from batch to batch: a customer's clamped balance as a mergeable summary.

The walk ``b <- greatest(0, b + d)``, restarted by absolute overrides, needs of all earlier
deltas only three numbers a customer: ``start`` (value of the last override, 0 before one),
``total`` (sum of the deltas since) and ``low`` (least prefix sum since, at most 0). Two
stretches in turn join to one (an override in the later one wins; else sums add, and the
later low is seen from the earlier total), so a batch reads its own events and the stored
summaries of the customers it names. Balance: ``start + total`` where the walk never touched
0, lifted by what the floor gave back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decantry.operators.ordered import DEFAULT_CHUNK, clamped_totals

SUMMARY = ["customer_id", "start", "total", "low"]


def summarise(deltas: DataFrame, overrides: DataFrame | None = None, value: str = "delta",
              start: str = "start_value", unit: str = DEFAULT_CHUNK) -> DataFrame:
    """One batch: ``customer_id, opened, start, total, low`` (``opened``: it has an override).

    ``deltas`` (customer_id, ts, seq, value); ``overrides`` (customer_id, ts, seq, start). A hot
    customer is summed chunk by chunk (``ordered.clamped_totals``).
    """
    kind = deltas.schema[value].dataType
    d = deltas
    key = F.struct("ts", "seq")
    if overrides is not None:
        last = overrides.groupBy("customer_id").agg(F.max_by(F.struct(start, "ts", "seq"), key).alias("_o"))
        d = (d.join(last, "customer_id", "left").filter(F.col("_o").isNull() | (key > F.struct("_o.ts", "_o.seq"))).drop("_o"))
    sums = clamped_totals(d, "customer_id", value, unit=unit)
    if overrides is None:
        joined = sums.withColumn("_o", F.lit(None).cast(f"struct<{start}:{kind.simpleString()}>"))
    else:
        joined = sums.join(last, "customer_id", "full")
    zero = F.lit(0).cast(kind)
    return joined.select(
        "customer_id", F.col("_o").isNotNull().alias("opened"),
        F.coalesce(F.col(f"_o.{start}").cast(kind), zero).alias("start"),
        F.coalesce(F.col("_sn"), F.lit(0)).alias("total"),
        F.least(F.coalesce(F.col("_smin"), F.lit(0)), F.lit(0)).alias("low"))


def merged(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """The stored summaries with a later batch's joined on; a null-safe match of customers."""
    b = batch.select(*[F.col(c).alias(f"_{c}") for c in ("customer_id", *batch.columns[1:])])
    rows = stored.join(b, F.col("customer_id").eqNullSafe(F.col("_customer_id")), "full")
    # Customer rows of one side only have null in the other's columns.
    here, there = F.col("start").isNotNull(), F.col("_start").isNotNull()
    fresh = F.col("_opened") | ~here
    types = {f.name: f.dataType for f in stored.schema.fields}

    def pick(name: str, both: Column) -> Column:
        return F.when(~there, F.col(name)).when(fresh, F.col(f"_{name}")).otherwise(both).cast(types[name]).alias(name)

    return rows.select(F.when(here, F.col("customer_id")).otherwise(F.col("_customer_id")).alias("customer_id"),
                       pick("start", F.col("start")), pick("total", F.col("total") + F.col("_total")),
                       pick("low", F.least(F.col("low"), F.col("total") + F.col("_low"))))


def balance() -> Column:
    """The balance of a summary: the floor lifts it by how far the walk would have gone below 0."""
    return F.col("start") + F.col("total") + F.greatest(F.lit(0), -(F.col("start") + F.col("low")))
