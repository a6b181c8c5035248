"""Skew-safe ordered scans per key: lag and clamped running sums.

A window partitioned by a business key puts all of one key's rows in one task; if one
order or customer holds a third of the data, that task does a third of the work. Here
each key's rows are cut into *chunks* by a time bucket of ``ts`` (``date_trunc``). The
rows are ordered by (ts, seq), so a bucket of ts is a contiguous run of that order and
the results are exact for any data; the bucket width only decides how evenly a hot key
spreads. Work inside a chunk runs in a window partitioned by (key, chunk); the
cross-chunk carry is computed on per-chunk summaries (one row per key and chunk) and
joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_CHUNK = "hour"


def _chunk(ts: str, unit: str) -> Column:
    return F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz")


def lag_by_key(df: DataFrame, key: str, value: str, out: str, default=None,
               ts: str = "ts", seq: str = "seq", unit: str = DEFAULT_CHUNK) -> DataFrame:
    """``out`` = ``value`` of the previous row of the same key in (ts, seq) order (``default``
    for the first row), computed chunk-wise so a hot key is spread over many tasks.

    One window over (key, chunk) yields both the in-chunk lag and each chunk's last value;
    the chunk summaries (one row per key and chunk) come from that same output, so the
    input is scanned and shuffled once. ``value`` must be non-null (a null is read as "no
    previous row in this chunk") and (ts, seq) unique per key.
    """
    c = df.withColumn("_chunk", _chunk(ts, unit))
    w = Window.partitionBy(key, "_chunk").orderBy(ts, seq)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    inner = c.withColumn("_lag", F.lag(value).over(w)).withColumn("_clast", F.last(value).over(whole))
    summary = (inner.select(key, "_chunk", "_clast").distinct()
               .withColumn("_carry", F.lag("_clast").over(Window.partitionBy(key).orderBy("_chunk")))
               .select(key, "_chunk", "_carry"))
    fallback = F.lit(default) if default is not None else F.lit(None)
    return (inner.join(summary, [key, "_chunk"], "left")
            .withColumn(out, F.coalesce(F.col("_lag"), F.col("_carry"), fallback))
            .drop("_chunk", "_lag", "_clast", "_carry"))


def clamped_totals(deltas: DataFrame, key: str, value: str, ts: str = "ts", seq: str = "seq",
                   unit: str = DEFAULT_CHUNK) -> DataFrame:
    """Per key: ``_sn`` = sum of ``value`` and ``_smin`` = min over prefixes of the running sum
    (prefix sums S_1..S_n in (ts, seq) order), as a two-level parallel prefix scan."""
    c = deltas.withColumn("_chunk", _chunk(ts, unit))
    w = Window.partitionBy(key, "_chunk").orderBy(ts, seq).rowsBetween(Window.unboundedPreceding, 0)
    local = (c.withColumn("_run", F.sum(value).over(w))
             .groupBy(key, "_chunk").agg(F.sum(value).alias("_tot"), F.min("_run").alias("_lmin")))
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_tot").over(before), F.lit(0))
    return (local.withColumn("_m", offset + F.col("_lmin"))
            .groupBy(key).agg(F.sum("_tot").alias("_sn"), F.min("_m").alias("_smin")))
