"""Snapshot sink: tables rewritten as partitioned Parquet after a change batch.

There is no in-place update: a change batch produces a new snapshot frame, written with
dynamic partition overwrite, so only the partitions present in the frame are replaced.
Orders are laid out by status and month: status filters (every economic metric reads
delivered orders only) and month ranges then prune whole folders before any file is opened.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER_LAYOUT = ("status", "month")


def with_order_layout(orders: DataFrame, ts: str = "created_at") -> DataFrame:
    """Add the ``month`` partition column (first day of the order's month)."""
    return orders.withColumn("month", F.to_date(F.date_trunc("month", F.col(ts))))


def write_snapshot(df: DataFrame, path: str, partition_cols: tuple[str, ...] = ORDER_LAYOUT,
                   key_cols: tuple[str, ...] = ("id",), num_partitions: int | None = None) -> None:
    """Write ``df`` as Parquet partitioned by ``partition_cols``; existing partitions not in
    ``df`` are kept (dynamic overwrite).

    Rows are range-partitioned on (partition columns, key): each task covers a contiguous
    range, so it writes into only a few folders, and a folder holding a large share of the
    rows is split across many tasks by key range instead of landing on one writer. Within a
    task rows are sorted by the key, which keeps Parquet min/max statistics selective.
    """
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*partition_cols, *key_cols]
    laid_out = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    (laid_out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_cols).parquet(path))


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
