"""O-F4: the lists of a customer's page (library, codes, rewards, orders), paged and whole.

All four children go through one exchange: they are brought to one shape (``KIND``, a sort key,
an ``item`` struct), unioned, laid out by range of (customer, kind, sort key) and cut into
pages where they lie. Nothing is joined, so no child multiplies another; a child of any
length is as many pages, none longer than ``page_size``, and a hot customer's rows are spread
over partitions. Page numbers and offsets come from a window over the pages (rows /
``page_size``), not over the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from decantry.operators.codes import PENDING_LABEL, REDEEMED_LABEL
from decantry.session import cut_lineage, ship_package

PAGE_SIZE = 100
ITEM = "struct<label:string,number:string,amount:decimal(18,2),marks:bigint,status:string,at:timestamp_ntz>"
KINDS = ("library", "codes", "rewards", "orders")


def _child(df: DataFrame, kind: str, first, second, label, number=None, amount=None, marks=None, status=None, at=None) -> DataFrame:
    null = F.lit(None)
    item = F.struct(label.alias("label"), (null if number is None else number).cast("string").alias("number"),
                    (null if amount is None else amount).cast("decimal(18,2)").alias("amount"),
                    (null if marks is None else marks).cast("bigint").alias("marks"),
                    (null if status is None else status).cast("string").alias("status"),
                    (null if at is None else at).cast("timestamp_ntz").alias("at"))
    return df.filter(F.col("customer_id").isNotNull()).select(
        F.col("customer_id").cast("bigint").alias("customer_id"), F.lit(kind).alias("kind"),
        first.cast("bigint").alias("first"), second.cast("string").alias("second"), item.alias("item"))


def page_rows(library: DataFrame | None = None, codes: DataFrame | None = None, rewards: DataFrame | None = None,
              orders: DataFrame | None = None) -> DataFrame:
    """The children in one shape. Order in a page: works by name, codes by code, rewards by
    threshold and id, orders newest first and then by number."""
    c = F.col
    zero = F.lit(0)
    parts = []
    if library is not None:
        parts.append(_child(library, "library", zero, c("perfume"), c("perfume"), status=c("source_code")))
    if codes is not None:
        parts.append(_child(codes, "codes", zero, c("code"), c("code"), c("order_number"), F.coalesce("order_total", zero),
                            F.coalesce("bookmarks_awarded", zero), F.when(c("is_redeemed"), F.lit(REDEEMED_LABEL)).otherwise(F.lit(PENDING_LABEL))))
    if rewards is not None:
        parts.append(_child(rewards, "rewards", c("threshold"), c("reward_id"), c("reward_label"), c("claimed_order_number"),
                            marks=c("threshold"), status=c("status")))
    if orders is not None:
        parts.append(_child(orders, "orders", -F.unix_micros(c("created_at").cast("timestamp")), c("order_number"), c("order_number"),
                            amount=c("order_total"), status=c("status"), at=c("created_at")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def customer_pages(rows: DataFrame, page_size: int = PAGE_SIZE, num_partitions: int | None = None) -> DataFrame:
    """``customer_id, kind, page, offset, items``: page 0, 1, ... of each list of each customer;
    ``offset`` items come before the page. A page is shorter than ``page_size`` at the end of a
    list, and where a list goes on in another partition or Arrow batch."""
    spark = rows.sparkSession
    ship_package(spark)
    order = ["customer_id", "kind", "first", "second"]
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("customer_id", "kind", "item")

    def cut(batches):
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            who, kind = batch.column(0), batch.column(1).dictionary_encode().indices.to_numpy()
            size = batch.num_rows
            if not size:
                continue
            ids = who.to_numpy(zero_copy_only=False)
            new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (kind[1:] != kind[:-1])])
            place = np.arange(size) - np.maximum.accumulate(np.where(new, np.arange(size), 0))
            heads = np.flatnonzero(place % page_size == 0)
            items = pa.ListArray.from_arrays(pa.array(np.append(heads, size), pa.int32()), batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [who.take(pa.array(heads)), batch.column(1).take(pa.array(heads)), pa.array(np.full(len(heads), part, np.int64)),
                 pa.array(np.arange(seq, seq + len(heads))), items], ["customer_id", "kind", "part", "seq", "items"])
            seq += len(heads)

    pages = cut_lineage(laid.mapInArrow(cut, f"customer_id bigint, kind string, part bigint, seq bigint, items array<{ITEM}>"))
    before = Window.partitionBy("customer_id", "kind").orderBy("part", "seq")
    # The window reads the pages' sizes alone; items come back by the page's own key.
    sizes = pages.select("customer_id", "kind", "part", "seq", F.size("items").alias("_n"))
    numbered = sizes.select("part", "seq", (F.row_number().over(before) - 1).cast("bigint").alias("page"),
                            F.coalesce(F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint").alias("offset"))
    return pages.join(numbered, ["part", "seq"]).select("customer_id", "kind", "page", "offset", "items")


def listed(pages: DataFrame, kind: str) -> DataFrame:
    """One list as rows again: ``customer_id, position`` (from 0) and the item's fields."""
    return (pages.filter(F.col("kind") == kind).select("customer_id", "offset", F.posexplode("items").alias("_i", "item"))
            .select("customer_id", (F.col("offset") + F.col("_i")).cast("bigint").alias("position"), "item.*"))
