"""Exact dedup by progressive refinement: length, then a hash of the first bytes, then a full hash.

1. One scan makes a narrow row a document: byte length and the hash of its first
   ``prefix_chars`` characters. Lengths held by one row settle their documents.
2. Of the rest, (length, prefix hash) groups of one row settle theirs.
3. Only documents of the surviving groups have their whole text hashed (SHA-256).

The groups of step 2 are written to the shared folder; Spark then knows their size and
either broadcasts them by its own threshold (no text moves) or shuffles. Counts are
pre-aggregated before each shuffle, and the joins back to rows are plain equi-joins
against one row a group, which adaptive execution splits where a group is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decantry.llm.common import text_or_empty, written

PREFIX_CHARS = 64


def exact_dedup(docs: DataFrame, prefix_chars: int = PREFIX_CHARS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_bytes``, ``prefix_hash``, ``full_sha256``,
    ``keep_id``, ``group_size``, ``kept`` and the ``carry`` columns.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored unless carried, under
    any name but the above. Of equal texts the row with the largest ``doc_id`` stays.
    ``full_sha256`` is null where length or prefix settled the document.

    Null text counts as the empty text, so all null and empty texts are one group. A null
    ``doc_id`` sorts below every other: it stays only in a group of nothing else (then
    ``keep_id`` is null). Rows repeated with the same ``doc_id`` and text are all ``kept``
    when that id stays, and count in ``group_size``. An empty table gives no rows.
    """
    text = text_or_empty()
    keyed = docs.select(
        F.col("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"),
        F.xxhash64(F.substring(text, 1, prefix_chars)).alias("prefix_hash"), *carry)
    narrow = keyed.select("n_bytes", "prefix_hash")

    by_length = narrow.groupBy("n_bytes").agg(F.count("*").alias("n")).where("n > 1").select("n_bytes")
    by_prefix = (narrow.join(by_length, "n_bytes", "left_semi")
                 .groupBy("n_bytes", "prefix_hash").agg(F.count("*").alias("n")).where("n > 1")
                 .select("n_bytes", "prefix_hash", F.lit(True).alias("open")))
    groups = written(by_prefix, "exact-groups")

    rows = (keyed.join(groups, ["n_bytes", "prefix_hash"], "left")
            .select("doc_id", "n_bytes", "prefix_hash", *carry,
                    F.when(F.col("open"), F.sha2(F.col("text").cast("binary"), 256)).alias("full_sha256")))
    # Settled rows have no full hash, hence no partner: the left join leaves them alone.
    best = (rows.where("full_sha256 is not null").groupBy("n_bytes", "full_sha256")
            .agg(F.max("doc_id").alias("best_id"), F.count("*").alias("n")))
    return (rows.join(best, ["n_bytes", "full_sha256"], "left")
            .select("doc_id", "n_bytes", "prefix_hash", "full_sha256",
                    F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("best_id")).alias("keep_id"),
                    F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
                    F.when(F.col("n").isNull(), F.lit(True))
                    .otherwise(F.col("doc_id").eqNullSafe(F.col("best_id"))).alias("kept"), *carry))
