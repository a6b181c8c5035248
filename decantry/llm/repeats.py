"""Which 64-bit hashes occur at least twice in a corpus, as a bitmap of bounded size.

Slices of text send their sorted hashes by leading bits as packed 32-bit remainders; each
bucket is sorted once and sets the bits of its repeats. Two hashes that agree in bucket
and remainder count as one, and a bit may stand for several: the map may show a repeat
that is none, never the reverse. A hash a slice holds often is sent twice.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decantry.llm.common import map_arrow

MOST_BITS = 29  # 64 MB as a broadcast
BUCKET_HASHES = 100_000


def sizes(hashes: int, bits_each: int) -> tuple[int, int]:
    """(bits of the map's index, bits of the bucket number) for about so many hashes."""
    index = min(MOST_BITS, max(16, math.ceil(math.log2(bits_each * max(1, hashes)))))
    return index, max(index - 22, min(index - 8, max(6, math.ceil(math.log2(hashes / BUCKET_HASHES + 1)))))


def packed(hashes: np.ndarray, bucket_bits: int) -> pa.RecordBatch:
    """``bucket, hashes`` rows of one slice."""
    g = np.sort(hashes)
    if len(g) > 2:
        g = g[np.concatenate([[True, True], (g[2:] != g[1:-1]) | (g[2:] != g[:-2])])]
    bucket = (g >> np.uint64(64 - bucket_bits)).astype(np.int64)
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    rest = ((g << np.uint64(bucket_bits)) >> np.uint64(32)).astype(np.uint32)
    parts = np.split(rest, cut[1:]) if len(cut) else []
    return pa.RecordBatch.from_arrays([pa.array(bucket[cut], pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary())],
                                      ["bucket", "hashes"])


def repeated_bits(rows: DataFrame, gather, index_bits: int, bucket_bits: int) -> np.ndarray:
    """The map, on the driver (``2^index_bits`` bits). ``gather`` turns Arrow batches of
    ``rows`` into ``packed`` batches."""
    inner = index_bits - bucket_bits

    def repeated(batches):
        at, blocks = None, []

        def bits():
            g = np.sort(np.concatenate(blocks))
            hit = np.zeros(1 << inner, np.uint8)
            hit[g[1:][g[1:] == g[:-1]] >> np.uint32(32 - inner)] = 1
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([np.packbits(hit).tobytes()], pa.binary())],
                                              ["bucket", "bits"])

        for batch in batches:
            for bucket, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket != at and blocks:
                    yield bits()
                    blocks = []
                at = bucket
                blocks.append(np.frombuffer(raw, np.uint32))
        if blocks:
            yield bits()

    gathered = map_arrow(rows, gather, "bucket long, hashes binary").repartition("bucket").sortWithinPartitions("bucket")
    out = np.zeros(1 << (index_bits - 3), np.uint8)
    width = 1 << (inner - 3)
    for r in map_arrow(gathered, repeated, "bucket long, bits binary").collect():
        out[r["bucket"] * width: (r["bucket"] + 1) * width] = np.frombuffer(r["bits"], np.uint8)
    return out


def is_repeated(hashes: np.ndarray, bits: np.ndarray, index_bits: int) -> np.ndarray:
    at = (hashes >> np.uint64(64 - index_bits)).astype(np.int64)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def with_known(rows: DataFrame, hashed: DataFrame, bits_each: int = 16) -> DataFrame:
    """``rows`` (with a column ``h``: 64-bit hash of a key) and ``known``: false only where no
    row of ``hashed`` (``h``) has that hash.

    The bitmap is made by a native aggregate of 4 KB pieces; so a later join shuffles the
    texts of (nearly only) those rows that have a partner.
    """
    index = min(MOST_BITS, max(15, math.ceil(math.log2(bits_each * max(1, hashed.count())))))
    at = F.shiftrightunsigned("h", 64 - index) + 1
    pieces = hashed.select(F.bitmap_bucket_number(at).alias("b"), F.bitmap_bit_position(at).alias("p"))
    out = np.zeros(1 << (index - 3), np.uint8)
    for r in pieces.groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits")).collect():
        out[(r["b"] - 1) * 4096: r["b"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    sent = rows.sparkSession.sparkContext.broadcast(out)
    names = rows.columns

    def test(batches):
        own = sent.value
        for batch in batches:
            h = batch.column(names.index("h")).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - index)
            h = h.astype(np.int64)
            known = (own[h >> 3] >> (h & 7).astype(np.uint8)) & 1 == 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(known)], [*names, "known"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return map_arrow(rows, test, ddl + ", known boolean")
