"""Helpers the operators of this subpackage share: tables, scratch tables, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from decantry.session import delete_folder, ensure_checkpoint_dir, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OPEN: list[list[str]] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder named by ``spark.checkpoint.dir``."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/decantry-llm/{label}-{uuid.uuid4().hex}"
    for made in _OPEN:
        made.append(path)
    return path


@contextmanager
def scratch_made() -> Iterator[list[str]]:
    """The scratch paths made inside, for ``drop_paths`` once their readers are done."""
    made: list[str] = []
    _OPEN.append(made)
    try:
        yield made
    finally:
        _OPEN.remove(made)


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        delete_folder(spark, path)


@contextmanager
def arrow_rows(spark: SparkSession, most: int):
    """Arrow batches of at most ``most`` rows for the jobs run inside, whatever the session allows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(most, int(before)) if int(before) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back.

    It cuts the lineage (a lost executor costs no recomputation before this point), fixes
    rows that a later step reads more than once and gives Spark the true size, so that it
    broadcasts the table by its own threshold or not at all.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete every scratch table below the shared folder (for the end of an application)."""
    delete_folder(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/decantry-llm")


def release(spark: SparkSession) -> None:
    """Let go of what earlier steps left: Spark deletes shuffle files and broadcasts only once the
    driver's JVM has collected the frames that made them, which may take long where the heap
    is large and the steps are many."""
    gc.collect()
    spark._jvm.System.gc()


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


_LEAN: list[bool] = []


@contextmanager
def lean_workers() -> Iterator[None]:
    """Workers of the maps built inside give freed memory back after each batch and task.

    An executor keeps several workers, as many as ran at once in any step before, and takes
    them in turn; what Arrow and the C library hold for later use stays in each, idle or not.
    It costs CPU time, so it is for jobs of many steps. The maps' rows do not change.
    """
    _LEAN.append(True)
    try:
        yield
    finally:
        _LEAN.pop()


def give_back() -> None:
    """Return memory that Arrow's pool and the C library (where it can: glibc) hold without use."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(fn):
    """``fn`` over Arrow batches, with ``give_back`` after each batch and at the end."""
    def run(batches):
        def each():
            for batch in batches:
                yield batch
                del batch
                give_back()

        yield from fn(each())
        give_back()

    return run


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` with this package importable in the workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(lean(fn) if _LEAN else fn, schema)


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` holds about ``max_bytes`` a slice.

    A single longer value makes a slice of its own; every row comes out once, in order.
    """
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        ends = col.offsets if hasattr(col, "offsets") else None
        if ends is None:
            ends = _offsets(col)
        else:
            ends = ends.to_numpy(zero_copy_only=False)
        first = 0
        while first < batch.num_rows:
            last = first + 1
            while last < batch.num_rows and ends[last + 1] - ends[first] <= max_bytes:
                last += 1
            yield batch.slice(first, last - first)
            first = last


def _offsets(col: pa.Array):
    import numpy as np

    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    raw = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)
    return raw[col.offset: col.offset + len(col) + 1]


def utf8_bytes(col: pa.Array):
    """(bytes, offsets) of a string or binary column without nulls, as numpy arrays."""
    import numpy as np

    ends = _offsets(col).astype(np.int64)
    data = col.buffers()[2]
    if data is None:
        return np.zeros(0, np.uint8), ends - ends[0]
    raw = np.frombuffer(data, dtype=np.uint8)[ends[0]: ends[-1]]
    return raw, ends - ends[0]
