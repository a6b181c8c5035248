"""Stored tables that change batches update in place of the reference's row updates.

A store is a folder of Parquet *buckets* (a hash of the key) and numbered manifests:

    <path>/data/<version>-<run>/bucket=<n>/part-*.parquet
    <path>/manifests/<version>.json

A manifest names the folders that hold each bucket, the batches applied so far and the
sequence marks. A batch reads and rewrites only the buckets its keys fall into, under a new
folder; the commit is the creation of the next manifest, which fails where one exists. So

* readers see one version or the next, never a mixture;
* a writer lost before the commit leaves files that no manifest names (``vacuum`` deletes
  them), and its batch can simply run again;
* a batch that is already applied changes nothing;
* of two writers that started from one version the second gets ``StoreConflict``.

The creation must be exclusive in the file system (HDFS, or an object store with
conditional writes). The driver handles bucket numbers and folder names only: at most
``buckets`` of them, chosen so that a bucket is one task's work.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from decantry.session import delete_folder

BUCKETS = 64


class StoreConflict(RuntimeError):
    """Another writer committed this version first."""


@dataclass
class Manifest:
    version: int
    key: str
    buckets: int
    schema: str
    folders: dict[str, list[str]] = field(default_factory=dict)   # bucket -> folders with its rows
    batches: dict[str, int] = field(default_factory=dict)   # batch id -> version that applied it
    marks: dict[str, int] = field(default_factory=dict)     # sequence name -> last number given

    def struct(self) -> StructType:
        return StructType.fromJson(json.loads(self.schema))


def _fs(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def _manifest_path(path: str, version: int) -> str:
    return f"{path.rstrip('/')}/manifests/{version:012d}.json"


def _versions(spark: SparkSession, path: str) -> list[int]:
    fs, there = _fs(spark, f"{path.rstrip('/')}/manifests")
    if not fs.exists(there):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(there)]
    return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json") and not n.startswith((".", "_")))


def manifest_of(spark: SparkSession, path: str, version: int | None = None) -> Manifest | None:
    """The manifest of a version (default: the last), or None where there is no store."""
    if version is None:
        versions = _versions(spark, path)
        if not versions:
            return None
        version = versions[-1]
    fs, there = _fs(spark, _manifest_path(path, version))
    stream = fs.open(there)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return Manifest(**json.loads(text))


def _commit(spark: SparkSession, path: str, manifest: Manifest) -> None:
    """Write the manifest beside its place and move it there, unless the version exists."""
    fs, there = _fs(spark, _manifest_path(path, manifest.version))
    _, beside = _fs(spark, f"{path.rstrip('/')}/manifests/.{manifest.version:012d}-{uuid.uuid4().hex}")
    stream = fs.create(beside, False)
    try:
        stream.write(bytearray(json.dumps(manifest.__dict__, sort_keys=True).encode()))
    finally:
        stream.close()
    if fs.exists(there) or not fs.rename(beside, there):
        fs.delete(beside, False)
        raise StoreConflict(f"version {manifest.version} of {path} exists")


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def _write(spark: SparkSession, path: str, df: DataFrame, manifest: Manifest) -> dict[str, list[str]]:
    """The rows by bucket under a new folder; the buckets that have rows."""
    folder = f"{path.rstrip('/')}/data/{manifest.version:012d}-{uuid.uuid4().hex[:8]}"
    rows = df.withColumn("bucket", bucket_of(manifest.key, manifest.buckets))
    (rows.repartition(F.col("bucket")).sortWithinPartitions("bucket", manifest.key)
     .write.partitionBy("bucket").parquet(folder))
    fs, there = _fs(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(there)]
    return {n.split("=")[1]: [f"{folder}/{n}"] for n in names if n.startswith("bucket=")}


def create_store(df: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Version 1: all rows of ``df``."""
    spark = df.sparkSession
    manifest = Manifest(1, key, buckets, df.schema.json())
    manifest.folders = _write(spark, path, df, manifest)
    _commit(spark, path, manifest)


def read_store(spark: SparkSession, path: str, version: int | None = None, only: set[str] | None = None) -> DataFrame:
    """The table as of a version (default: the last); ``only`` keeps some buckets' folders."""
    manifest = manifest_of(spark, path, version)
    folders = [f for b, own in sorted(manifest.folders.items()) if only is None or b in only for f in own]
    if not folders:
        return spark.createDataFrame([], manifest.struct())
    return spark.read.schema(manifest.struct()).parquet(*folders)


def _next(old: Manifest, batch: str) -> Manifest:
    return Manifest(old.version + 1, old.key, old.buckets, old.schema, dict(old.folders),
                    {**old.batches, batch: old.version + 1}, dict(old.marks))


def merge_batch(spark: SparkSession, path: str, batch: str, keys: DataFrame,
                apply: Callable[[DataFrame], DataFrame]) -> int:
    """Apply a change batch to the rows it can touch; returns the version that holds it.

    ``keys`` has the store's key column: the keys of the changes, new ones included. ``apply``
    maps the stored rows of their buckets to the rows that replace them.
    """
    old = manifest_of(spark, path)
    if batch in old.batches:
        return old.batches[batch]
    touched = {str(r[0]) for r in keys.select(bucket_of(old.key, old.buckets)).distinct().collect()}
    new = _next(old, batch)
    if touched:
        after = apply(read_store(spark, path, old.version, touched)).select(*old.struct().names)
        made = _write(spark, path, after, new)
        if not set(made) <= touched:
            raise ValueError("the batch returned rows outside the buckets of its keys")
        new.folders = {**{b: f for b, f in old.folders.items() if b not in touched}, **made}
    _commit(spark, path, new)
    return new.version


def append_numbered(spark: SparkSession, path: str, batch: str, rows: DataFrame,
                    number: Callable[[DataFrame, int], DataFrame], sequence: str) -> int:
    """Number a batch of new rows from the sequence's mark on and add them to the store.

    ``number(rows, start)`` gives dense numbers. The mark and the rows are committed
    together, so a replayed batch keeps the numbers it was given, and a lost writer's
    numbers are given again. New rows lie beside the bucket's others until a merge rewrites it.
    """
    old = manifest_of(spark, path)
    if batch in old.batches:
        return old.batches[batch]
    new = _next(old, batch)
    numbered = number(rows, old.marks.get(sequence, 0) + 1).select(*old.struct().names)
    made = _write(spark, path, numbered, new)
    added = spark.read.schema(old.struct()).parquet(*(f for own in made.values() for f in own)).count() if made else 0
    new.marks[sequence] = old.marks.get(sequence, 0) + added
    new.folders = {b: old.folders.get(b, []) + made.get(b, []) for b in {**old.folders, **made}}
    _commit(spark, path, new)
    return new.version


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Delete data folders that none of the last ``keep`` versions names; returns them."""
    versions = _versions(spark, path)[-keep:]
    named = {f.rsplit("/", 1)[0].rsplit("/", 1)[1] for v in versions for own in manifest_of(spark, path, v).folders.values() for f in own}
    fs, there = _fs(spark, f"{path.rstrip('/')}/data")
    gone = [s.getPath().toString() for s in fs.listStatus(there) if s.getPath().getName() not in named]
    for folder in gone:
        delete_folder(spark, folder)
    return gone
