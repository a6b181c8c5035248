"""Session construction and the few cluster-facing helpers every operator shares."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "decantry",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """A session tuned the way the operators expect (AQE on, UTC, no UI).

    ``shuffle_partitions`` is the *initial* partition count; AQE coalesces small
    shuffles and splits skewed ones at runtime, so on a cluster set it high
    (a few x total cores) and let AQE shrink it.
    """
    master = master or os.environ.get("DECANTRY_MASTER", "local[8]")
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.sql.parquet.filterPushdown", "true")
         .config("spark.driver.memory", os.environ.get("DECANTRY_DRIVER_MEMORY", "16g")))
    if shuffle_partitions is not None:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cluster_conf(total_cores: int, largest_shuffle_bytes: int,
                 target_partition_bytes: int = 512 << 20) -> dict[str, str]:
    """Settings for a large cluster, sized from the total cores and the largest expected shuffle.

    The initial shuffle partition count is the larger of 3x the cores and the shuffle volume
    divided by the target partition size, so every partition fits executor memory without
    spilling heavily; AQE then coalesces small partitions and splits skewed ones.
    """
    parts = max(3 * total_cores, -(-largest_shuffle_bytes // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes // 2),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(target_partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(128 << 20),
        "spark.sql.autoBroadcastJoinThreshold": str(32 << 20),
        "spark.sql.session.timeZone": "UTC",
        # Streaming state (per-customer lifecycle) kept in RocksDB instead of the JVM heap.
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, reading ``spark.checkpoint.dir`` first.

    On a cluster the folder must be shared storage named by the cluster config; a
    machine-local temp folder is only created for local-mode sessions (tests, bench).
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server owns the checkpoint folder
        if configured:
            return configured
        raise RuntimeError("spark.checkpoint.dir is not set on the server session")
    current = sc.getCheckpointDir()
    if current:
        return current
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; configure a shared folder for this cluster")
    local = tempfile.mkdtemp(prefix="decantry-ckpt-", dir="/tmp")
    sc.setCheckpointDir(local)
    return local


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Spark keeps it."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (never a local one): survives executor loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def default_parallelism(spark: SparkSession) -> int:
    """Cores available to the session (falls back to the shuffle partition count)."""
    try:
        return spark.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001 - Spark Connect has no SparkContext
        return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def parts_for(spark: SparkSession, rows: int, each: int = 500_000) -> int:
    """Tasks for ``rows`` rows, at most about ``each`` a task; at least one a core."""
    return max(default_parallelism(spark), -(-rows // each))


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``decantry`` importable in Python workers (what ``--py-files`` does): zip the
    package once per session and add it with ``addPyFile``; Spark serves the file to every
    executor, so operators that run Python on workers (the fold, the stream) work whatever
    the driver's working directory or install state."""
    import zipfile

    import decantry
    if id(spark) in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(decantry.__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="decantry-pyfiles-"), "decantry.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    try:
        spark.sparkContext.addPyFile(target)
    except Exception:  # noqa: BLE001 - Spark Connect ships Python files as artifacts
        spark.addArtifacts(target, pyfile=True)
    _SHIPPED.add(id(spark))
