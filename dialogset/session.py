"""Session helpers: a configured local session for tests and the
checkpoint folder used to pin intermediate results."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "dialogset") -> SparkSession:
    """Session for tests and benchmarks. On a cluster, build the session with
    the cluster's own settings and pass it in instead."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # small test inputs: keep CPU-heavy stages spread over all cores
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "16k")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        # no Python call-site capture per Column op (plan building is driver-bound at small sizes)
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder.

    A cluster names a shared folder in ``spark.checkpoint.dir``; it is used
    as is. Only a local-mode session without one (tests) gets a fresh folder
    under the system temp dir; on a cluster a missing setting is an error,
    because pinned data must live on storage every executor can read."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="dialogset-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder on shared storage (HDFS, S3, ...)")
    return sc.getCheckpointDir()


_RUN_FOLDER: ContextVar[str | None] = ContextVar("run_folder", default=None)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for a written intermediate table: below the current
    ``run_folder``, else inside the checkpoint area."""
    import uuid

    base = _RUN_FOLDER.get() or f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables"
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """One folder for everything pinned inside the block, deleted when the
    block ends (also on an error). Write the results to their own place inside
    the block: lazy frames that read pinned tables cannot be read after it."""
    path = scratch_path(spark, "run")
    token = _RUN_FOLDER.set(path)
    try:
        yield path
    finally:
        _RUN_FOLDER.reset(token)
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def pin(df: DataFrame, name: str = "pin") -> DataFrame:
    """Write ``df`` as Parquet into the reliable checkpoint folder and read it
    back, cutting its lineage.

    Used where two branches of a plan must see exactly the same rows with the
    same derived values (block ids taken from a range exchange). A lost
    executor cannot change pinned data: it is re-read from shared storage,
    never recomputed."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


_SHIPPED: set[str] = set()  # application ids: unlike object ids they are never used again


def ship_package(spark: SparkSession) -> None:
    """Make ``dialogset`` importable in Python workers (for the few
    ``mapInPandas`` steps): zip the package once per session and register it
    with ``addPyFile``, the standard way to distribute Python code with a job."""
    import os
    import zipfile

    import dialogset

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(dialogset.__file__))
    root = os.path.dirname(pkg)
    path = os.path.join(tempfile.mkdtemp(prefix="dialogset-pkg-"), "dialogset.zip")
    with zipfile.ZipFile(path, "w") as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
