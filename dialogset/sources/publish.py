"""Atomic publication of partitioned tables.

A writer puts its rows into a folder of its own, ``run=<id>``, below the
table's root; nobody reads it yet. Publishing writes a new manifest, which
names the run folder that holds each partition, and renames it into place: the
one step that readers see. A job killed at any time before leaves the
table as it was (its folder is never named), a rerun replaces the same
partitions, and partitions of others stay. Readers list only the folders
the manifest names, so partition filters prune before any listing.

Manifests are numbered; a publisher that finds its number taken reads the
newer manifest and tries again, so two of them never lose each other's
partitions. The rename must be atomic and refuse an existing target, as HDFS
and POSIX file systems do through Hadoop's ``FileContext``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FOLDER = "_manifest"  # hidden from Spark's own listing


class _Files:
    """The few file operations needed, through Hadoop (any store Spark reads)."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = self.path(root)
        self.fs = self.root.getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, path) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def read(self, path) -> str:
        stream = self.fs.open(path)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path, text: str) -> None:
        stream = self.fs.create(path, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def rename(self, source, target) -> bool:
        """False if ``target`` exists."""
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        kind = self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        options = self.jvm.java.lang.reflect.Array.newInstance(kind, 0)
        try:
            context.rename(source, target, options)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                return False
            raise


def _latest(files: _Files) -> tuple[int, dict[str, str]]:
    """Number and entries (partition folder -> run) of the newest manifest."""
    folder = files.path(f"{files.root}/{FOLDER}")
    numbers = [int(n.removesuffix(".json")) for n in files.names(folder) if n.endswith(".json") and n[0].isdigit()]
    if not numbers:
        return 0, {}
    return max(numbers), json.loads(files.read(files.path(f"{folder}/{max(numbers):012d}.json")))


def _partitions(files: _Files, folder: str, depth: int) -> list[str]:
    """The partition folders below a run's folder."""
    found = [""]
    for _ in range(depth):
        found = [f"{f}/{n}".lstrip("/") for f in found for n in files.names(files.path(f"{folder}/{f}" if f else folder)) if "=" in n]
    return found


def write_run(df: DataFrame, root: str, by: Sequence[str]) -> str:
    """Write ``df`` into a run folder of its own, partitioned by ``by``; returns its id."""
    run = uuid.uuid4().hex
    df.write.partitionBy(*by).parquet(f"{root}/run={run}")
    return run


def publish(spark: SparkSession, root: str, run: str, depth: int) -> None:
    """Name the partitions of ``run`` in a new manifest."""
    files = _Files(spark, root)
    mine = {p: run for p in _partitions(files, f"{root}/run={run}", depth)}
    folder = f"{root}/{FOLDER}"
    files.fs.mkdirs(files.path(folder))
    while True:
        number, entries = _latest(files)
        draft = files.path(f"{folder}/.{uuid.uuid4().hex}")
        files.write(draft, json.dumps(entries | mine, sort_keys=True))
        if files.rename(draft, files.path(f"{folder}/{number + 1:012d}.json")):
            return
        files.fs.delete(draft, False)


def write_published(df: DataFrame, root: str, by: Sequence[str]) -> None:
    """Write ``df`` partitioned by ``by`` and publish it in one step."""
    publish(df.sparkSession, root, write_run(df, root, by), len(by))


def read_published(spark: SparkSession, root: str, by: Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """The published rows, partition values as the strings they are. Without
    ``schema`` the data columns are those of the files."""
    files = _Files(spark, root)
    _, entries = _latest(files)
    paths = [f"{root}/run={run}/{p}" for p, run in sorted(entries.items())]
    if not paths:
        if schema is None:
            raise FileNotFoundError(f"nothing published under {root}")
        return spark.createDataFrame([], schema)
    reader = spark.read.option("basePath", root)
    if schema is None:
        found = reader.option("mergeSchema", "true").parquet(*paths).schema
        schema = T.StructType([f for f in found.fields if f.name not in (*by, "run")] + [T.StructField(c, T.StringType()) for c in by])
    return reader.schema(schema).parquet(*paths).select(*schema.names)


def remove_unpublished(spark: SparkSession, root: str) -> int:
    """Delete the run folders no partition of the newest manifest names: those
    of killed jobs and replaced ones. Run it when no writer or reader is
    active; returns how many were deleted."""
    files = _Files(spark, root)
    _, entries = _latest(files)
    gone = [n for n in files.names(files.root) if n.startswith("run=") and n.removeprefix("run=") not in set(entries.values())]
    for n in gone:
        files.fs.delete(files.path(f"{root}/{n}"), True)
    return len(gone)
