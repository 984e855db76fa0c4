"""Run configs as a typed dimension table (one row per JSON document)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dialogset.schema import RUN_CONFIG


def read_run_configs(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One config per file, or one per line with ``lines``."""
    return spark.read.schema(RUN_CONFIG).option("multiLine", not lines).json(path)
