"""Evaluation records as a long-format table partitioned by ``run_id, split_id, tag``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogset.schema import METRICS
from dialogset.sources.publish import read_published, write_published


def to_metrics(df: DataFrame, run_id: str, split_id: str, tag: str) -> DataFrame:
    """Tag a ``metric, label, value`` frame with its run coordinates."""
    return df.select(
        F.lit(str(run_id)).alias("run_id"),
        F.lit(str(split_id)).alias("split_id"),
        F.lit(tag).alias("tag"),
        F.col("metric").cast("string"),
        F.col("label").cast("string"),
        F.col("value").cast("double"),
    )


METRIC_KEYS = ("run_id", "split_id", "tag")


def write_metrics(metrics: DataFrame, root: str) -> None:
    """Write whole reports and publish them in one step: the records of a run,
    split and tag replace those written before, so a rerun does not double
    them, and a killed run changes nothing."""
    write_published(metrics.select(*[f.name for f in METRICS.fields]), root, METRIC_KEYS)


def read_metrics(spark: SparkSession, root: str, run_id: str | None = None) -> DataFrame:
    df = read_published(spark, root, METRIC_KEYS, METRICS).select(*METRICS.names)
    return df.where(F.col("run_id") == str(run_id)) if run_id is not None else df
