"""Train, score and report in one job: S3 -> F4 -> K2 -> K4 -> S9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dialogset.operators.splits import row_numbers
from dialogset.plans.models import predict_binary, train_binary
from dialogset.plans.reports import binary_report
from dialogset.session import pin
from dialogset.sources.metricstore import read_metrics, to_metrics, write_metrics
from dialogset.sources.splitfiles import read_split_labels


def train_score_report(spark: SparkSession, splits: str, split_id: str, tag: str, metrics: str, run_id: str,
                       num_features: int = 1 << 18, max_iter: int = 50, repeats: int = 200) -> DataFrame:
    """Fit the binary classifier on the train part of a written split, score
    its test part, write the K4 report under ``metrics`` and return the
    records written. The train part is oversampled and class-weighted; the
    scores are pinned, so the model runs once for all figures."""
    train = read_split_labels(spark, splits, split_id, tag, "train")
    test = row_numbers(read_split_labels(spark, splits, split_id, tag, "test"), [("text", True), ("label", True)])
    # numbering may leave the rows in one task; scoring them is dealt out again
    test = test.repartition("row_id")
    model = train_binary(train, num_features=num_features, max_iter=max_iter)
    scored = pin(predict_binary(model, test, ["row_id", "label"]), "scores")
    report = binary_report(scored.withColumnRenamed("label", "true"), repeats=repeats)
    write_metrics(to_metrics(report, run_id, split_id, tag), metrics)
    return read_metrics(spark, metrics, run_id)
