"""Published tables: what a killed job leaves, reruns, two publishers at once."""

import pytest
from pyspark.sql import functions as F

from dialogset.session import scratch_path
from dialogset.sources import metricstore, publish, splitfiles


def _dataset(spark, text, parts=("train", "dev", "test")):
    return spark.createDataFrame([(f"{text}-{p}", 1, p) for p in parts], "text string, coarse int, part string")


def _texts(spark, root, split_id="1", tag="t"):
    return sorted(r.text for r in splitfiles.read_split(spark, root, split_id, tag).collect())


def test_killed_before_publication(spark, monkeypatch):
    root = scratch_path(spark, "t-publish")
    splitfiles.write_splits(_dataset(spark, "old"), root, "1", "t")
    reader = splitfiles.read_split(spark, root, "1", "t")

    def killed(*args, **kw):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(publish, "publish", killed)
        splitfiles.write_splits(_dataset(spark, "new"), root, "1", "t")
    # rows of the killed job are there, but nobody reads them
    assert spark.read.parquet(root).count() == 6
    assert _texts(spark, root) == ["old-dev", "old-test", "old-train"]
    splitfiles.write_splits(_dataset(spark, "new"), root, "1", "t")
    splitfiles.write_splits(_dataset(spark, "new"), root, "1", "t")
    assert _texts(spark, root) == ["new-dev", "new-test", "new-train"]
    assert reader.count() == 3  # a reader of before keeps its rows
    assert publish.remove_unpublished(spark, root) == 3
    assert _texts(spark, root) == ["new-dev", "new-test", "new-train"] and spark.read.parquet(root).count() == 3


def test_killed_while_writing(spark):
    root = scratch_path(spark, "t-publish")
    splitfiles.write_splits(_dataset(spark, "old"), root, "1", "t")
    bad = _dataset(spark, "new").withColumn("text", F.when(F.col("part") == "test", F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        splitfiles.write_splits(bad, root, "1", "t")
    assert _texts(spark, root) == ["old-dev", "old-test", "old-train"]


def test_parts_are_replaced_one_by_one(spark):
    root = scratch_path(spark, "t-publish")
    splitfiles.write_splits(_dataset(spark, "a"), root, "1", "t")
    splitfiles.write_splits(_dataset(spark, "b", ("dev",)), root, "1", "t")
    splitfiles.write_splits(_dataset(spark, "c", ("dev",)), root, "01", "t/u=v")
    assert _texts(spark, root) == ["a-test", "a-train", "b-dev"]
    assert _texts(spark, root, "01", "t/u=v") == ["c-dev"]
    p = splitfiles.read_split(spark, root, "1", "t", "dev")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in p


def test_two_publishers_keep_each_other(spark, monkeypatch):
    """The second finds its number taken and starts from the newer manifest."""
    root = scratch_path(spark, "t-publish")
    splitfiles.write_splits(_dataset(spark, "a"), root, "1", "t")
    read, raced = publish._latest, []

    def late(files):
        found = read(files)
        if not raced:
            raced.append(1)
            splitfiles.write_splits(_dataset(spark, "other"), root, "2", "t")
        return found

    with monkeypatch.context() as m:
        m.setattr(publish, "_latest", late)
        splitfiles.write_splits(_dataset(spark, "mine"), root, "3", "t")
    for split_id, text in (("1", "a"), ("2", "other"), ("3", "mine")):
        assert _texts(spark, root, split_id) == [f"{text}-dev", f"{text}-test", f"{text}-train"]


def test_metrics_and_empty_roots(spark):
    root = scratch_path(spark, "t-publish")
    assert metricstore.read_metrics(spark, root).count() == 0
    with pytest.raises(FileNotFoundError):
        splitfiles.read_splits(spark, root)
    m = spark.createDataFrame([("f1", None, 0.5), ("f1", "micro", 0.25)], "metric string, label string, value double")
    for _ in range(2):
        metricstore.write_metrics(metricstore.to_metrics(m, "r", "1", "t"), root)
    assert metricstore.read_metrics(spark, root, "r").count() == 2
