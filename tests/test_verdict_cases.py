"""NULL conversation keys, fractional sums, large class totals, strict names,
idempotent writes and unequal imported lists."""

import json
import tempfile

import pytest
from conftest import message_frame
from pyspark.sql import functions as F

from dialogset.functions.text import verbalize_label
from dialogset.operators.conversations import conversations
from dialogset.operators.metrics import roc_auc
from dialogset.operators.scan import ordered_scan
from dialogset.operators.windows import one_sided_examples, two_sided_examples
from dialogset.sources.metricstore import read_metrics, to_metrics, write_metrics
from dialogset.sources.splitfiles import legacy_counts, read_legacy_json, read_split, write_splits

NEG, POS = [1, 0, 0, 0, 0, 0], [0, 1, 0, 0, 0, 0]


def test_null_conversations_are_kept(spark):
    convs = [(1, ["one", "two", "three"], [NEG, POS, NEG]), (2, ["four", "five", "six"], [NEG, POS, NEG])]
    msgs = message_frame(spark, convs).withColumn("conv_id", F.when(F.col("conv_id") == 1, F.col("conv_id")))
    whole = message_frame(spark, convs)
    assert conversations(msgs, max_turns_per_row=100).count() == 2
    for build in (one_sided_examples, two_sided_examples):
        assert build(msgs, 10).count() == build(whole, 10).count()


def test_scan_paths_agree_on_null_keys_and_fractions(spark):
    rows = [(k, i, 0.5 * i) for k in (None, "a", "b") for i in range(4)]
    df = spark.createDataFrame(rows, "k string, i int, x double")
    key = lambda r: (str(r.k), r.i)
    paths = [
        sorted(ordered_scan(df, ["k"], [("i", True)], sums=["x"], prev=["x"], hot_group_rows=n).collect(), key=key) for n in (1000, 1)
    ]
    assert len(paths[0]) == 12
    assert [r.asDict() for r in paths[0]] == [r.asDict() for r in paths[1]]
    assert [r.x_before for r in paths[0][:4]] == [0.0, 0.0, 0.5, 1.5]


def test_auc_of_class_totals_beyond_64_bit_products(spark):
    df = spark.createDataFrame([(4_000_000_000, 0.9), (-3_999_999_999, 0.1)], "y long, score double")
    assert roc_auc(df).first().auc is not None


def test_a_set_position_without_a_name_is_an_error(spark):
    df = spark.createDataFrame([([0, 1, 0, 0, 0, 0, 1],)], "v array<int>")
    with pytest.raises(Exception, match="no class name"):
        df.select(verbalize_label(F.col("v"), "seq_multi")).collect()


def test_split_ids_stay_text_and_writes_repeat(spark):
    root = tempfile.mkdtemp(prefix="splits-")
    ds = spark.createDataFrame([("a", "train"), ("b", "test")], "text string, part string")
    for _ in range(2):
        write_splits(ds, root, "01", "t")
    write_splits(ds, root, "1", "t")
    assert sorted(r.text for r in read_split(spark, root, "01", "t").collect()) == ["a", "b"]
    m = spark.createDataFrame([("f1", "c0", 0.5)], "metric string, label string, value double")
    for _ in range(2):
        write_metrics(to_metrics(m, "7", "01", "t"), root + "-m")
    write_metrics(to_metrics(m, "7", "02", "t"), root + "-m")
    assert sorted(r.split_id for r in read_metrics(spark, root + "-m", "7").collect()) == ["01", "02"]


def test_unequal_imported_lists_fail(spark):
    d = tempfile.mkdtemp(prefix="legacy-")
    row = lambda x: ["t", x, 1, 2]
    doc = {"coarse": [row(0), row(1)], "multi": [row([1, 0])], "seq_coarse": [row([0])] * 2, "seq_multi": [row([[1, 0]])] * 2}
    with open(d + "/a.json", "w") as f:
        json.dump(doc, f)
    counts = legacy_counts(spark, d).first()
    assert (counts.n_coarse, counts.n_multi, counts.n_seq_coarse, counts.n_seq_multi) == (2, 1, 2, 2)
    with pytest.raises(Exception, match="unequal length"):
        read_legacy_json(spark, d).collect()
