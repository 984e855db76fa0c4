"""Sources/sinks (S3, S6, S7, S8, S9), scoring (K1), models (K2, K3), and the entry contract."""

import json
import os
import tempfile

import pytest
from conftest import SF0001, message_frame
from pyspark.sql import functions as F

from dialogset.plans.dataset import DatasetConfig, build_dataset
from dialogset.session import scratch_path
from dialogset.sources.configs import read_run_configs
from dialogset.sources.metricstore import read_metrics, to_metrics, write_metrics
from dialogset.sources.splitfiles import granularity_counts, read_legacy_json, read_split_labels, write_splits

Z = [1, 0, 0, 0, 0, 0]
P = [0, 1, 0, 0, 0, 0]


def _dataset(spark):
    convs = [(c, ["hi there", "fine", "bad day", "ok"], [Z, P, Z, P], 2000 + c % 4) for c in range(12)]
    msgs = message_frame(spark, convs)
    cfg = DatasetConfig(ctx=6, donors={"test": [2000, 2001], "train": [2002, 2003]})
    return build_dataset(msgs, cfg)


def test_split_round_trip(spark):
    ds, rej = _dataset(spark)
    root = scratch_path(spark, "t-splits")
    write_splits(ds, root, "1", "tag")
    parts = {r.part: r["count"] for r in spark.read.parquet(root).groupBy("part").count().collect()}
    assert set(parts) <= {"train", "dev", "test"} and sum(parts.values()) == ds.count()
    test = read_split_labels(spark, root, "1", "tag", "test", "multi")
    assert test.columns == ["text", "label"] and test.count() == parts.get("test", 0)
    c = granularity_counts(spark.read.parquet(root)).first()
    assert c.n_coarse == c.n_multi == c.n_seq_coarse == c.n_seq_multi
    # every text is repeated in 6 conversations per split: all but one per split are rejected
    assert rej.agg(F.sum("n_duplicate")).first()[0] > 0


def test_legacy_json_import(spark):
    doc = {
        "coarse": [["a;b", 1, 7, 70], ["c", 0, 7, 71]],
        "multi": [["a;b", [0, 1, 0, 0, 0, 0], 7, 70], ["c", [1, 0, 0, 0, 0, 0], 7, 71]],
        "seq_coarse": [["a;b", [0, 1], 7, 70], ["c", [0], 7, 71]],
        "seq_multi": [["a;b", [[1, 0, 0, 0, 0, 0], [0, 1, 0, 0, 0, 0]], 7, 70], ["c", [[1, 0, 0, 0, 0, 0]], 7, 71]],
    }
    d = tempfile.mkdtemp(prefix="legacy-")
    with open(os.path.join(d, "split-1_x.train"), "w") as f:
        json.dump(doc, f)
    df = read_legacy_json(spark, d).orderBy("pos").collect()
    assert [(r.text, r.coarse, r.multi, r.seq_coarse, r.conv_id) for r in df] == [
        ("a;b", 1, [0, 1, 0, 0, 0, 0], [0, 1], 70), ("c", 0, [1, 0, 0, 0, 0, 0], [0], 71)]
    assert df[0].seq_multi == [[1, 0, 0, 0, 0, 0], [0, 1, 0, 0, 0, 0]]


def test_run_configs_and_metrics(spark):
    d = tempfile.mkdtemp(prefix="cfg-")
    cfg = {"run_id": "7", "tag": "t", "dir": "o", "model_name": "m", "max_length": 256, "epochs": 2,
           "target_names": ["0", "1"], "per_device_batch": 8, "learning_rate": 1e-5, "save_total_limit": 1,
           "early_stopping_patience": 1, "logging_strategy": "epoch", "evaluation_strategy": "epoch",
           "save_strategy": "epoch", "gradient_acc": 1}
    with open(os.path.join(d, "config-7.json"), "w") as f:
        json.dump(cfg, f, indent=2)
    r = read_run_configs(spark, d).first()
    assert r.run_id == "7" and r.target_names == ["0", "1"] and r.learning_rate == 1e-5
    m = spark.createDataFrame([("f1", None, 0.5)], "metric string, label string, value double")
    root = scratch_path(spark, "t-metrics")
    write_metrics(to_metrics(m, "7", "1", "t"), root)
    back = read_metrics(spark, root, "7").first()
    assert (back.run_id, back.metric, back.value) == ("7", "f1", 0.5)


def test_scoring_and_models(spark):
    from dialogset.plans.models import predict_binary, predict_multilabel, train_binary, train_multilabel
    from dialogset.plans.scoring import char_stats_scorer, score_texts

    texts = spark.createDataFrame([(i, ("good " * (i % 5)) + ("bad" if i % 3 == 0 else "fine"), int(i % 3 == 0))
                                   for i in range(60)], "row_id long, text string, label int")
    s = score_texts(texts, char_stats_scorer, keep=["row_id"]).collect()
    assert len(s) == 60 and all(len(r.logits) == 2 for r in s)
    model = train_binary(texts, num_features=1 << 10, max_iter=10)
    p = predict_binary(model, texts, ["row_id", "label"]).collect()
    assert len(p) == 60 and all(abs(sum(r.probs) - 1) < 1e-9 for r in p)
    ml = texts.withColumn("multi", F.array(F.col("label"), 1 - F.col("label")))
    heads = train_multilabel(ml, 2, num_features=1 << 10, max_iter=5)
    q = predict_multilabel(heads, ml, ["row_id"]).collect()
    assert len(q) == 60 and all(len(r.probs) == 2 for r in q)


def test_entry_contract(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[:2] == ["split", "part"]
    q, sql = E.queries(), E.oracle_sql()
    from dialogset.plans.registry import QUERIES

    assert set(QUERIES) <= set(q) and set(sql) <= set(q)
    # the training-data operators, where installed, add keys of their own
    assert set(QUERIES) - set(sql) == {"k2_binary_classifier", "k2_train_score_report", "k3_multilabel_classifier"}


@pytest.mark.parametrize("name", ["w4a_one_sided_lines", "w4b_two_sided", "w10_build_dataset", "a17_subsample_ci",
                                  "k6_generated_per_utterance", "j7_align_batch", "a21_bleu"])
def test_oracle_match_sf0001(spark, name):
    """The registered query equals its DuckDB oracle on the smallest tables."""
    import __spark_entry__ as E
    from checks.compare import duck, rows_of

    df = E.queries()[name](spark, SF0001)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = duck(SF0001).execute(E.oracle_sql()[name])
    exp = rows_of([d[0] for d in res.description], res.fetchall())
    assert got == exp


def test_generate_splits(spark):
    from dialogset.plans.dataset import generate_splits

    convs = [(c, ["hi there", "fine", "bad day", "ok"], [Z, P, Z, P], 2000 + c % 4) for c in range(8)]
    root = scratch_path(spark, "t-gen")
    rej = generate_splits(message_frame(spark, convs), DatasetConfig(ctx=6, donors={"test": [2000, 2001], "train": [2002, 2003]}),
                          root, "2", "t")
    assert spark.read.parquet(root).count() > 0 and rej.count() > 0


def test_package_shipped_to_workers(spark):
    """Python workers can import the package even when it is not on their path."""
    from dialogset.session import ship_package

    ship_package(spark)

    def probe(batches):
        import pandas as pd

        import dialogset.operators.intervals  # noqa: F401

        for b in batches:
            yield pd.DataFrame({"ok": [True] * len(b)})

    assert spark.range(4).mapInPandas(probe, "ok boolean").where("ok").count() == 4
