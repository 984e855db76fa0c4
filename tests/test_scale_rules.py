"""Rules that must hold at every size: dedup keys, quantiles, label grids,
donor filters, the model cache and the emoji table."""

import os
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from dialogset.operators.conversations import tag_donors
from dialogset.operators.metrics import confusion_matrix, corpus_bleu, mean_interval
from dialogset.operators.quality import emoji_count, first_occurrence_dedup, last_context_dedup
from dialogset.plans.scoring import score_texts


def test_symbols_are_no_emoji(spark):
    texts = ["→★✓❶⌀", "\U0001F1E8", "1#*", "↔☀✔⭐", "a\U0001F6DC"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(emoji_count("t")).collect()] == [0, 0, 0, 4, 1]


@pytest.mark.parametrize("hot", ["1000000", "3"])
def test_mean_interval_equals_numpy(spark, hot):
    rng = np.random.default_rng(5)
    groups = {1: rng.normal(size=41), 2: np.round(rng.normal(size=80), 1), 3: np.array([2.5])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [(1, None), (4, None)]
    spark.conf.set("dialogset.scan.hotGroupRows", hot)
    try:
        got = {r["g"]: r for r in mean_interval(spark.createDataFrame(rows, "g int, v double"), "v", ["g"]).collect()}
    finally:
        spark.conf.unset("dialogset.scan.hotGroupRows")
    for g, vs in groups.items():
        want = [np.quantile(vs, 0.025), np.quantile(vs, 0.975), vs.mean()]
        assert [got[g]["lower"], got[g]["upper"], got[g]["mean"]] == pytest.approx(want)
    assert got[4][1:] == (None, None, None)


def test_confusion_matrix_refuses_too_many_classes(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(5)], "true int, pred int")
    assert confusion_matrix(df, max_classes=6).count() == 36
    with pytest.raises(Exception, match="more than 5 classes"):
        confusion_matrix(df, max_classes=5).collect()


def test_bleu_of_equal_and_empty_rows(spark):
    schema = "row_id int, reference string, hypothesis string"
    same = spark.createDataFrame([(1, "a b c d e", "a b c d e")], schema)
    assert corpus_bleu(same).first()[0] == pytest.approx(1.0)
    assert corpus_bleu(spark.createDataFrame([], schema)).first()[0] == 0.0
    assert corpus_bleu(spark.createDataFrame([(1, "a b c d", "")], schema)).first()[0] == 0.0


def test_dedup_plans_carry_no_raw_text_as_key(spark):
    cols = "split string, text string, context string, user_id long, thread_id long, conv_id long, target_idx long"
    rows = [("test", "t", c, 1, 1, 1, i) for i, c in enumerate("AABA")] + [("train", "t", "A", 1, 1, 1, 9)]
    ex = spark.createDataFrame(rows, cols)
    kept, rejected = first_occurrence_dedup(ex, 0.2)
    assert sorted((r["split"], r["target_idx"]) for r in kept.collect()) == [("test", 3), ("train", 9)]
    assert [tuple(r) for r in rejected.collect()] == [("test", "t", 3, 0, 3)]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "SortAggregate" not in plan
    assert sorted(r["target_idx"] for r in last_context_dedup(ex, 0.2).where("split = 'test'").collect()) == [1, 2, 3]
    assert sorted(r["target_idx"] for r in last_context_dedup(ex, 0.2, exact=True).where("split = 'test'").collect()) == [2, 3]


def test_donor_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "messages")
    spark.range(40).select((F.col("id") % 8).alias("user_id"), "id").write.parquet(path)
    tagged = tag_donors(spark.read.parquet(path), {"train": [1, 2], "test": [5]})
    assert tagged.count() == 15
    pushed = [x for x in tagged._jdf.queryExecution().toString().splitlines() if "PushedFilters" in x]
    assert pushed and any("In(user_id" in x for x in pushed)


def test_a_worker_builds_its_model_once(spark, tmp_path):
    folder = str(tmp_path)

    def factory():
        with open(os.path.join(folder, f"{os.getpid()}-{uuid.uuid4().hex}"), "w"):
            pass
        return lambda texts: np.ones((len(texts), 1))

    df = spark.range(64).select(F.col("id").cast("string").alias("text")).repartition(32)
    assert score_texts(df, factory).count() == 64
    score_texts(df, factory, model_name=folder).write.format("noop").mode("overwrite").save()
    before = len(os.listdir(folder))
    score_texts(df, factory, model_name=folder).write.format("noop").mode("overwrite").save()
    built = os.listdir(folder)
    pids = {name.split("-")[0] for name in built}
    assert len(built) < 32 and len(built) - before <= len(pids)
