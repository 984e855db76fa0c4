"""J2, J4, J5, J7 alignment and lookups; A17 subsample intervals."""

import itertools

import pytest
from pyspark.sql import functions as F

from dialogset.operators.align import (
    align_sequences,
    generated_label_ids,
    lookup_ids,
    pair_by_id,
    utterance_pieces,
)
from dialogset.operators.intervals import subsample_f1_rows, subsample_interval
from dialogset.operators.splits import label_ids


def _gen(spark, rows):
    return spark.createDataFrame(rows, "row_id long, pred string, true string")


def _batch_reference(rows, batch):
    """The per-batch prefix alignment, stated directly."""
    out = []
    for off in range(0, len(rows), batch):
        chunk = rows[off:off + batch]
        pred = list(itertools.chain(*(p.split(",")[0].strip().split("; ") for _, p, _ in chunk)))
        true = list(itertools.chain(*(t.split("; ") for _, _, t in chunk)))
        n = min(len(pred), len(true))
        out.extend(zip(pred[:n], true[:n]))
    return out


def test_align_batch_and_utterance(spark):
    rows = [
        (0, "c1; c2; c3", "c1; c2"),          # longer prediction
        (1, "c4", "c4; c5; c1"),              # shorter prediction
        (2, "", "c2"),                        # empty prediction
        (3, " c9, c1; c2", "c3, c1; c2"),     # inner comma: cut before splitting
        (4, "c2; c2", "c2; c2"),
    ]
    df = _gen(spark, rows)
    preds, trues = utterance_pieces(df, "pred", "true", batch=2)
    got = align_sequences(preds, trues, mode="batch").orderBy("row_id", "pos").collect()
    assert [(r.pred, r.true) for r in got] == _batch_reference(rows, 2)
    utt = align_sequences(preds, trues, mode="utterance").collect()
    assert sorted((r.row_id, r.pos, r.pred, r.true) for r in utt) == [
        (0, 0, "c1", "c1"), (0, 1, "c2", "c2"), (1, 0, "c4", "c4"), (2, 0, "", "c2"),
        (3, 0, "c9", "c3, c1"), (4, 0, "c2", "c2"), (4, 1, "c2", "c2")]


def test_label_maps(spark):
    aligned = spark.createDataFrame([(0, 0, "c2", "c1, c3"), (1, 0, "zz", "c2")], "row_id long, pos int, pred string, true string")
    per = {r.row_id: (r.true_id, r.pred_id) for r in generated_label_ids(aligned, per_utterance=True).collect()}
    assert per == {0: (0, 1), 1: (1, 0)}  # unknown prediction 'zz' -> 0
    fine = {r.row_id: (r.true_id, r.pred_id) for r in generated_label_ids(aligned, per_utterance=False).collect()}
    assert fine == {0: (0, 1), 1: (1, 2)}  # union vocabulary: c1, c2, zz
    ids = label_ids(spark.createDataFrame([("a",)], "label string"))
    with pytest.raises(Exception):
        lookup_ids(spark.createDataFrame([("b",)], "x string"), "x", ids, "id").collect()


def test_pair_by_id_strict(spark):
    p = spark.createDataFrame([(1, 0), (2, 1)], "row_id long, pred int")
    t = spark.createDataFrame([(1, 0), (2, 0)], "row_id long, true int")
    assert pair_by_id(p, t).count() == 2
    t3 = spark.createDataFrame([(1, 0), (3, 0)], "row_id long, true int")
    with pytest.raises(Exception):
        pair_by_id(p, t3).collect()


def _scored(spark, n):
    return spark.createDataFrame([(i, i % 3, (i * 7) % 3 if i % 4 else i % 3) for i in range(n)], "row_id long, true int, pred int")


def test_subsample_rows_deterministic_and_sized(spark):
    df = _scored(spark, 120)
    a = subsample_interval(df, repeats=20, mode="rows").orderBy("average").collect()
    b = subsample_interval(df, repeats=20, mode="rows").orderBy("average").collect()
    assert a == b and {r.average for r in a} == {"weighted", "micro", "macro"}
    per = subsample_f1_rows(df, repeats=5)
    assert per.count() == 15
    assert all(0.0 <= r.f1 <= 1.0 for r in per.collect())


def test_subsample_pooled(spark):
    df = _scored(spark, 60)
    plain = subsample_f1_rows(df, repeats=4)
    pooled = subsample_f1_rows(df, repeats=4, pooled=True)
    counts = {r.average: r["count"] for r in pooled.groupBy("average").count().collect()}
    assert counts == {"weighted": 4, "micro": 8, "macro": 12}
    assert sorted(r.f1 for r in pooled.where("average = 'macro'").collect()) == sorted(r.f1 for r in plain.collect())


def test_subsample_too_few_rows(spark):
    with pytest.raises(Exception):
        subsample_interval(_scored(spark, 9), repeats=3).collect()
    with pytest.raises(ValueError):
        subsample_interval(_scored(spark, 9), repeats=3, mode="cells").collect()


def test_cells_mode_agrees_with_rows_mode(spark):
    df = _scored(spark, 3000)
    rows = {r.average: r for r in subsample_interval(df, repeats=200, mode="rows").collect()}
    cells = {r.average: r for r in subsample_interval(df, repeats=200, mode="cells").collect()}
    for a in rows:
        assert abs(rows[a].mean - cells[a].mean) < 0.02
        assert abs(rows[a].lower - cells[a].lower) < 0.05 and abs(rows[a].upper - cells[a].upper) < 0.05


def test_mode_never_depends_on_size(spark):
    with pytest.raises(ValueError):
        subsample_interval(_scored(spark, 20), repeats=2, mode="auto")
