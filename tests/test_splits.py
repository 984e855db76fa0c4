"""W7, W9, F2-F5, A7."""

import pytest

from dialogset.operators.splits import (
    batch_ids,
    class_ratio,
    dev_test_cut,
    label_ids,
    oversample,
    row_numbers,
    seeded_shuffle,
)


def _examples(spark, n_test, n_train=3):
    rows = [("test", 1 + i % 3, 0, i, i % 5) for i in range(n_test)] + [("train", 9, 0, i, 0) for i in range(n_train)]
    return spark.createDataFrame(rows, "split string, user_id long, thread_id long, conv_id long, target_idx long")


@pytest.mark.parametrize("n", [0, 1, 3, 4, 10, 13])
def test_dev_test_cut(spark, n):
    got = dev_test_cut(_examples(spark, n)).collect()
    test_rows = sorted([r for r in got if r.split == "test"], key=lambda r: (r.user_id, r.thread_id, r.conv_id, -r.target_idx))
    k = n // 4
    assert [r.part for r in test_rows] == ["dev"] * k + ["test"] * (n - k)
    assert all(r.part == "train" for r in got if r.split == "train")


def test_row_numbers_and_batches(spark):
    df = spark.range(100).selectExpr("id * 7 % 101 AS v")
    rn = batch_ids(row_numbers(df, [("v", True)]), 32).collect()
    ordered = sorted(rn, key=lambda r: r.v)
    assert [r.row_id for r in ordered] == list(range(100))
    assert [r.batch_id for r in ordered] == [i // 32 for i in range(100)]


def test_label_ids(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("Z",), ("é",)], "label string")
    ids = {r.label: r.label_id for r in label_ids(df).collect()}
    assert ids == {v: i for i, v in enumerate(sorted({"b", "a", "Z", "é"}))}


def _plan(labels):
    """The oversampling rule, stated directly with float arithmetic."""
    pos = sum(labels) / len(labels)
    neg = 1 - pos
    minority, label = min(pos, neg), (0 if neg <= pos else 1)
    if minority * 2 <= max(pos, neg) and minority > 0:
        return label, int((1 / minority) - 1)
    return label, 0


@pytest.mark.parametrize("n_pos,n", [(1, 3), (1, 10), (0, 5), (2, 4), (1, 7), (20, 100), (3, 9)])
def test_oversample(spark, n_pos, n):
    labels = [1] * n_pos + [0] * (n - n_pos)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(labels)], "row_id long, label int")
    got = oversample(df).collect()
    label, copies = _plan(labels)
    expected = sum(copies + 1 if v == label else 1 for v in labels)
    assert len(got) == expected
    r = class_ratio(df).first()
    assert r.pos == n_pos / n and r.neg == 1 - n_pos / n


def test_seeded_shuffle_reproducible(spark):
    df = spark.createDataFrame([(i, 0) for i in range(50)], "row_id long, copy_no int")
    a = [r.row_id for r in seeded_shuffle(df, 1).collect()]
    b = [r.row_id for r in seeded_shuffle(df, 1).collect()]
    c = [r.row_id for r in seeded_shuffle(df, 2).collect()]
    assert a == b and a != c and sorted(a) == list(range(50))
