"""Label expressions A2-A5, H9-H15, H25, P6, J3."""

import pytest
from pyspark.sql import functions as F

from dialogset.functions import labels as L


def one(spark, expr, schema, row):
    return spark.createDataFrame([row], schema).select(expr.alias("v")).first().v


def test_window_labels(spark):
    sch = "labels array<array<int>>"
    allzero = [[1, 0, 0, 0, 0, 0], [1, 0, 0, 0, 0, 0]]
    mixed = [[1, 0, 0, 0, 0, 0], [0, 1, 0, 0, 0, 1], [0, 0, 1, 0, 0, 1]]
    empty_vec = [[0, 0, 0, 0, 0, 0]]  # all-zero vector: counts as positive in the window label
    assert one(spark, L.window_coarse("labels"), sch, (allzero,)) == 0
    assert one(spark, L.window_multi("labels"), sch, (allzero,)) == [1, 0, 0, 0, 0, 0]
    assert one(spark, L.window_coarse("labels"), sch, (mixed,)) == 1
    assert one(spark, L.window_multi("labels"), sch, (mixed,)) == [0, 1, 1, 0, 0, 1]
    assert one(spark, L.seq_coarse("labels"), sch, (mixed,)) == [0, 1, 1]
    assert one(spark, L.window_coarse("labels"), sch, (empty_vec,)) == 1
    assert one(spark, L.window_multi("labels"), sch, (empty_vec,)) == [0, 0, 0, 0, 0, 0]


def test_nhot_to_coarse(spark):
    sch = "l array<int>"
    assert one(spark, L.nhot_to_coarse("l"), sch, ([1, 0, 0],)) == 0
    assert one(spark, L.nhot_to_coarse("l"), sch, ([0, 0, 1],)) == 1
    assert one(spark, L.nhot_to_coarse("l", strict=False), sch, ([0, 0, 0],)) is None
    with pytest.raises(Exception):
        one(spark, L.nhot_to_coarse("l"), sch, ([0, 0, 0],))


def test_active_and_any(spark):
    sch = "l array<int>"
    assert one(spark, L.active_indices("l"), sch, ([0, 1, 0, 1],)) == [1, 3]
    assert one(spark, L.active_indices("l"), sch, ([],)) == []
    assert one(spark, L.any_label_above_zero("l"), sch, ([1, 0, 0],)) == 0
    assert one(spark, L.any_label_above_zero("l"), sch, ([1, 0, 1],)) == 1
    assert one(spark, L.to_nhot(F.array(F.lit(0), F.lit(5)), 6), sch, ([],)) == [1, 0, 0, 0, 0, 1]


@pytest.mark.parametrize(
    "l1,l2,gs,sup,expected",
    [
        (1, 2, [3, 7], False, [3]),  # gold labels win; 7 is out of range
        (0, 0, [2, 2, 1], False, [2, 2, 1]),  # gold labels as they are
        (1, 2, [7, 9], True, [0]),  # superseded without a usable gold label
        (1, 2, [7], False, [1, 2]),  # the two annotators
        (3, 3, [], False, [3]),
        (0, 4, [], False, [4]),  # the neutral one gives way
        (7, 0, [], False, [0]),  # out of range counts as neutral
        (6, 8, [], False, [0]),
        (2, 9, [], None, [2]),
    ],
)
def test_merge_gold(spark, l1, l2, gs, sup, expected):
    sch = "l1 int, l2 int, gs array<int>, sup boolean"
    got = one(spark, L.merge_gold("l1", "l2", "gs", "sup", 0, 6), sch, (l1, l2, gs, sup))
    assert got == expected


def test_two_annotators(spark):
    sch = "x int, y int"
    assert one(spark, L.two_annotators("x", "y", 0, 6), sch, (0, 7)) == [0]
    assert one(spark, L.two_annotators("x", "y", 0, 6), sch, (3, 3)) == [3]
    assert one(spark, L.two_annotators("x", "y", 0, 6), sch, (0, 3)) == [0, 3]


def test_window_certain(spark):
    sch = "a array<int>, b array<int>, d array<boolean>"
    assert one(spark, L.window_certain("a", "b", "d"), sch, ([1, 2], [1, 3], [True, False])) is False
    assert one(spark, L.window_certain("a", "b", "d"), sch, ([1, 2], [1, 3], [True, None])) is True
    # unequal lengths: cut to the shortest (the differing third position is ignored)
    assert one(spark, L.window_certain("a", "b", "d"), sch, ([1, 2, 5], [1, 2, 6], [True, True])) is True
    z = one(spark, L.zip_shortest("a", "b"), sch, ([1, 2, 5], [4], [True]))
    assert [(e.f0, e.f1) for e in z] == [(1, 4)]
