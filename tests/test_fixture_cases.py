"""Hand-written cases of FIXTURES.md part C not covered elsewhere."""

import brute
from conftest import message_frame

from dialogset.functions import labels as L
from dialogset.operators.conversations import conversations, tag_donors
from dialogset.operators.windows import one_sided_examples, utterance_positions
from dialogset.sources.messages import load_messages, quarantine_null_text

Z = [1, 0, 0, 0, 0, 0]
P = [0, 0, 1, 0, 0, 0]


def test_null_flag_and_null_text(spark):
    raw = spark.createDataFrame(
        [(1, 0, 5, 1, "a", "x", "X", [1, 0, 0, 0, 0, 0], True),
         (1, 0, 5, 2, "b", None, None, [1, 0, 0, 0, 0, 0], True),
         (1, 0, 5, 3, "a", "z", "Z", [1, 0, 0, 0, 0, 0], None),
         (1, 0, 5, 4, "b", "w", "W", [1, 0, 0, 0, 0, 0], False)],
        "user_id long, thread_id long, conv_id long, line_num long, author string, line_text string, "
        "line_text_en string, gold_nhot array<int>, is_annotated_tagset_0 boolean",
    )
    msgs = load_messages(raw)
    assert sorted(r.line_num for r in msgs.collect()) == [1, 2]  # NULL and FALSE flags dropped
    good, bad = quarantine_null_text(msgs)
    assert [r.line_num for r in bad.collect()] == [2] and [r.line_num for r in good.collect()] == [1]
    en = load_messages(raw, text_col="line_text_en")
    assert sorted(r.text for r in en.where("text IS NOT NULL").collect()) == ["X"]


def test_conversation_arrays_are_ordered_and_chunked(spark):
    convs = [(1, ["c", "a", "b", "d", "e"], [Z] * 5)]
    msgs = message_frame(spark, convs)
    rows = conversations(msgs, utterance_positions(msgs), max_turns_per_row=2).orderBy("part_no").collect()
    assert [r.texts for r in rows] == [["c", "a"], ["b", "d"], ["e"]]
    assert all(r.n_turns == 5 for r in rows)


def test_donor_split_drops_unlisted(spark):
    msgs = message_frame(spark, [(1, ["a", "b"], [Z, Z], 7), (2, ["a"], [Z], 8), (3, ["a"], [Z], 9)])
    got = {(r.conv_id, r.split) for r in tag_donors(msgs, {"test": [7], "train": [8]}).collect()}
    assert got == {(1, "test"), (2, "train")}


def test_no_small_pieces_cases(spark):
    convs = [
        (1, ["aa", "bb", "cc", "dd"], [Z, Z, Z, P]),   # positive only at the last target
        (2, ["aa", "bb", "cc", "dd"], [Z, Z, Z, Z]),   # no positive at all
        (3, ["aa", "bb", "cc", "dd"], [P, Z, Z, Z]),   # positive at the start
        (4, ["aaaaaaaa", "b", "c", "d"], [Z, Z, P, Z]),  # long first utterance
    ]
    df = message_frame(spark, convs)
    for ctx in (1, 3, 5, 100):
        got = sorted((r.conv_id, r.target_idx, r.start_idx) for r in one_sided_examples(df, ctx, no_small_pieces=True).collect())
        exp = sorted((x["key"][2], x["target_idx"], x["start_idx"])
                     for x in brute.one_sided([((1, 0, c[0]), c[1], c[2]) for c in convs], ctx, no_small_pieces=True))
        assert got == exp, ctx


def test_merge_gold_neither_above_min(spark):
    df = spark.createDataFrame([(-1, 0, [], False), (9, 7, [8], True), (9, 7, [8], False)],
                               "l1 int, l2 int, gs array<int>, sup boolean")
    got = [r.v for r in df.select(L.merge_gold("l1", "l2", "gs", "sup", 0, 6).alias("v")).collect()]
    assert got == [[], [0], [0]]


def test_jdbc_options_partitioned_read():
    from dialogset.sources.messages import jdbc_options

    o = jdbc_options("jdbc:postgresql://db/x", lower_bound=2000, upper_bound=3100, num_partitions=64, user="u")
    assert o["dbtable"] == "messenger" and o["partitionColumn"] == "user_id"
    assert (o["lowerBound"], o["upperBound"], o["numPartitions"], o["user"]) == ("2000", "3100", "64", "u")


def test_duplicate_line_num_fails(spark):
    import pytest

    from dialogset.schema import MESSAGES

    rows = [(1, 0, 3, 10, "a", "x", Z, True), (1, 0, 3, 10, "b", "y", Z, True), (1, 0, 4, 10, "a", "z", Z, True)]
    df = spark.createDataFrame(rows, MESSAGES)
    with pytest.raises(Exception, match="duplicate line_num"):
        one_sided_examples(df, 5).collect()
