"""Property tests (hypothesis): random conversations against the brute-force
loops, and the invariants of the dataset build."""

import brute
from conftest import message_frame
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dialogset.operators.quality import first_occurrence_dedup
from dialogset.operators.splits import dev_test_cut
from dialogset.operators.windows import one_sided_examples, two_sided_examples

Z = [1, 0, 0, 0, 0, 0]
LABELS = st.sampled_from([Z, Z, [0, 1, 0, 0, 0, 0], [0, 0, 0, 1, 0, 1]])
TEXT = st.text(alphabet="ab", max_size=7)
CONV = st.lists(st.tuples(TEXT, LABELS), min_size=1, max_size=8)
SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def _convs(raw):
    return [(i, [t for t, _ in c], [lab for _, lab in c], 2000 + i % 3) for i, c in enumerate(raw)]


@SETTINGS
@given(st.lists(CONV, min_size=1, max_size=12), st.integers(min_value=1, max_value=12), st.booleans())
def test_windows_match_loops(spark, raw, ctx, nsp):
    convs = _convs(raw)
    df = message_frame(spark, convs)
    keyed = [((1, 0, c[0]), c[1], c[2]) for c in convs]
    got = sorted((r.conv_id, r.target_idx, r.start_idx, r.text, r.coarse, list(r.multi))
                 for r in one_sided_examples(df, ctx, no_small_pieces=nsp, chunk=5).collect())
    exp = sorted((x["key"][2], x["target_idx"], x["start_idx"], x["text"], x["coarse"], x["multi"])
                 for x in brute.one_sided(keyed, ctx, no_small_pieces=nsp))
    assert got == exp
    two = two_sided_examples(df, ctx, chunk=5).collect()
    exp2 = sorted((x["key"][2], x["target_idx"], x["start_idx"], x["end_idx"], x["context"]) for x in brute.two_sided(keyed, ctx))
    assert sorted((r.conv_id, r.target_idx, r.start_idx, r.end_idx, r.context) for r in two) == exp2
    lens = {c[0]: [len(t) for t in c[1]] for c in convs}
    for r in two:
        n = lens[r.conv_id]
        assert r.start_idx <= r.target_idx <= r.end_idx
        # dropping the outermost utterance of a side leaves fewer than ctx characters on that side
        if r.start_idx < r.target_idx:
            assert sum(n[r.start_idx + 1:r.target_idx]) < ctx
        if r.end_idx > r.target_idx:
            assert sum(n[r.target_idx + 1:r.end_idx]) < ctx
        assert (r.coarse == 0) == (r.multi[0] == 1)


@SETTINGS
@given(st.lists(CONV, min_size=2, max_size=14), st.integers(min_value=1, max_value=8))
def test_dedup_and_cut_invariants(spark, raw, ctx):
    convs = _convs(raw)
    df = message_frame(spark, convs).withColumn("split", F.when(F.col("user_id") == 2000, "test").otherwise("train"))
    keys = ["user_id", "thread_id", "conv_id", "split"]
    ex = one_sided_examples(df, ctx, keys=keys)
    kept, _ = first_occurrence_dedup(ex, 0.2)
    rows = dev_test_cut(kept).collect()
    for split in ("train", "test"):
        texts = [r.text for r in rows if r.split == split]
        assert len(texts) == len(set(texts))  # no repeated text per split
    test_rows = [r for r in rows if r.split == "test"]
    assert sum(r.part == "dev" for r in test_rows) == len(test_rows) // 4
    assert {r.part for r in test_rows} <= {"dev", "test"}
    assert all((r.coarse == 0) == all(v == 0 for v in r.seq_coarse) for r in rows)
