"""Opt-in stress check of the hot-conversation path (DIALOGSET_STRESS=1):
one conversation of 1,000,000 utterances, threshold lowered to 100,000 rows so
it takes the block path; spot checks against the rule definitions."""

import os

import brute
import pytest
from pyspark.sql import functions as F

from dialogset.operators.windows import one_sided_examples

pytestmark = pytest.mark.skipif(os.environ.get("DIALOGSET_STRESS") != "1", reason="set DIALOGSET_STRESS=1")


def test_one_million_utterance_conversation(spark):
    n = 1_000_000
    spark.conf.set("dialogset.scan.hotGroupRows", "100000")
    try:
        pos_label = F.array(*[F.lit(v) for v in [0, 1, 0, 0, 0, 0]])
        zero_label = F.array(*[F.lit(v) for v in [1, 0, 0, 0, 0, 0]])
        msgs = spark.range(n).select(
            F.lit(1).cast("long").alias("user_id"), F.lit(0).cast("long").alias("thread_id"),
            F.lit(7).cast("long").alias("conv_id"), (F.col("id") * 3).alias("line_num"), F.lit("a").alias("author"),
            F.expr("repeat('x', cast(id % 13 as int))").alias("text"),
            F.when(F.col("id") % 5 == 0, pos_label).otherwise(zero_label).alias("label"),
            F.lit(True).alias("is_annotated"))
        ex = one_sided_examples(msgs, 40)
        assert ex.count() == n - 1
        lens = [i % 13 for i in range(n)]
        for t in (1, 12345, 500000, n - 1):
            r = ex.where(F.col("target_idx") == t).select("start_idx", "text").first()
            s = brute.backward_start(lens, t, 40)
            assert r.start_idx == s and r.text == ";".join("x" * lens[i] for i in range(s, t + 1))
    finally:
        spark.conf.unset("dialogset.scan.hotGroupRows")
