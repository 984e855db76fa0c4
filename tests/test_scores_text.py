"""H4-H8 scores and H1, H16-H24 text functions."""

import math

from pyspark.sql import functions as F

from dialogset.functions import scores as S
from dialogset.functions import text as T


def one(spark, expr, schema, row):
    return spark.createDataFrame([row], schema).select(expr.alias("v")).first().v


def test_softmax_sigmoid(spark):
    p = one(spark, S.softmax("x"), "x array<double>", ([1.0, 2.0, 3.0],))
    e = [math.exp(v) for v in (1, 2, 3)]
    assert all(abs(a - b / sum(e)) < 1e-12 for a, b in zip(p, e))
    s = one(spark, S.sigmoid("x"), "x array<double>", ([0.0, 2.0],))
    assert s[0] == 0.5 and abs(s[1] - 1 / (1 + math.exp(-2))) < 1e-12


def test_thresholds_and_argmax(spark):
    sch = "p array<double>"
    assert one(spark, S.threshold_nhot("p", 0.5), sch, ([0.5, 0.49, 0.9],)) == [1, 0, 1]
    assert one(spark, S.threshold_class("p", 0.5), sch, ([0.5, 0.5],)) == 0
    assert one(spark, S.threshold_class("p", 0.5), sch, ([0.2, 0.8],)) == 1
    assert one(spark, S.threshold_class("p", 0.9), sch, ([0.2, 0.8],)) == 0  # nothing above -> 0
    assert one(spark, S.argmax("p"), sch, ([0.3, 0.7, 0.7],)) == 1


def test_verbalize(spark):
    names = ["c0", "c1", "c2"]
    assert one(spark, T.verbalize_label("c", "seq_coarse"), "c int", (1,)) == "positive"
    assert one(spark, T.verbalize_label("c", "seq_coarse"), "c int", (0,)) == "negative"
    assert one(spark, T.verbalize_label("v", "seq_multi", names), "v array<int>", ([0, 1, 1],)) == "c1, c2"
    got = one(spark, T.verbalize_label("v", "seq_multi_per_utterance", names), "v array<array<int>>", ([[1, 0, 0], [0, 1, 1]],))
    assert got == "c0; c1, c2"
    assert one(spark, T.verbalize_input("a", "b"), "a string, b string", ("x", "y;z")) == "Utterance: x\nContext: y;z"


def test_generated_parsing(spark):
    sch = "s string"
    assert one(spark, T.first_label("s"), sch, ("  c1 , c2",)) == "c1"
    assert one(spark, T.first_label("s", strip=False), sch, (" c1 , c2",)) == " c1 "
    assert one(spark, T.first_label("s"), sch, ("\t c3\n",)) == "c3"  # Python strip semantics
    assert one(spark, T.split_utterances("s"), sch, ("c1; c2, c3; ",)) == ["c1", "c2, c3", ""]
    assert one(spark, T.is_positive("s"), sch, (" positive\n",)) == 1
    assert one(spark, T.is_positive("s"), sch, (None,)) == 0


def test_tokens_and_truncation(spark):
    sch = "s string"
    tok = one(spark, T.tokens("s"), sch, ("Ahoj <PHOTO> svět!! <AUDIO_FILES>x",))
    assert tok == ["Ahoj", "<PHOTO>", "svět", "!", "!", "<AUDIO_FILES>", "x"]
    t = F.array(*[F.lit(str(i)) for i in range(3)])
    assert one(spark, T.keep_last(t, 5), sch, ("",)) == ["0", "1", "2"]
    assert one(spark, T.keep_last(t, 2), sch, ("",)) == ["1", "2"]
    assert one(spark, T.keep_first(t, 2), sch, ("",)) == ["0", "1"]


def test_interval_text(spark):
    got = one(spark, T.interval_text("Coarse-seq", "m", "lo", "hi", "mean"), "m string, lo double, hi double, mean double",
              ("micro", 0.25, 0.75, 0.5))
    assert got == "Coarse-seq F-scores (micro) interval: (0.25; 0.75), mean: 0.5"
