"""P5/H3 noise filter, W5/W6 dedup, A6 counts."""

import brute
import pytest
from pyspark.sql import functions as F

from dialogset.operators.quality import emoji_count, first_occurrence_dedup, is_noise, last_context_dedup

SMILE = "\U0001F600"
FLAG = "\U0001F1E8\U0001F1FF"
KEYCAP = "1️⃣"
FAMILY = "\U0001F468‍\U0001F469‍\U0001F467"
THUMB_TONE = "\U0001F44D\U0001F3FD"


def _eval(spark, col_fn, values):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    return [r[0] for r in df.select(col_fn(F.col("t"))).collect()]


def test_emoji_sequences_count_once(spark):
    texts = [SMILE, FLAG, KEYCAP, FAMILY, THUMB_TONE, "plain", SMILE + "a" + FLAG + KEYCAP + FAMILY + THUMB_TONE, "❤️"]
    assert _eval(spark, emoji_count, texts) == [1, 1, 1, 1, 1, 0, 5, 1]


def test_noise_thresholds(spark):
    ratio = 0.2
    t30 = SMILE * 7 + "a" * 23          # 30 chars: never noise
    t31 = SMILE * 7 + "a" * 24          # 31 chars, 7 > 6.2
    exact = SMILE * 7 + "a" * 28        # 35 chars, 7 == 35 * 0.2 -> not strictly more
    more = SMILE * 8 + "a" * 27         # 35 chars, 8 > 7
    got = _eval(spark, lambda c: is_noise(c, ratio), [t30, t31, exact, more])
    assert got == [False, True, False, True]


def _examples(spark, rows):
    return spark.createDataFrame(
        rows, "split string, user_id long, thread_id long, conv_id long, target_idx long, text string, context string"
    )


def test_first_occurrence_and_rejections(spark):
    noisy = SMILE * 10 + "x" * 25
    rows = [
        ("train", 1, 0, 1, 3, "hello", "c"), ("train", 1, 0, 1, 2, "hello", "c"), ("train", 1, 0, 2, 5, "hello", "c"),
        ("train", 2, 0, 1, 1, noisy, "c"), ("train", 2, 0, 1, 0, noisy, "c"), ("test", 1, 0, 1, 1, "hello", "c"),
        ("train", 1, 0, 1, 1, "bye", "c"),
    ]
    kept, rej = first_occurrence_dedup(_examples(spark, rows), 0.2)
    k = sorted((r.split, r.conv_id, r.target_idx, r.text) for r in kept.collect())
    # first in (user, thread, conv asc, target desc): conv 1 target 3; per split
    assert k == [("test", 1, 1, "hello"), ("train", 1, 1, "bye"), ("train", 1, 3, "hello")]
    r = {(x.split, x.text): (x.n_duplicate, x.n_noise, x.n_rejected) for x in rej.collect()}
    assert r == {("train", "hello"): (2, 0, 2), ("train", noisy): (0, 2, 2)}
    # same as the loop with one shared set per split
    ordered = sorted(rows, key=lambda x: (x[1], x[2], x[3], -x[4]))
    for split in ("train", "test"):
        exs = [dict(text=x[5]) for x in ordered if x[0] == split]
        ok, _ = brute.first_dedup(exs, lambda t: len(t) > 30 and t.count(SMILE) > len(t) * 0.2)
        assert sorted(e["text"] for e in ok) == sorted(x[3] for x in k if x[0] == split)


def test_last_context_dedup_keeps_aba(spark):
    rows = [
        ("s", 1, 0, 1, 9, "t", "A"), ("s", 1, 0, 1, 8, "t", "B"), ("s", 1, 0, 1, 7, "t", "A"),  # A, B, A: all kept
        ("s", 1, 0, 2, 9, "u", "A"), ("s", 1, 0, 2, 8, "u", "A"), ("s", 1, 0, 2, 7, "u", "B"),  # A, A, B: 2 kept
    ]
    got = sorted((r.text, r.target_idx) for r in last_context_dedup(_examples(spark, rows), 0.2).collect())
    assert got == [("t", 7), ("t", 8), ("t", 9), ("u", 7), ("u", 9)]
    exact = sorted((r.text, r.target_idx) for r in last_context_dedup(_examples(spark, rows), 0.2, exact=True).collect())
    assert exact == [("t", 8), ("t", 9), ("u", 7), ("u", 9)]


def test_hot_text_dedup(spark):
    """A text repeated in a large share of examples is handled in parallel."""
    rows = [("s", 1, 0, i // 7, i % 7, "ok", "ctx%d" % (i % 3)) for i in range(3000)]
    rows += [("s", 1, 0, 9999, 1, "other", "z")]
    df = _examples(spark, rows)
    kept, rej = first_occurrence_dedup(df, 0.2)
    assert sorted((r.text, r.conv_id, r.target_idx) for r in kept.collect()) == [("ok", 0, 6), ("other", 9999, 1)]
    assert rej.where("text = 'ok'").first().n_duplicate == 2999
    ordered = sorted(rows, key=lambda x: (x[1], x[2], x[3], -x[4]))
    exp = brute.last_context_dedup([dict(text=x[5], context=x[6], key=(x[3], x[4])) for x in ordered], lambda t: False)
    got = last_context_dedup(df, 0.2).collect()
    assert sorted((r.conv_id, r.target_idx) for r in got) == sorted(e["key"] for e in exp)


def test_last_context_scan_sees_narrow_rows_only(spark, monkeypatch):
    """What is pinned and exchanged for the scan holds no text and no array."""
    from pyspark.sql.types import ArrayType

    from dialogset.operators import quality, scan
    from dialogset.session import pin

    seen = []

    def recorded(df, name="pin"):
        seen.append(df.schema)
        return pin(df, name)

    monkeypatch.setattr(quality, "pin", recorded)
    monkeypatch.setattr(scan, "pin", recorded)
    rows = [("test", 1, 1, c, t, x, ctx, [x]) for c in range(3) for t, (x, ctx) in enumerate([("a", "p"), ("a", "p"), ("a", "q"), ("b", "p"), ("a", "q")])]
    df = spark.createDataFrame(rows, "split string, user_id long, thread_id long, conv_id long, target_idx long, text string, context string, utterances array<string>")
    want = None
    for limit in (None, "2"):
        if limit:
            spark.conf.set("dialogset.scan.hotGroupRows", limit)
        try:
            got = sorted((r.conv_id, r.target_idx) for r in last_context_dedup(df, 0.2).collect())
        finally:
            spark.conf.unset("dialogset.scan.hotGroupRows")
        want = want or got
        # by text "a" in order (conv ascending, target descending): q p p | q q... runs of one context keep their first
        assert got == want
    order = sorted((c, -t, x, ctx) for _, _, _, c, t, x, ctx, _ in rows)
    last, plain = {}, []
    for c, t, x, ctx in order:
        if last.get(x) != ctx:
            plain.append((c, -t))
        last[x] = ctx
    assert want == sorted(plain)
    assert len(seen) >= 3
    for schema in seen:
        assert not {"text", "context", "utterances"} & set(schema.names)
        assert not any(isinstance(f.dataType, ArrayType) for f in schema.fields)


def test_last_context_needs_a_total_order(spark):
    rows = [("test", 1, 1, 1, 5, "a", "p"), ("test", 1, 1, 1, 5, "a", "p")]
    df = spark.createDataFrame(rows, "split string, user_id long, thread_id long, conv_id long, target_idx long, text string, context string")
    with pytest.raises(Exception, match="equal order keys"):
        last_context_dedup(df, 0.2).collect()


def test_emoji_count_equals_the_plain_pattern(spark):
    """Every code point alone, in a chain and before a keycap, by both statements of the pattern."""
    from dialogset.operators.quality import EMOJI_PATTERN

    points = [c for c in range(1, 0x1FC00) if not 0xD800 <= c < 0xE000]
    texts = [[x + ",", x + "\U0001F3FD️‍" + x + "⃣", x + x] for x in map(chr, points)]
    df = spark.createDataFrame([("\n".join(t),) for t in texts], "t string").repartition(8)
    assert df.where(emoji_count("t") != F.regexp_count("t", F.lit(EMOJI_PATTERN))).count() == 0


def test_emoji_count_costs_little_on_plain_text(spark):
    """A character that is no emoji is not held against every range of the class."""
    import time

    text = F.concat(F.col("id").cast("string"), F.lit(" Some words, déjà vu, слова и 言葉." * 20))
    df = spark.range(0, 6000, 1, 1).select(text.alias("t")).localCheckpoint()

    def seconds(count):
        took = []
        for _ in range(3):
            start = time.perf_counter()
            assert df.select(F.sum(count)).first()[0] == 0
            took.append(time.perf_counter() - start)
        return min(took)

    assert seconds(emoji_count("t")) < 8 * seconds(F.regexp_count("t", F.lit("[@%|]")))
