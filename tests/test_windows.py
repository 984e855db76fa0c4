"""W1-W4 against a brute-force statement of the reference loops."""

import random

import brute
import pytest
from conftest import message_frame
from pyspark.sql import functions as F

from dialogset.operators.windows import context_bounds, one_sided_examples, two_sided_examples, utterance_positions

Z = [1, 0, 0, 0, 0, 0]
P = [0, 1, 0, 0, 1, 0]


def _one(rows):
    return sorted(
        (r.conv_id, r.target_idx, r.start_idx, r.text, r.coarse, list(r.multi), list(r.seq_coarse),
         [list(x) for x in r.seq_multi]) for r in rows
    )


def _one_brute(convs, ctx, nsp=False):
    conv_in = [((1, 0, c[0]), c[1], c[2]) for c in convs]
    return sorted(
        (x["key"][2], x["target_idx"], x["start_idx"], x["text"], x["coarse"], x["multi"], x["seq_coarse"],
         x["seq_multi"]) for x in brute.one_sided(conv_in, ctx, no_small_pieces=nsp)
    )


def _two(rows):
    return sorted(
        (r.conv_id, r.target_idx, r.start_idx, r.end_idx, r.text, r.context, r.coarse, list(r.multi),
         list(r.seq_coarse), [list(x) for x in r.seq_multi]) for r in rows
    )


def _two_brute(convs, ctx):
    conv_in = [((1, 0, c[0]), c[1], c[2]) for c in convs]
    return sorted(
        (x["key"][2], x["target_idx"], x["start_idx"], x["end_idx"], x["text"], x["context"], x["coarse"], x["multi"],
         x["seq_coarse"], x["seq_multi"]) for x in brute.two_sided(conv_in, ctx)
    )


EDGE = [
    (1, ["only one"], [P]),                       # 1-turn dialogue: no examples
    (2, ["ab", "cd"], [Z, P]),                    # 2-turn dialogue
    (3, ["", "", "abc", "", "d"], [Z, Z, P, Z, Z]),  # empty utterances
    (4, ["abcd", "ef", "gh"], [Z, Z, Z]),          # all class 0
    (5, ["aaaa", "bbbb", "cccc", "dddd"], [P, Z, Z, P]),  # budget met exactly with ctx 4/8
    (6, ["x" * 9, "y", "z" * 3, "", "w" * 4], [Z, P, Z, P, Z]),
]


@pytest.mark.parametrize("ctx", [0, 1, 3, 4, 8, 100])
def test_edge_cases_one_sided(spark, ctx):
    df = message_frame(spark, EDGE)
    for nsp in (False, True):
        got = _one(one_sided_examples(df, ctx, no_small_pieces=nsp).collect())
        assert got == _one_brute(EDGE, ctx, nsp)


@pytest.mark.parametrize("ctx", [0, 1, 4, 8, 100])
def test_edge_cases_two_sided(spark, ctx):
    df = message_frame(spark, EDGE)
    assert _two(two_sided_examples(df, ctx).collect()) == _two_brute(EDGE, ctx)


def _random_convs(seed, n_convs=30):
    rnd = random.Random(seed)
    convs = []
    for c in range(n_convs):
        n = rnd.choice([1, 2, 3, 4, 7, 12])
        texts = ["".join(rnd.choice("ab") for _ in range(rnd.choice([0, 0, 1, 2, 3, 6, 11]))) for _ in range(n)]
        labels = [Z if rnd.random() < 0.6 else rnd.choice([P, [0, 0, 1, 0, 0, 0], [0, 1, 0, 1, 0, 1]]) for _ in range(n)]
        convs.append((c, texts, labels))
    return convs


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_against_brute_force(spark, seed):
    convs = _random_convs(seed)
    df = message_frame(spark, convs)
    for ctx in (2, 5, 13):
        chunk = 3  # tiny lookup slices: utterances span several slices
        assert _one(one_sided_examples(df, ctx, no_small_pieces=True, chunk=chunk).collect()) == _one_brute(convs, ctx, True)
        assert _two(two_sided_examples(df, ctx, chunk=chunk).collect()) == _two_brute(convs, ctx)


def test_invariants(spark):
    """Window contains the target; the budget is crossed by at most one
    utterance; coarse = 0 iff every seq_coarse is 0."""
    convs = _random_convs(9)
    df = message_frame(spark, convs)
    ctx = 5
    for r in one_sided_examples(df, ctx).collect():
        assert r.start_idx <= r.target_idx
        inner = r.utterances[1:-1] if len(r.utterances) > 2 else []
        # dropping the crossing utterance leaves fewer than ctx characters
        assert sum(len(u) for u in r.utterances[1:-1]) < ctx or not inner
        assert (r.coarse == 0) == all(v == 0 for v in r.seq_coarse)


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_partition_invariance(spark, parts):
    convs = _random_convs(4)
    df = message_frame(spark, convs).repartition(parts)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        assert _one(one_sided_examples(df, 5, no_small_pieces=True).collect()) == _one_brute(convs, 5, True)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_hot_conversation_is_split(spark):
    """One conversation holding nearly all rows: positions come from several
    scan blocks and every lookup slice, and the result still matches."""
    rnd = random.Random(5)
    n = 3000
    texts = ["".join(rnd.choice("abc") for _ in range(rnd.randint(0, 9))) for _ in range(n)]
    labels = [Z if rnd.random() < 0.7 else P for _ in range(n)]
    convs = [(0, texts, labels), (1, ["a", "b"], [Z, P])]
    df = message_frame(spark, convs)
    spark.conf.set("dialogset.scan.hotGroupRows", "100")  # conversation 0 takes the block path
    pos = utterance_positions(df)
    got = {(r.conv_id, r.idx): (r.chars_before, r.pos_before) for r in pos.collect()}
    b = 0
    pb = 0
    for i, t in enumerate(texts):
        assert got[(0, i)] == (b, pb)
        b += len(t)
        pb += 0 if labels[i][0] == 1 else 1
    bounds = {r.idx: (r.start_idx, r.end_idx) for r in context_bounds(pos, 20, chunk=64).where("conv_id = 0").collect()}
    for t in (1, 17, 1500, n - 1):
        assert bounds[t][0] == brute.backward_start([len(x) for x in texts], t, 20)
        assert bounds[t][1] == brute.forward_end([len(x) for x in texts], t, 20) - 1
    got = _one(one_sided_examples(df, 20, chunk=64).collect())
    spark.conf.unset("dialogset.scan.hotGroupRows")
    assert got == _one_brute(convs, 20)


def test_scan_paths_agree(spark):
    """Window path, block path and the mixed split give the same columns."""
    from dialogset.operators import scan

    df = spark.range(3000).select((F.col("id") % 7 == 0).cast("int").alias("g"), F.col("id").alias("o"),
                                  (F.col("id") % 5).alias("v"), (F.col("id") * 3 % 11).alias("w"))
    args = dict(sums=["v"], prev=["w"], firsts=["w"])
    res = []
    for limit in (10_000, 500, 1):  # all window, mixed (group 0 hot), all block
        s = scan.ordered_scan(df, ["g"], [("o", True)], hot_group_rows=limit, **args)
        res.append(sorted(tuple(r) for r in s.select(sorted(s.columns)).collect()))
    assert res[0] == res[1] == res[2]


def test_scan_blocks_split_hot_group(spark):
    """The ordered scan spreads one hot group over several range blocks."""
    from dialogset.operators import scan
    from dialogset.session import pin

    df = spark.range(5000).select(F.lit(1).alias("g"), F.col("id").alias("o"), F.lit(1).alias("v"))
    ranged = df.repartitionByRange(8, "g", "o").withColumn("_blk", F.spark_partition_id())
    assert pin(ranged).select("_blk").distinct().count() > 1
    s = scan.ordered_scan(df, ["g"], [("o", True)], sums=["v"], blocks=8, hot_group_rows=100)
    rows = s.select("o", "seq", "v_before", "group_n").collect()
    assert all(r.seq == r.o and r.v_before == r.o and r.group_n == 5000 for r in rows)


def test_dropped_targets_never_reach_the_blocks(spark, monkeypatch):
    """W3 cuts the targets before any row is copied: with blocks of one target
    the rows are the members of kept windows, and no more."""
    from dialogset.operators import windows
    from dialogset.operators.windows import member_blocks

    monkeypatch.setattr(windows, "HALO", 1)

    convs = [(0, ["aa"] * 40, [Z] * 38 + [P, Z]), (1, ["bb"] * 30, [Z] * 30), (2, ["c" * 50] * 6, [Z] * 6)]
    df = message_frame(spark, convs)
    for limit in (None, "1"):
        if limit:
            spark.conf.set("dialogset.scan.hotGroupRows", limit)
        try:
            ex = one_sided_examples(df, 10, no_small_pieces=True).collect()
            rows = member_blocks(df, 10, no_small_pieces=True).collect()
        finally:
            spark.conf.unset("dialogset.scan.hotGroupRows")
        members = sorted((r.conv_id, r.target_idx, i) for r in ex for i in range(r.start_idx, r.target_idx + 1))
        assert sorted((r.conv_id, r.halo, r.e.idx) for r in rows) == members
        assert {(r.conv_id, r.e.idx) for r in rows if r.e.target} == {(r.conv_id, r.target_idx) for r in ex}
        assert len(members) < member_blocks(df, 10).count()


@pytest.mark.parametrize("halo", [1, 2, 7])
def test_any_block_size_gives_the_same_windows(spark, monkeypatch, halo):
    from dialogset.operators import windows

    df = message_frame(spark, EDGE)
    want = sorted(map(str, one_sided_examples(df, 7).collect())), sorted(map(str, two_sided_examples(df, 7).collect()))
    monkeypatch.setattr(windows, "HALO", halo)
    assert (sorted(map(str, one_sided_examples(df, 7).collect())), sorted(map(str, two_sided_examples(df, 7).collect()))) == want
