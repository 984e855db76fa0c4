"""Intervals at any total, run folders, exported documents, the training job."""

import hashlib
import os
from collections import Counter
from fractions import Fraction
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from dialogset.operators.intervals import draw_cells, hypergeometric, split_sample, subsample_f1_rows, subsample_interval
from dialogset.plans.training import train_score_report
from dialogset.session import pin, run_folder, scratch_path
from dialogset.sources.splitfiles import legacy_counts, read_legacy_json, write_legacy_json, write_splits


def test_split_sample_any_total():
    w = [4_000_000_000, 0, 6_000_000_000, 2]
    for k in (0, 1, 7, 1_000_000_000, sum(w)):
        got = split_sample(w, list("abcd"), np.full(5, k), 3)
        assert (got.sum(axis=0) == k).all() and (got >= 0).all() and (got <= np.array(w)[:, None]).all()


@pytest.mark.parametrize("n, held, k", [(10, 3, 4), (50, 20, 7), (100, 99, 50), (7, 7, 3), (9, 0, 4), (30, 10, 30), (400, 37, 90)])
def test_hypergeometric_quantiles_are_exact(n, held, k):
    """Against binomial coefficients, at numbers on both sides of every step."""
    p = [Fraction(comb(held, i) * comb(n - held, k - i), comb(n, k)) for i in range(k + 1)]
    below = [sum(p[: i + 1]) for i in range(k + 1)]
    u = [x for c in below for x in (float(c) - 1e-9, float(c) + 1e-9) if 0 <= x < 1]
    want = [next(i for i, c in enumerate(below) if c > x) for x in u]
    got = hypergeometric(np.full(len(u), n), held, np.full(len(u), k), np.array(u))
    assert got.tolist() == want


def test_split_sample_is_hypergeometric():
    """Shares of whole outcomes against their exact probabilities."""
    w, k, n = [3, 5, 2], 4, 20_000
    draws = Counter(map(tuple, split_sample(w, list("abc"), np.full(n, k), 5).T))
    for x in draws:
        exact = np.prod([comb(a, b) for a, b in zip(w, x)]) / comb(sum(w), k)
        assert abs(draws[x] / n - exact) < 5 * np.sqrt(exact * (1 - exact) / n)
    assert len(draws) == sum(1 for a in range(4) for b in range(5) for c in range(3) if a + b + c == k)


def test_seeded_draws_are_pinned(spark):
    """The draws of a small table, by the definition alone: hash blocks in
    order, then a block's cells in order, each by its quantile."""
    cells = [(0, 0, 30), (0, 1, 5), (1, 0, 8), (1, 1, 17), (2, 1, 1)]
    df = spark.createDataFrame(cells, "true int, pred int, n long")
    got = {}
    for r in draw_cells(df, repeats=6, fraction=0.25, seed=11).collect():
        got[r.repeat, r.true, r.pred] = r.drawn

    def quantile(total, held, k, name, repeat):
        u = int(hashlib.md5(f"11:{repeat}:{name}".encode()).hexdigest()[:13], 16) / 2**52
        c = Fraction(0)
        for i in range(k + 1):
            c += Fraction(comb(held, i) * comb(total - held, k - i), comb(total, k))
            if c > u:
                return i

    def split(parts, k, repeat):
        total, out = sum(w for _, w in parts), {}
        for name, w in parts:
            out[name] = quantile(total, w, k, name, repeat)
            total, k = total - w, k - out[name]
        return out

    named = sorted((hashlib.md5(f"{t}|{p}".encode()).hexdigest(), t, p, w) for t, p, w in cells)
    want = {}
    for repeat in range(6):
        blocks = {}
        for h, _, _, w in named:
            blocks[h[:2]] = blocks.get(h[:2], 0) + w
        shares = split(sorted(blocks.items()), 15, repeat)
        for b, k in shares.items():
            drawn = split([(h, w) for h, _, _, w in named if h[:2] == b], k, repeat)
            want |= {(repeat, t, p): drawn[h] for h, t, p, _ in named if h[:2] == b and drawn[h]}
    assert got == want and all(sum(v for (r, _, _), v in got.items() if r == i) == 15 for i in range(6))


def test_many_cells_need_no_limit(spark):
    """One cell a row: every repeat takes exactly its rows, each at most once."""
    df = spark.range(5000).select(F.col("id").alias("true"), (-F.col("id")).alias("pred"), F.lit(1).cast("long").alias("n"))
    rows = draw_cells(df, repeats=3, seed=2).groupBy("repeat").agg(F.sum("drawn").alias("k"), F.max("drawn").alias("most"), F.countDistinct("true").alias("d"))
    assert sorted(map(tuple, rows.collect())) == [(r, 500, 1, 500) for r in range(3)]


def _scored(spark, n):
    return spark.range(n).select(F.col("id").alias("row_id"), (F.col("id") % 3).alias("true"),
                                 F.when(F.col("id") % 4 == 0, (F.col("id") * 7) % 3).otherwise((F.col("id") + 1) % 3).alias("pred"))


@pytest.mark.parametrize("n, size", [(10, None), (700, None), (5000, None), (40, 40), (40, 90)])
def test_rows_mode_takes_the_smallest_hashes(spark, n, size):
    import hashlib

    df = _scored(spark, n)
    rows = [(r.row_id, r.true, r.pred) for r in df.collect()]
    k = size if size is not None else n // 10
    for r in subsample_f1_rows(df, repeats=3, seed=9, size=size).where("average = 'micro'").collect():
        rank = sorted(rows, key=lambda x: (hashlib.md5(f"9:{r.repeat}:{x[0]}".encode()).hexdigest(), x[0]))[:k]
        assert abs(r.f1 - sum(t == p for _, t, p in rank) / len(rank)) < 1e-12


def test_cells_mode_takes_a_size_column(spark):
    df = _scored(spark, 100)
    got = subsample_interval(df, mode="cells", repeats=4, size=df.select(F.floor(F.count(F.lit(1)) / 10)).scalar())
    assert got.count() == 3


def test_run_folder_is_deleted(spark):
    with run_folder(spark) as path:
        assert pin(spark.range(5)).count() == 5
        inner = scratch_path(spark, "x")
        assert inner.startswith(path)
        local = path.removeprefix("file:")
        assert os.path.isdir(local)
    assert not os.path.exists(local)
    assert not scratch_path(spark, "x").startswith(path)
    with pytest.raises(ZeroDivisionError), run_folder(spark) as path:
        pin(spark.range(5))
        1 / 0
    assert not os.path.exists(path.removeprefix("file:"))


def test_legacy_round_trip(spark):
    texts = ['plain', 'quote " and \\ back', "two\nlines", "[brackets]", "", "ünï code"]
    rows = [(1, 2, c, t, x, t % 2, [0, 1], [t, 1], [[0, 1], [1, 0]]) for c in (5, 6) for t, x in enumerate(texts)]
    ex = spark.createDataFrame(rows, "user_id long, thread_id long, conv_id long, target_idx long, text string, coarse int, "
                                     "multi array<int>, seq_coarse array<int>, seq_multi array<array<int>>")
    root = scratch_path(spark, "t-legacy")
    write_legacy_json(ex, root, ["user_id", "thread_id", "conv_id"], rows_per_document=4)
    cols = ["thread_id", "conv_id", "text", "coarse", "multi", "seq_coarse", "seq_multi"]
    back = read_legacy_json(spark, root, lines=True).select(*cols)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, ex.select(*cols).collect()))
    assert sorted(r.n_coarse for r in legacy_counts(spark, root, lines=True).collect()) == [2, 2, 4, 4]


def test_train_score_report(spark):
    """Separable texts are told apart on rows the model has not seen."""
    def rows(lo, hi, part):
        return [(f"n{i} " + ("awful night" if i % 5 == 0 else "sunny day"), int(i % 5 == 0), part) for i in range(lo, hi)]

    df = spark.createDataFrame(rows(0, 80, "train") + rows(100, 150, "test"), "text string, coarse int, part string")
    root = scratch_path(spark, "t-chain")
    write_splits(df, root, "1", "t")
    args = (spark, root, "1", "t", scratch_path(spark, "t-chain-metrics"), "r")
    got = {(r.metric, r.label): r.value for r in train_score_report(*args, num_features=1 << 10, max_iter=10, repeats=5).collect()}
    assert got["test_f1", None] > 0.95 and got["auc", None] > 0.95
    assert sum(v for (m, _), v in got.items() if m == "cfm") == 50
