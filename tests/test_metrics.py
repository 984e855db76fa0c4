"""A8-A16, A18, A21 against direct Python statements of the formulas."""

import math
import random
from collections import Counter

import pytest

from dialogset.operators import metrics as M


def f1_ref(t, p, average):
    labels = sorted(set(t) | set(p))
    per, sup = [], []
    tps = fps = fns = 0
    for c in labels:
        tp = sum(1 for a, b in zip(t, p) if a == c and b == c)
        fp = sum(1 for a, b in zip(t, p) if a != c and b == c)
        fn = sum(1 for a, b in zip(t, p) if a == c and b != c)
        tps, fps, fns = tps + tp, fps + fp, fns + fn
        per.append(2 * tp / (2 * tp + fp + fn) if (2 * tp + fp + fn) else 0.0)
        sup.append(tp + fn)
    if average == "micro":
        return 2 * tps / (2 * tps + fps + fns) if (2 * tps + fps + fns) else 0.0
    if average == "macro":
        return sum(per) / len(per)
    return sum(f * s for f, s in zip(per, sup)) / sum(sup) if sum(sup) else 0.0


def auc_ref(y, s):
    pos = [b for a, b in zip(y, s) if a == 1]
    neg = [b for a, b in zip(y, s) if a == 0]
    if not pos or not neg:
        return None
    return sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg) / (len(pos) * len(neg))


def frame(spark, t, p):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(t, p))], "row_id long, true int, pred int")


def test_f1_multiclass(spark):
    rnd = random.Random(3)
    t = [rnd.randint(0, 4) for _ in range(300)]
    p = [rnd.choice([x, rnd.randint(0, 5)]) for x in t]  # label 5 predicted but never true
    got = {r.average: r.f1 for r in M.f1_multiclass(frame(spark, t, p)).collect()}
    for a in ("micro", "macro", "weighted"):
        assert abs(got[a] - f1_ref(t, p, a)) < 1e-12


def test_binary_and_encoded(spark):
    t = [1, 1, 0, 0, 1, 0, 0]
    p = [1, 0, 0, 1, 1, 0, 0]
    r = M.binary_metrics(frame(spark, t, p)).first()
    assert (r.precision, r.recall) == (2 / 3, 2 / 3) and abs(r.accuracy - 5 / 7) < 1e-12 and abs(r.f1 - 2 / 3) < 1e-12
    codes = spark.createDataFrame([(1,), (11,), (10,), (0,), (11,)], "code int")
    # decoded pairs: (1,0) (1,1) (0,1) (0,0) (1,1): tp 2, fp 1, fn 1
    assert abs(M.encoded_f1(codes).first().f1 - 4 / 6) < 1e-12
    none = frame(spark, [0, 0], [0, 0])
    assert M.binary_metrics(none).first().f1 == 0.0  # zero division -> 0


def test_confusion_matrix(spark):
    t = [0, 1, 1, 2]
    p = [0, 1, 3, 1]  # 3 predicted, never true; grid includes zeros
    cm = {(r.true, r.pred): r["count"] for r in M.confusion_matrix(frame(spark, t, p)).collect()}
    assert len(cm) == 16 and cm[(1, 3)] == 1 and cm[(2, 1)] == 1 and cm[(3, 3)] == 0


def test_multilabel(spark):
    t = [[1, 0, 1], [0, 1, 0], [1, 1, 0], [0, 0, 0]]
    p = [[1, 0, 0], [0, 1, 0], [0, 1, 1], [0, 0, 0]]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(t, p))], "row_id long, true array<int>, pred array<int>")
    c = {r.label: (r.tn, r.fp, r.fn, r.tp) for r in M.multilabel_counts(df).collect()}
    assert c == {0: (2, 0, 1, 1), 1: (2, 0, 0, 2), 2: (2, 1, 1, 0)}
    f = {r.average: r.f1 for r in M.f1_multilabel(df).collect()}
    per = [2 / 3, 1.0, 0.0]
    assert abs(f["macro"] - sum(per) / 3) < 1e-12
    assert abs(f["weighted"] - (2 / 3 * 2 + 1 * 2 + 0) / 5) < 1e-12
    assert abs(f["micro"] - 6 / 9) < 1e-12
    assert M.subset_accuracy(df).first().accuracy == 0.5
    h = M.roc_auc_hard_multilabel(df).first()
    tpr, tnr = 3 / 5, 6 / 7
    assert abs(h.micro - (tpr + tnr) / 2) < 1e-12


def test_roc_auc_with_ties(spark):
    rnd = random.Random(1)
    y = [rnd.randint(0, 1) for _ in range(200)]
    s = [round(rnd.random(), 1) for _ in range(200)]  # many ties
    df = spark.createDataFrame(list(zip(y, s)), "y int, score double")
    assert abs(M.roc_auc(df).first().auc - auc_ref(y, s)) < 1e-12
    one_class = spark.createDataFrame([(1, 0.3), (1, 0.5)], "y int, score double")
    assert M.roc_auc(one_class).first().auc is None
    hard = frame(spark, [1, 1, 0, 0], [1, 0, 0, 1])
    assert M.roc_auc_hard(hard).first().auc == 0.5


def test_mean_interval(spark):
    vals = [0.1, 0.4, 0.35, 0.8, 0.55]
    df = spark.createDataFrame([(v,) for v in vals], "f1 double")
    r = M.mean_interval(df).first()
    xs = sorted(vals)

    def q(p):
        h = (len(xs) - 1) * p
        lo = math.floor(h)
        return xs[lo] + (h - lo) * (xs[min(lo + 1, len(xs) - 1)] - xs[lo])

    assert abs(r.lower - q(0.025)) < 1e-12 and abs(r.upper - q(0.975)) < 1e-12 and abs(r.mean - sum(vals) / 5) < 1e-12


def bleu_ref(refs, hyps, n_max=4):
    match, total = [0] * n_max, [0] * n_max
    r_len = h_len = 0
    for r, h in zip(refs, hyps):
        rt, ht = r.split(), h.split()
        r_len, h_len = r_len + len(rt), h_len + len(ht)
        for n in range(1, n_max + 1):
            hc = Counter(tuple(ht[i:i + n]) for i in range(len(ht) - n + 1))
            rc = Counter(tuple(rt[i:i + n]) for i in range(len(rt) - n + 1))
            match[n - 1] += sum(min(c, rc[g]) for g, c in hc.items())
            total[n - 1] += sum(hc.values())
    if min(match) == 0:
        return 0.0
    bp = 1.0 if h_len >= r_len else math.exp(1 - r_len / h_len)
    return bp * math.exp(sum(math.log(m / t) for m, t in zip(match, total)) / n_max)


def test_bleu(spark):
    refs = ["the cat sat on the mat today", "a b c d e f", "one two three four"]
    hyps = ["the cat sat on a mat today", "a b c d e", "one two three four five"]
    df = spark.createDataFrame([(str(i), r, h) for i, (r, h) in enumerate(zip(refs, hyps))], "row_id string, reference string, hypothesis string")
    assert abs(M.corpus_bleu(df).first().bleu - bleu_ref(refs, hyps)) < 1e-12
    short = spark.createDataFrame([("0", "a b c", "a b")], "row_id string, reference string, hypothesis string")
    assert M.corpus_bleu(short).first().bleu == 0.0


def test_bleu_matches_grams_inside_the_row(spark):
    """Against dictionaries of counts, with repeated, empty and null sides; the
    plan has one exchange, of sums."""
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("ab cd e f".split()) for _ in range(n))
    rows = [(text(rng.randint(0, 12)), text(rng.randint(0, 12))) for _ in range(60)] + [("a b c d e", "a b c d e"), ("", "x"), (None, "a"), ("a", None), ("the " * 5000, "the " * 4000 + "cat")]
    df = spark.createDataFrame(rows, "reference string, hypothesis string").repartition(3)
    match, total, r_len, h_len = [0] * 4, [0] * 4, 0, 0
    for r, h in rows:
        if r is None or h is None:
            continue
        r, h = r.split(), h.split()
        r_len, h_len = r_len + len(r), h_len + len(h)
        for n in range(1, 5):
            a, b = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (r, h))
            match[n - 1] += sum((a & b).values())
            total[n - 1] += sum(b.values())
    want = math.exp(min(0, 1 - r_len / h_len) + sum(math.log(m / t) for m, t in zip(match, total)) / 4)
    got = M.corpus_bleu(df)
    assert got.first().bleu == pytest.approx(want, rel=1e-12)
    p = got._jdf.queryExecution().executedPlan().toString()
    assert p.count("Exchange") - p.count("Exchange RoundRobin") == 1 and "SinglePartition" in p
    assert M.corpus_bleu(df.where("false")).first().bleu == 0.0
