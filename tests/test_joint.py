"""K3: the joint fit against separate fits and against Spark's own optimiser."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors

from dialogset.plans import joint
from dialogset.plans.joint import fit_joint, predict_joint


def _rows(n=150):
    rng = random.Random(8)
    out = []
    for i in range(n):
        words = [rng.choice("sun rain wind snow ice fog".split()) for _ in range(rng.randint(0, 8))]
        noisy = lambda p: int(rng.random() < p)
        multi = [noisy(0.8 if "sun" in words else 0.2), noisy(0.7 if "ice" in words or "fog" in words else 0.1), noisy(0.5)]
        out.append((i, " ".join(words), multi))
    return out + [(n, None, [1, 0, None]), (n + 1, "sun", [None, 1, 0])]


@pytest.fixture(scope="module")
def train(spark):
    return spark.createDataFrame(_rows(), "row_id long, text string, multi array<int>").repartition(3)


def _by_feature(model):
    return {f: model.weights[j] for f, j in model.used.items()}


def test_joint_fit_equals_separate_fits(spark, train, monkeypatch):
    passes, evaluate = [], joint._evaluate
    monkeypatch.setattr(joint, "_evaluate", lambda *a: passes.append(a[-1]) or evaluate(*a))
    args = dict(num_features=1 << 12, max_iter=100, tol=1e-8, reg=0.01)
    together = fit_joint(train, 3, **args)
    # all labels in one pass; the slowest label sets the number of passes
    assert len(passes) == together.passes and passes[0] == [0, 1, 2]
    alone = []
    for j in range(3):
        passes.clear()
        one = fit_joint(train.selectExpr("text", f"array(multi[{j}]) as multi"), 1, **args)
        alone.append(len(passes))
        assert one.intercepts[0] == pytest.approx(together.intercepts[j], abs=1e-6)
        for f, w in _by_feature(one).items():
            assert w[0] == pytest.approx(_by_feature(together)[f][j], abs=1e-6)
    assert together.passes < 0.7 * sum(alone)


def test_joint_fit_equals_spark_ml(spark, train):
    """The same features and penalty in Spark's optimiser, label by label."""
    model = fit_joint(train, 2, num_features=1 << 12, max_iter=200, tol=1e-10, reg=0.05)
    rows = train.select(joint.token_features("text", 1 << 12).alias("ids"), "multi").collect()
    for j in range(2):
        data = []
        for r in rows:
            if r.multi[j] is not None:
                place, tf = np.unique([model.used[f] for f in r.ids], return_counts=True)
                data.append((float(r.multi[j]), Vectors.sparse(len(model.used), place.astype(int).tolist(), (tf * model.idf[place.astype(int)]).tolist())))
        fitted = LogisticRegression(regParam=0.05, standardization=False, maxIter=500, tol=1e-12).fit(spark.createDataFrame(data, ["label", "features"]))
        assert np.allclose(fitted.coefficients.toArray(), model.weights[:, j], atol=1e-4)
        assert fitted.intercept == pytest.approx(model.intercepts[j], abs=1e-4)


def test_joint_predictions(spark, train):
    model = fit_joint(train, 3, num_features=1 << 12, max_iter=50)
    got = {r.row_id: r.probs for r in predict_joint(model, train, ["row_id"]).collect()}
    assert len(got) == 152 and all(len(p) == 3 and all(0 < x < 1 for x in p) for p in got.values())
    sunny, icy = (np.mean([got[i][j] for i, t, _ in _rows() if t and w in t]) for j, w in ((0, "sun"), (1, "ice")))
    assert sunny > 0.65 and icy > 0.5
    assert predict_joint(model, train.where("false"), ["row_id"]).collect() == []
    unheard = spark.createDataFrame([(1, "zzz"), (2, None)], "row_id long, text string")
    a, b = (r.probs for r in predict_joint(model, unheard, ["row_id"]).collect())
    assert a == b


def test_quadratic_is_solved():
    """L-BFGS alone: an ill-conditioned bowl."""
    scale = np.array([1.0, 10.0, 1000.0])
    goal = np.array([3.0, -2.0, 0.5])
    search = joint.lbfgs(3, 200, 1e-10)
    x = next(search)
    try:
        while True:
            x = search.send((0.5 * float(scale @ (x - goal) ** 2), scale * (x - goal)))
    except StopIteration as done:
        assert np.allclose(done.value, goal, atol=1e-9)


def test_binary_classifier_equals_a_plain_fit(spark):
    """K2 on noisy rows: the weighted logistic loss of the same features, minimised in numpy."""
    from dialogset.plans.models import class_weighted, predict_binary, train_binary

    rng = random.Random(3)
    rows = []
    for i in range(300):
        words = [rng.choice("sun rain wind snow ice fog".split()) for _ in range(1 + rng.randint(0, 5))]
        rows.append((i, " ".join(words), int(rng.random() < (0.6 if "ice" in words else 0.1))))
    df = spark.createDataFrame(rows, "row_id long, text string, label int")
    model = train_binary(df, num_features=1 << 8, max_iter=200)
    held = model.transform(class_weighted(df)).select("_feat", "label", "weight").collect()
    x = np.array([np.append(r._feat.toArray(), 1.0) for r in held])
    used = x.any(0)
    x, y, w = x[:, used], np.array([r.label for r in held]), np.array([r.weight for r in held])
    search = joint.lbfgs(x.shape[1], 500, 1e-9)
    at = next(search)
    try:
        while True:
            z = x @ at
            g = w * (1 / (1 + np.exp(-z)) - y) / w.sum()
            at = search.send((float(w @ (np.logaddexp(0, z) - y * z) / w.sum()), x.T @ g))
    except StopIteration as done:
        beta = done.value
    got = {r.row_id: r.probs[1] for r in predict_binary(model, df, ["row_id"]).collect()}
    feats = {r.row_id: np.append(r._feat.toArray(), 1.0)[used] for r in model.transform(df).select("row_id", "_feat").collect()}
    for i, f in feats.items():
        assert got[i] == pytest.approx(1 / (1 + np.exp(-f @ beta)), abs=2e-3)


def test_passes_read_weights_not_tokens(spark, train, monkeypatch):
    """Tokens are counted and looked up once, before the passes."""
    seen, evaluate = [], joint._evaluate
    monkeypatch.setattr(joint, "_evaluate", lambda *a: seen.append(a[0]) or evaluate(*a))
    model = fit_joint(train, 3, num_features=1 << 12, max_iter=5)
    assert all(rows is seen[0] for rows in seen) and seen[0].columns == ["y", "place", "value"]
    got = sorted((tuple(r.y), tuple(np.frombuffer(r.place, np.int32)), tuple(np.frombuffer(r.value, float))) for r in seen[0].na.fill(0).collect() if None not in r.y)
    want = []
    for r in train.select(joint.token_features("text", 1 << 12).alias("ids"), "multi").collect():
        if None not in r.multi:
            place, tf = np.unique([model.used[f] for f in r.ids], return_counts=True)
            place = place.astype(int)
            want.append((tuple(map(float, r.multi)), tuple(place), tuple(tf * model.idf[place])))
    assert got == sorted(want)


def test_scored_rows_are_dealt_out_after_numbering(spark, monkeypatch):
    """Numbering ends in one task below the hot-group limit; the model must not run in it."""
    from dialogset.plans import training

    class Seen(Exception):
        pass

    def predict(model, df, keep):
        raise Seen(df._jdf.queryExecution().analyzed().toString())

    rows = spark.range(0, 40, 1, 4).selectExpr("'t' || id as text", "cast(id % 2 as int) as label")
    monkeypatch.setattr(training, "read_split_labels", lambda *a: rows)
    monkeypatch.setattr(training, "train_binary", lambda *a, **k: None)
    monkeypatch.setattr(training, "predict_binary", predict)
    with pytest.raises(Seen) as seen:
        training.train_score_report(spark, "", "1", "t", "", "run")
    assert seen.value.args[0].startswith("RepartitionByExpression [row_id")
