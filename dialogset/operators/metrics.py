"""Evaluation aggregates.

Formulas follow scikit-learn's public definitions: labels of a multi-class
metric are the union of labels seen in truth or prediction; F1 is
``2tp / (2tp + fp + fn)`` with 0 for a zero denominator; ``macro`` is the
plain mean over labels, ``weighted`` the mean weighted by support (true
count), ``micro`` pools the counts. Every metric is a partial-aggregatable
``groupBy``; optional ``group`` keys compute many evaluations at once (one
per subsample repeat, per run, ...). With ``weight``, a row stands for that
many rows: ``cells`` reduces predictions to one row per (truth, prediction),
from which all metrics of counts follow without another look at the input.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogset.operators.scan import ordered_scan

AVERAGES = ("weighted", "micro", "macro")


def _ratio(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def f1_expr(tp, fp, fn) -> Column:
    tp, fp, fn = (F.col(x) if isinstance(x, str) else x for x in (tp, fp, fn))
    return _ratio(2 * tp, 2 * tp + fp + fn)


def _times(x: Column, weight: str | None) -> Column:
    return x.cast("long") if weight is None else x.cast("long") * F.col(weight)


# ---------------------------------------------------------------- counts

def cells(df: DataFrame, *columns: str, n: str = "n") -> DataFrame:
    """The distinct values of ``columns`` (truth, prediction, ...) and how many
    rows have them: one pass, combined on the map side."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias(n))


def class_counts(df: DataFrame, true: str = "true", pred: str = "pred", group: Sequence[str] = (),
                 weight: str | None = None) -> DataFrame:
    """Per (group, label): ``tp, fp, fn, support`` for single-label multi-class
    data; labels = union of truth and prediction values."""
    group = list(group)
    t, p = F.col(true), F.col(pred)
    hit, one, none = _times(t == p, weight), _times(F.lit(1), weight), F.lit(0).cast("long")
    as_true = F.struct(t.alias("label"), hit.alias("tp"), none.alias("fp"), (one - hit).alias("fn"), one.alias("support"))
    as_pred = F.struct(p.alias("label"), none.alias("tp"), (one - hit).alias("fp"), none.alias("fn"), none.alias("support"))
    ex = df.select(*group, F.explode(F.array(as_true, as_pred)).alias("e")).select(*group, "e.*")
    return ex.groupBy(*group, "label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "support")])


def multilabel_counts(df: DataFrame, true: str = "true", pred: str = "pred", group: Sequence[str] = (),
                      weight: str | None = None) -> DataFrame:
    """Per (group, position): ``tn, fp, fn, tp, support`` of n-hot vectors."""
    group = list(group)
    extra = [] if weight is None else [weight]
    z = df.select(*group, *extra, F.posexplode(F.arrays_zip(F.col(true).alias("t"), F.col(pred).alias("p"))).alias("label", "z"))
    t, p = F.col("z.t"), F.col("z.p")
    return z.groupBy(*group, "label").agg(
        F.sum(_times((t == 0) & (p == 0), weight)).alias("tn"),
        F.sum(_times((t == 0) & (p == 1), weight)).alias("fp"),
        F.sum(_times((t == 1) & (p == 0), weight)).alias("fn"),
        F.sum(_times((t == 1) & (p == 1), weight)).alias("tp"),
        F.sum(_times(t == 1, weight)).alias("support"),
    )


def f1_averages(counts: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """``group, average, f1`` rows for micro, macro and weighted."""
    group = list(group)
    per = counts.withColumn("f1", f1_expr("tp", "fp", "fn"))
    agg = per.groupBy(*group).agg(
        f1_expr(F.sum("tp"), F.sum("fp"), F.sum("fn")).alias("micro"),
        F.avg("f1").alias("macro"),
        _ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted"),
    )
    stacked = F.explode(
        F.array(*[F.struct(F.lit(a).alias("average"), F.col(a).cast("double").alias("f1")) for a in AVERAGES])
    )
    return agg.select(*group, stacked.alias("s")).select(*group, "s.average", "s.f1")


def f1_multiclass(df: DataFrame, true: str = "true", pred: str = "pred", group: Sequence[str] = (),
                  weight: str | None = None) -> DataFrame:
    return f1_averages(class_counts(df, true, pred, group, weight), group)


def f1_multilabel(df: DataFrame, true: str = "true", pred: str = "pred", group: Sequence[str] = (),
                  weight: str | None = None) -> DataFrame:
    return f1_averages(multilabel_counts(df, true, pred, group, weight).drop("tn"), group)


# ---------------------------------------------------------------- binary

def binary_counts(df: DataFrame, true: str = "true", pred: str = "pred", group: Sequence[str] = (),
                  weight: str | None = None) -> DataFrame:
    t, p = F.col(true), F.col(pred)
    return df.groupBy(*group).agg(
        F.sum(_times((t == 1) & (p == 1), weight)).alias("tp"),
        F.sum(_times((t != 1) & (p == 1), weight)).alias("fp"),
        F.sum(_times((t == 1) & (p != 1), weight)).alias("fn"),
        F.sum(_times((t != 1) & (p != 1), weight)).alias("tn"),
    )


def binary_metrics(df: DataFrame, true: str = "true", pred: str = "pred", group: Sequence[str] = (),
                   weight: str | None = None) -> DataFrame:
    """A10: accuracy and precision/recall/F1 of the positive class 1."""
    c = binary_counts(df, true, pred, group, weight)
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return c.select(
        *group,
        _ratio(F.col("tp") + F.col("tn"), n).alias("accuracy"),
        _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        _ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        f1_expr("tp", "fp", "fn").alias("f1"),
    )


def decode_pairs(code) -> tuple[Column, Column]:
    """A18 input: ``1`` -> (1, 0); ``x >= 10`` -> (x mod 10, 1); else (0, 0)."""
    x = F.col(code) if isinstance(code, str) else code
    true = F.when(x == 1, 1).when(x >= 10, x % 10).otherwise(0)
    pred = F.when(x >= 10, 1).otherwise(0)
    return true, pred


def encoded_f1(df: DataFrame, code: str = "code") -> DataFrame:
    """Binary F1 over encoded (truth, prediction) integers."""
    t, p = decode_pairs(code)
    return binary_metrics(df.select(t.alias("true"), p.alias("pred"))).select("f1")


# ---------------------------------------------------------------- matrices

def confusion_matrix(df: DataFrame, true: str = "true", pred: str = "pred", max_classes: int = 10_000,
                     weight: str | None = None) -> DataFrame:
    """``true, pred, count`` for every pair of labels seen (zeros
    included), rows = truth. The grid holds classes squared rows; more than
    ``max_classes`` labels are an error (they are no classes then), found
    before any list of them is built."""
    labels = df.select(F.col(true).alias("l")).union(df.select(F.col(pred).alias("l"))).distinct().limit(max_classes + 1)
    listed = labels.agg(F.array_sort(F.collect_list("l")).alias("ls"))
    too_many = F.raise_error(F.lit(f"more than {max_classes} classes in a confusion matrix"))
    checked = listed.select(F.when(F.size("ls") <= max_classes, F.col("ls")).otherwise(too_many).alias("ls"))
    grid = checked.select(F.explode("ls").alias(true), "ls").select(true, F.explode("ls").alias(pred))
    counts = df.groupBy(true, pred).agg(F.sum(_times(F.lit(1), weight)).alias("count"))
    return grid.join(counts, [true, pred], "left").select(true, pred, F.coalesce("count", F.lit(0)).alias("count"))


def subset_accuracy(df: DataFrame, true: str = "true", pred: str = "pred", group: Sequence[str] = ()) -> DataFrame:
    """Share of rows whose whole vector matches."""
    return df.groupBy(*group).agg(F.avg(F.when(F.col(true) == F.col(pred), 1.0).otherwise(0.0)).alias("accuracy"))


# ---------------------------------------------------------------- ROC AUC

def roc_auc(df: DataFrame, y: str = "y", score: str = "score", weight: str | None = None) -> DataFrame:
    """Area under the ROC curve from scores (ties count one half).

    Rows collapse to distinct scores first; the running count of negatives
    below each score is a distributed ordered scan. NULL when a class is
    missing."""
    g = df.groupBy(F.col(score).alias("s")).agg(
        F.sum(_times(F.col(y), weight)).alias("pos"), F.sum(_times(1 - F.col(y), weight)).alias("neg")
    )
    s = ordered_scan(g, [], [("s", True)], sums=["pos", "neg"], seq_col="_i", size_col="_n")
    contrib = F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / 2.0)
    pairs = F.first("pos_total").cast("double") * F.first("neg_total").cast("double")
    return s.agg(F.try_divide(F.sum(contrib), pairs).alias("auc"))


def _hard_auc(tp, fp, fn, tn) -> Column:
    tpr = F.try_divide(tp.cast("double"), (tp + fn).cast("double"))
    tnr = F.try_divide(tn.cast("double"), (tn + fp).cast("double"))
    return (tpr + tnr) / 2.0


def roc_auc_hard(df: DataFrame, true: str = "true", pred: str = "pred", weight: str | None = None) -> DataFrame:
    """A15 (binary): AUC of 0/1 predictions = (TPR + TNR) / 2."""
    c = binary_counts(df, true, pred, weight=weight)
    return c.select(_hard_auc(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")).alias("auc"))


def roc_auc_hard_multilabel(df: DataFrame, true: str = "true", pred: str = "pred", weight: str | None = None) -> DataFrame:
    """A15 (multi-label): ``micro`` pools all cells; ``weighted`` averages the
    per-position AUC weighted by positives (positions without positives
    weigh 0; a weighted position with no negatives makes it NULL)."""
    c = multilabel_counts(df, true, pred, weight=weight)
    per = c.withColumn("auc", _hard_auc(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")))
    return per.agg(
        _hard_auc(F.sum("tp"), F.sum("fp"), F.sum("fn"), F.sum("tn")).alias("micro"),
        (
            F.sum(F.when(F.col("support") > 0, F.col("auc") * F.col("support")))
            / F.sum(F.when(F.col("support") > 0, F.col("support")))
        ).alias("weighted"),
    )


# ---------------------------------------------------------------- summaries

def repeat_interval(df: DataFrame, value: str = "f1", group: Sequence[str] = ()) -> DataFrame:
    """A16 over the scores of repeats (as many rows a group as the caller asks
    repeats for): mean and the 2.5 % / 97.5 % quantiles with linear
    interpolation. For groups of any size use ``mean_interval``."""
    q = F.percentile(F.col(value), F.array(F.lit(0.025), F.lit(0.975)))
    return df.groupBy(*group).agg(F.avg(value).alias("mean"), q.alias("_q")).select(
        *group, F.col("_q")[0].alias("lower"), F.col("_q")[1].alias("upper"), "mean"
    )


def mean_interval(df: DataFrame, value: str = "f1", group: Sequence[str] = ()) -> DataFrame:
    """Mean and the 2.5 % / 97.5 % quantiles with linear interpolation.

    Rows collapse to distinct values with their counts; an ordered scan gives
    every value the positions it fills, and the two values around a quantile's
    position are added up by weight. No group is held by one task. NULL values
    are left out (a group of nothing else gets NULLs)."""
    group = list(group)
    counted = df.groupBy(*group, F.col(value).cast("double").alias("_v")).agg(F.count(value).alias("_w"))
    s = ordered_scan(counted, group, [("_v", True)], sums=["_w"], seq_col="_i", size_col="_k")

    def holds(position: Column) -> Column:
        return (F.col("_w_before") <= position) & (position < F.col("_w_before") + F.col("_w"))

    def quantile(q: float) -> Column:
        at = (F.col("_w_total") - 1) * F.lit(q)
        low = F.floor(at)
        part = at - low
        return F.sum(
            F.when(holds(low), F.col("_v") * (1 - part)).otherwise(F.lit(0.0))
            + F.when(holds(low + 1) & (part > 0), F.col("_v") * part).otherwise(F.lit(0.0))
        )

    n = F.sum("_w")
    out = [F.when(n > 0, x).alias(name) for name, x in (("lower", quantile(0.025)), ("upper", quantile(0.975)))]
    mean = F.try_divide(F.sum(F.when(F.col("_w") > 0, F.col("_v") * F.col("_w"))), n).alias("mean")
    return s.groupBy(*group).agg(*out, mean)


# ---------------------------------------------------------------- BLEU

def _ngrams(tok: Column, n: int, side: int) -> Column:
    idx = F.when(F.size(tok) >= n, F.sequence(F.lit(0), F.size(tok) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(idx, lambda i: F.struct(F.array_join(F.slice(tok, i + 1, n), "\u0001").alias("gram"), F.lit(side).alias("side")))


def _clipped(reference: Column, hypothesis: Column, n: int) -> Column:
    """n-grams of the hypothesis found in the reference, each at most as often
    as there: both sides sorted together, equal grams counted in one walk."""
    grams = F.array_sort(F.concat(_ngrams(reference, n, 0), _ngrams(hypothesis, n, 1)))
    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(None).cast("string").alias("gram"), zero.alias("r"), zero.alias("h"), zero.alias("match"))

    def step(acc: Column, x: Column) -> Column:
        same = x["gram"].eqNullSafe(acc["gram"])
        before = lambda c: F.when(same, acc[c]).otherwise(zero)
        done = acc["match"] + F.when(same, zero).otherwise(F.least(acc["r"], acc["h"]))
        return F.struct(x["gram"].alias("gram"), (before("r") + 1 - x["side"]).alias("r"), (before("h") + x["side"]).alias("h"), done.alias("match"))

    return F.aggregate(grams, start, step, lambda acc: acc["match"] + F.least(acc["r"], acc["h"]))


def corpus_bleu(df: DataFrame, reference: str = "reference", hypothesis: str = "hypothesis",
                row_id: str = "row_id", max_n: int = 4) -> DataFrame:
    """Corpus BLEU (Papineni et al. 2002) over white-space tokens, one
    reference per row, no smoothing: geometric mean of clipped n-gram
    precisions (n = 1..max_n) times the brevity penalty. Grams are matched
    inside their row; only the sums of the counts leave a task. Rows with a
    null side are left out (``row_id`` is not needed and may be missing)."""
    split = lambda c: F.filter(F.split(F.trim(F.col(c)), "\\s+"), lambda x: x != "")
    toks = df.select(split(reference).alias("rt"), split(hypothesis).alias("ht")).where("rt is not null and ht is not null")
    orders = range(1, max_n + 1)
    rows = toks.select(
        F.size("rt").alias("rn"), F.size("ht").alias("hn"), *[_clipped(F.col("rt"), F.col("ht"), n).alias(f"m{n}") for n in orders]
    )
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    sums = rows.agg(
        total("rn").alias("r_len"),
        total("hn").alias("h_len"),
        *[total(f"m{n}").alias(f"match{n}") for n in orders],
        *[total(F.greatest(F.col("hn") - (n - 1), F.lit(0))).alias(f"total{n}") for n in orders],
    )
    found = [F.col(f"match{n}") > 0 for n in orders]
    logs = [F.when(ok, F.log(F.col(f"match{n}") / F.col(f"total{n}"))).otherwise(F.lit(0.0)) for n, ok in zip(orders, found)]
    stats = sums.select("r_len", "h_len", reduce(lambda a, b: a + b, [ok.cast("int") for ok in found]).alias("n_pos"), reduce(lambda a, b: a + b, logs).alias("log_p"))
    bp = F.when(F.col("h_len") >= F.col("r_len"), 1.0).otherwise(F.exp(1.0 - F.col("r_len") / F.col("h_len")))
    return stats.select(
        F.when((F.col("n_pos") < max_n) | (F.col("h_len") == 0), F.lit(0.0))
        .otherwise(bp * F.exp(F.col("log_p") / max_n))
        .alias("bleu")
    )
