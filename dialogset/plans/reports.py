"""Evaluation reports (K4-K7) as long-format ``metric, label, value`` rows.

A report scans its predictions once: it counts the rows of every (truth,
prediction) cell and pins that small table, from which the scores, matrices
and intervals follow by weight. K4's ROC AUC needs the scores themselves, so
its cells are also told apart by score. ``ci_mode="rows"`` ranks rows instead
of drawing cell counts and reads them again. Write a report with
``sources.metricstore`` (S9)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogset.functions import labels as L
from dialogset.functions import scores as S
from dialogset.functions import text as T
from dialogset.operators import metrics as M
from dialogset.operators.align import aligned_batches, dense_rows, lookup_ids
from dialogset.operators.intervals import cell_interval, subsample_interval
from dialogset.operators.splits import label_ids, row_numbers
from dialogset.session import pin


def _rows(df: DataFrame, metric: str, value: str, label=None) -> DataFrame:
    lab = F.lit(None).cast("string") if label is None else F.col(label).cast("string")
    return df.select(F.lit(metric).alias("metric"), lab.alias("label"), F.col(value).cast("double").alias("value"))


def _interval_rows(ci: DataFrame) -> DataFrame:
    """``average, lower, upper, mean`` -> rows ``ci_lower/ci_upper/ci_mean`` (one pass)."""
    parts = F.array(*[F.struct(F.lit(f"ci_{p}").alias("metric"), F.col(p).cast("double").alias("value"))
                      for p in ("lower", "upper", "mean")])
    return ci.select(F.col("average").alias("label"), F.explode(parts).alias("x")).select("x.metric", "label", "x.value")


def _interval(cells: DataFrame, rows: DataFrame, row_id: str, mode: str, **kw) -> DataFrame:
    """A17 of ``true, pred``: from the cell table (``n`` rows a cell), or from ``rows``."""
    if mode == "cells":
        return _interval_rows(cell_interval(cells, **kw))
    return _interval_rows(subsample_interval(rows, "true", "pred", row_id, mode=mode, **kw))


def _matrix_rows(cells: DataFrame, metric: str) -> DataFrame:
    cfm = M.confusion_matrix(cells, weight="n")
    return cfm.select(F.lit(metric).alias("metric"), F.concat_ws(",", "true", "pred").alias("label"),
                      F.col("count").cast("double").alias("value"))


def binary_report(pred: DataFrame, true: str = "true", probs: str = "probs", row_id: str = "row_id",
                  threshold: float = 0.5, repeats: int = 200, ci_mode: str = "cells", seed: int = 0) -> DataFrame:
    """K4: F1 of thresholded classes (rounded to 4), confusion matrix of the
    argmax, ROC AUC of the class-1 probability, subsample interval."""
    p = pred.select(row_id, F.col(true).alias("true"), S.threshold_class(probs, threshold).alias("pred"),
                    S.argmax(probs).alias("argmax"), F.col(probs)[1].alias("score"))
    scored = pin(M.cells(p, "true", "pred", "argmax", "score"), "report-scores")
    counted = pin(scored.groupBy("true", "pred", "argmax").agg(F.sum("n").alias("n")), "report-cells")
    f1 = M.binary_metrics(counted, weight="n").select(T.round4("f1").alias("v"))
    cfm = _matrix_rows(counted.select("true", F.col("argmax").alias("pred"), "n"), "cfm")
    auc = M.roc_auc(scored, "true", "score", weight="n")
    ci = _interval(counted, p, row_id, ci_mode, repeats=repeats, seed=seed)
    return _rows(f1, "test_f1", "v").unionByName(cfm).unionByName(_rows(auc, "auc", "auc")).unionByName(ci)


def multilabel_report(pred: DataFrame, true: str = "true", probs: str = "probs", coarse_true: str = "coarse",
                      row_id: str = "row_id", threshold: float = 0.5, repeats: int = 50, ci_mode: str = "cells",
                      seed: int = 0) -> DataFrame:
    """K5: multi->multi (F1 x3 rounded, weighted hard AUC, interval, per-label
    2x2 matrices) and multi->coarse (H10, then binary F1, AUC, interval, matrix)."""
    p = pred.select(row_id, F.col(true).alias("true"), S.threshold_nhot(probs, threshold).alias("pred"),
                    F.col(coarse_true).alias("coarse_true"))
    cells = pin(M.cells(p, "true", "pred", "coarse_true"), "report-cells")
    counts = pin(M.multilabel_counts(cells, weight="n"), "report-counts")  # a row per label
    f1 = M.f1_averages(counts.drop("tn")).select(F.concat(F.lit("multi_f1_"), "average").alias("metric"),
                                                 F.lit(None).cast("string").alias("label"), T.round4("f1").cast("double").alias("value"))
    auc = M.roc_auc_hard_multilabel(cells, weight="n").select(F.lit("auc").alias("metric"), F.lit("m2m").alias("label"),
                                                              F.col("weighted").alias("value"))
    ci = _interval(cells, p, row_id, ci_mode, repeats=repeats, seed=seed, multilabel=True)
    mcm = counts.select("label", F.explode(F.array(*[
        F.struct(F.lit(c).alias("cell"), F.col(c).cast("double").alias("v")) for c in ("tn", "fp", "fn", "tp")
    ])).alias("x")).select(F.lit("mcm").alias("metric"), F.concat_ws(",", F.col("label").cast("string"), "x.cell").alias("label"),
                           F.col("x.v").alias("value"))
    to_coarse = (F.col("coarse_true").alias("true"), L.any_label_above_zero("pred").alias("pred"))
    c = pin(cells.select(*to_coarse, "n").groupBy("true", "pred").agg(F.sum("n").alias("n")), "report-coarse")
    c_f1 = M.binary_metrics(c, weight="n").select(F.lit("m2c_test_f1").alias("metric"), F.lit(None).cast("string").alias("label"),
                                                  T.round4("f1").cast("double").alias("value"))
    c_auc = M.roc_auc_hard(c, weight="n").select(F.lit("auc").alias("metric"), F.lit("m2c").alias("label"), F.col("auc").alias("value"))
    c_ci = _interval(c, p.select(row_id, *to_coarse), row_id, ci_mode, repeats=repeats, seed=seed)
    c_ci = c_ci.withColumn("metric", F.concat(F.lit("m2c_"), "metric"))
    out = f1
    for r in (auc, ci, mcm, c_f1, c_auc, c_ci, _matrix_rows(c, "m2c_cfm")):
        out = out.unionByName(r)
    return out


def generated_pairs(df: DataFrame, granularity: str, true: str = "true", pred: str = "pred",
                    row_id: str = "row_id", align: str = "batch", batch: int = 32) -> tuple[DataFrame, DataFrame | None]:
    """``row_id, true, pred`` from generated strings for
    ``coarse`` (0 or 1), ``fine`` (first label) or ``per_utterance`` (first
    label of each aligned pair); for the last also the pinned batches."""
    if granularity == "coarse":
        return df.select(row_id, T.is_positive(true, strip=False).alias("true"), T.is_positive(pred).alias("pred")), None
    if granularity == "fine":
        return df.select(row_id, T.first_label(true, strip=False).alias("true"), T.first_label(pred, strip=True).alias("pred")), None
    if granularity == "per_utterance":
        batches = pin(aligned_batches(df, pred, true, row_id, batch, align), "report-batches")
        pairs = batches.select("batch_id", F.posexplode("pairs").alias("pos", "z"))
        uid = F.concat_ws(":", F.col("batch_id").cast("string"), F.col("pos").cast("string"))
        return pairs.select(uid.alias(row_id), T.first_label("z.true", strip=False).alias("true"), F.col("z.pred").alias("pred")), batches
    raise ValueError(granularity)


def label_cells(cells: DataFrame, granularity: str) -> DataFrame:
    """F2 + J4/J5 on a cell table of labels: ids of the sorted label set. Per
    utterance the set comes from the truths only and unknown predictions
    become 0; for ``fine`` it is the union of both sides."""
    if granularity == "coarse":
        return cells
    vocab = cells.select(F.col("true").alias("label"))
    if granularity == "fine":
        vocab = vocab.union(cells.select(F.col("pred").alias("label")))
    ids = label_ids(vocab, "label", "label_id")
    out = lookup_ids(cells, "true", ids, "true_id")
    out = lookup_ids(out, "pred", ids, "pred_id", default=0 if granularity == "per_utterance" else None)
    return out.groupBy(F.col("true_id").alias("true"), F.col("pred_id").alias("pred")).agg(F.sum("n").alias("n"))


def generated_report(df: DataFrame, granularity: str, true: str = "true", pred: str = "pred",
                     row_id: str = "row_id", repeats: int = 200, ci_mode: str = "cells", seed: int = 0,
                     align: str = "batch", pooled: bool = False) -> DataFrame:
    """K6: F1 averages and the subsample interval of generated labels. Per
    utterance the sample size is 10 % of the *examples* (as the reference)."""
    pairs, batches = generated_pairs(df, granularity, true, pred, row_id, align)
    size = None if batches is None else F.floor(dense_rows(batches) / 10)
    cells = pin(label_cells(pin(M.cells(pairs, "true", "pred"), "report-labels"), granularity), "report-cells")
    f1 = M.f1_multiclass(cells, weight="n").select(
        F.lit("f1").alias("metric"), F.col("average").alias("label"), F.col("f1").alias("value"))
    return f1.unionByName(_interval(cells, pairs, row_id, ci_mode, repeats=repeats, seed=seed, pooled=pooled, size=size))


def cross_lingual_report(test: DataFrame, generate: Callable[[DataFrame], DataFrame], granularity: str,
                         train_tag: str, test_tag: str, **kw) -> DataFrame:
    """K7: a model trained on ``train_tag`` scored on the test part of another
    language's split. ``test`` is that part as ``read_two_sided`` gives it
    (``text, context, label``); ``generate`` adds the model's strings as
    ``generated``. Rows are numbered by their content, scored, and reported as
    in K6, keyed by both tags."""
    rows = row_numbers(test, [("text", True), ("context", True), ("label", True)])
    rep = generated_report(generate(rows), granularity, "label", "generated", "row_id", **kw)
    return rep.select(F.lit(train_tag).alias("train_tag"), F.lit(test_tag).alias("test_tag"), "*")
