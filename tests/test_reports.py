"""Reports read their predictions once; cell tables and one-exchange alignment
give the figures of the plain operators."""

import pytest
from pyspark.sql import functions as F

from dialogset.operators import metrics as M
from dialogset.operators.align import aligned_batches, align_sequences, dense_rows, utterance_pieces
from dialogset.plans import reports as R
from dialogset.session import pin


def _scored(spark, n=400):
    return spark.range(n).select(
        F.col("id").alias("row_id"), (F.col("id") % 3 == 0).cast("int").alias("true"),
        F.array(F.lit(1.0) - (F.col("id") * 37 % 101) / 101, (F.col("id") * 37 % 101) / 101).alias("probs"),
        F.array((F.col("id") % 2).cast("int"), (F.col("id") % 5 == 0).cast("int")).alias("multi"))


def _generated(spark, n=70):
    text = lambda i, m: "; ".join(["alpha, x", "beta", "gamma"][: 1 + (i * m) % 3])
    return spark.createDataFrame([(i, text(i, 1), text(i, 2 if i % 4 else 1) if i % 9 else None) for i in range(n)], "row_id long, given_t string, given_p string")


def _reports(spark):
    s, g = pin(_scored(spark), "input"), pin(_generated(spark), "input")
    yield lambda: R.binary_report(s, repeats=5)
    yield lambda: R.multilabel_report(s.select("*", F.col("true").alias("coarse")).drop("true"), "multi", repeats=5)
    yield lambda: R.generated_report(g, "coarse", "given_t", "given_p", repeats=5)
    yield lambda: R.generated_report(g.where("given_p is not null"), "fine", "given_t", "given_p", repeats=5)
    yield lambda: R.generated_report(g, "per_utterance", "given_t", "given_p", repeats=5)


@pytest.mark.parametrize("which", range(5))
def test_one_scan_of_the_predictions(spark, monkeypatch, which):
    report, plans = list(_reports(spark))[which], []

    def recorded(df, name="pin"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return pin(df, name)

    monkeypatch.setattr(R, "pin", recorded)
    monkeypatch.setattr("dialogset.operators.intervals.pin", recorded)
    out = report()
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert out.count() >= 12
    scans = [line for p in plans for line in p.split("\n") if "FileScan" in line and ("probs#" in line or "given_" in line)]
    assert len(scans) == 1


def test_weighted_metrics_equal_rows(spark):
    rows = spark.createDataFrame([(t, p, [t % 2, 1], [p % 2, t % 2]) for t in range(3) for p in range(3) for _ in range(1 + t * p)],
                                 "true int, pred int, tv array<int>, pv array<int>")
    rows = rows.unionByName(spark.createDataFrame([(None, 1, [1, 0], [0, 1])], rows.schema))
    cells, vectors = M.cells(rows, "true", "pred"), M.cells(rows, "tv", "pv")
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(M.class_counts(rows), M.class_counts(cells, weight="n"))
    assert same(M.multilabel_counts(rows, "tv", "pv"), M.multilabel_counts(vectors, "tv", "pv", weight="n"))
    assert same(M.binary_metrics(rows), M.binary_metrics(cells, weight="n"))
    known, known_cells = rows.where("`true` is not null"), cells.where("`true` is not null")
    assert same(M.confusion_matrix(known), M.confusion_matrix(known_cells, weight="n"))
    assert same(M.roc_auc(known.selectExpr("`true` % 2 as y", "pred as score")), M.roc_auc(known_cells.selectExpr("`true` % 2 as y", "pred as score", "n"), weight="n"))


@pytest.mark.parametrize("mode", ["batch", "utterance"])
def test_aligned_batches_equal_the_join(spark, mode):
    g = _generated(spark)
    a = aligned_batches(g, "given_p", "given_t", mode=mode)
    got = a.select("batch_id", F.posexplode("pairs")).select("batch_id", "pos", "col.true", "col.pred")
    want = align_sequences(*utterance_pieces(g, "given_p", "given_t"), mode=mode)
    assert sorted((r.batch_id, r.true, r.pred) for r in got.collect()) == sorted((r.batch_id, r.true, r.pred) for r in want.collect())
    assert a.select(dense_rows(a).alias("n")).first().n == 70


@pytest.mark.parametrize("ids", ["row_id + 1", "row_id * 2", "row_id div 2", "case when row_id >= 32 then row_id + 32 else row_id end", "case when row_id < 20 then row_id else row_id + 12 end"])
def test_ids_that_are_not_dense_are_an_error(spark, ids):
    with pytest.raises(Exception, match="not dense"):
        R.generated_report(_generated(spark).withColumn("row_id", F.expr(ids)), "per_utterance", "given_t", "given_p", repeats=3).collect()
