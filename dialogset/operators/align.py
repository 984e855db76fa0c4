"""Pairing predictions with truths and label lookups.

Generated strings hold labels joined by ``", "`` and utterances joined by
``"; "``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialogset.functions import text as T
from dialogset.operators.splits import label_ids


def pair_by_id(pred: DataFrame, truth: DataFrame, row_id: str = "row_id", strict: bool = True) -> DataFrame:
    """Join predictions to truths on ``row_id``. With ``strict`` a row on
    either side without a partner fails the query (the reference asserts
    equal lengths); the check runs inside the same plan (full outer join)."""
    p = pred.withColumn("_has_p", F.lit(True))
    t = truth.withColumn("_has_t", F.lit(True))
    if not strict:
        return p.join(t, row_id, "inner").drop("_has_p", "_has_t")
    j = p.join(t, row_id, "full_outer")
    ok = F.when(F.col("_has_p") & F.col("_has_t"), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("prediction/truth without partner: row "), F.col(row_id).cast("string")))
    )
    return j.where(ok).drop("_has_p", "_has_t")


def lookup_ids(df: DataFrame, col: str, ids: DataFrame, out: str, default: int | None = None,
               label_col: str = "label", id_col: str = "label_id") -> DataFrame:
    """J4 (``default=None``: every label must be known, else the query fails)
    and J5 (unknown labels get ``default``). ``ids`` is the (label, id) table
    of F2; Spark broadcasts it at run time when it is small."""
    table = ids.select(F.col(label_col).alias("_lk"), F.col(id_col).alias("_lid"))
    j = df.join(table, F.col(col) == F.col("_lk"), "left")
    if default is None:
        value = F.when(F.col("_lid").isNotNull(), F.col("_lid")).otherwise(
            F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(F.col(col), F.lit("NULL")))).cast("long")
        )
    else:
        value = F.coalesce(F.col("_lid"), F.lit(default).cast("long"))
    return j.withColumn(out, value).drop("_lk", "_lid")


def class_names(idx, names: list[str]):
    """Class id -> class name."""
    return F.get(F.array(*[F.lit(n) for n in names]), F.col(idx) if isinstance(idx, str) else idx)


def utterance_pieces(df: DataFrame, pred: str, true: str, row_id: str = "row_id", batch: int = 32,
                     cut_first_label: bool = True) -> tuple[DataFrame, DataFrame]:
    """H18 + H19 (+W9): explode predicted and true sequences into
    ``(batch_id, row_id, pos, piece)`` rows. Like the reference, the whole
    generated string is cut at its first comma and stripped *before* it is
    split into utterances."""
    p = T.first_label(pred, strip=True) if cut_first_label else F.col(pred)
    base = df.withColumn("batch_id", F.floor(F.col(row_id) / batch))
    preds = base.select("batch_id", row_id, F.posexplode(T.split_utterances(p)).alias("pos", "piece"))
    trues = base.select("batch_id", row_id, F.posexplode(T.split_utterances(F.col(true))).alias("pos", "piece"))
    return preds, trues


def align_sequences(preds: DataFrame, trues: DataFrame, row_id: str = "row_id", mode: str = "batch") -> DataFrame:
    """Pair predicted and true utterance labels.

    ``batch``: the reference's behaviour: within a batch the pieces are
    concatenated in (row, position) order and paired by position, keeping the
    common prefix (one short prediction shifts the rest of its batch).
    ``utterance``: pair on (row, position). Output: ``batch_id, row_id, pos,
    pred, true`` (row/pos of the truth)."""
    if mode == "utterance":
        return trues.withColumnRenamed("piece", "true").join(
            preds.select(row_id, "pos", F.col("piece").alias("pred")), [row_id, "pos"]
        ).select("batch_id", row_id, "pos", "pred", "true")
    if mode != "batch":
        raise ValueError(mode)
    w = Window.partitionBy("batch_id").orderBy(row_id, "pos")  # a batch holds a fixed number of rows
    p = preds.withColumn("k", F.row_number().over(w)).select("batch_id", "k", F.col("piece").alias("pred"))
    t = trues.withColumn("k", F.row_number().over(w)).select("batch_id", "k", row_id, "pos", F.col("piece").alias("true"))
    return t.join(p, ["batch_id", "k"]).select("batch_id", row_id, "pos", "pred", "true")


def aligned_batches(df: DataFrame, pred: str, true: str, row_id: str = "row_id", batch: int = 32,
                    mode: str = "batch", cut_first_label: bool = True) -> DataFrame:
    """J7 in one exchange: ``batch_id, n_rows, first, pairs`` with the pairs of
    pieces (``true, pred``) of a batch of rows, as ``align_sequences`` pairs
    them. A batch holds ``batch`` rows with dense 0-based ids: other ids
    inside a batch are an error here, missing batches one of ``dense_rows``."""
    p = T.first_label(pred, strip=True) if cut_first_label else F.col(pred)
    pieces = lambda x: F.coalesce(T.split_utterances(x), F.array().cast("array<string>"))
    rows = df.select(F.floor(F.col(row_id) / batch).alias("batch_id"),
                     F.struct(F.col(row_id).alias("id"), pieces(p).alias("pred"), pieces(F.col(true)).alias("true")).alias("r"))
    held = rows.groupBy("batch_id").agg(F.array_sort(F.collect_list("r")).alias("rs"))  # a fixed number of rows
    dense = F.forall(F.transform("rs", lambda r, i: r["id"] == F.col("batch_id") * batch + i), lambda ok: ok) & (F.size("rs") <= batch)
    wrong = F.raise_error(F.lit("row ids are not dense and 0-based: no batches"))

    def paired(preds: Column, trues: Column) -> Column:
        n = F.least(F.size(preds), F.size(trues))
        return F.transform(F.slice(F.arrays_zip(trues.alias("true"), preds.alias("pred")), 1, n), lambda z: F.struct(z["true"].alias("true"), z["pred"].alias("pred")))

    if mode == "batch":
        pairs = paired(F.flatten(F.transform("rs", lambda r: r["pred"])), F.flatten(F.transform("rs", lambda r: r["true"])))
    elif mode == "utterance":
        pairs = F.flatten(F.transform("rs", lambda r: paired(r["pred"], r["true"])))
    else:
        raise ValueError(mode)
    checked = F.when(F.coalesce(dense, F.lit(False)), pairs).otherwise(F.when(wrong.isNull(), pairs))
    return held.select("batch_id", F.size("rs").cast("long").alias("n_rows"), checked.alias("pairs"))


def dense_rows(batches: DataFrame, batch: int = 32) -> Column:
    """The number of rows in ``aligned_batches`` as a scalar; an error unless
    the batches are 0, 1, ... and full but for the last."""
    n, last = F.coalesce(F.sum("n_rows"), F.lit(0)), F.max(F.struct("batch_id", "n_rows"))
    full = (last["batch_id"] * batch + last["n_rows"] == n) | (n == 0)
    wrong = F.raise_error(F.lit("row ids are not dense and 0-based: no batches")).cast("long")
    return batches.select(F.when(full, n).otherwise(wrong)).scalar()


def generated_label_ids(aligned: DataFrame, *, per_utterance: bool) -> DataFrame:
    """F2 + J4/J5 for generated fine-grained labels: ids of the sorted label
    set; truths use their first label (unstripped). Per utterance the set
    comes from truths only and unknown predictions become 0; otherwise the set
    is the union of both sides and every label must be known."""
    a = aligned.withColumn("_true_first", T.first_label("true", strip=False))
    vocab = a.select(F.col("_true_first").alias("label"))
    if not per_utterance:
        vocab = vocab.union(a.select(F.col("pred").alias("label")))
    ids = label_ids(vocab, "label", "label_id")
    out = lookup_ids(a, "_true_first", ids, "true_id")
    out = lookup_ids(out, "pred", ids, "pred_id", default=0 if per_utterance else None)
    return out.drop("_true_first")
