"""Positions, cuts, label ids and resampling.

Anything that depends on a global position uses ``ordered_scan`` (a
distributed row number) instead of a global ``row_number()`` window, which
would run in a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogset.operators.quality import EXAMPLE_ORDER
from dialogset.operators.scan import ordered_scan
from dialogset.session import pin


def row_numbers(df: DataFrame, order: Sequence[tuple[str, bool]], out: str = "row_id", keys: Sequence[str] = ()) -> DataFrame:
    """0-based position of every row in ``order`` (within ``keys`` if given),
    computed without funnelling rows into one task."""
    s = ordered_scan(df, list(keys), list(order), seq_col=out, size_col="_n")
    return s.drop("_n")


def dev_test_cut(
    examples: DataFrame,
    split_col: str = "split",
    cut_split: str = "test",
    order: Sequence[tuple[str, bool]] = EXAMPLE_ORDER,
) -> DataFrame:
    """The first ``floor(n/4)`` examples of ``cut_split`` in ``order``
    become ``dev``; the rest stay ``test``; other splits keep their name.
    Adds ``part``.

    The examples are pinned once (they are the finished dataset, and the
    cut reads them twice). Only their order keys are scanned (a distributed
    row number over narrow rows); the example at position ``floor(n/4)``
    gives a threshold key, and the rows are compared against it as a scalar."""
    examples = pin(examples, "examples")
    key = F.struct(*[(F.col(c) if asc else -F.col(c)).alias(f"o{i}") for i, (c, asc) in enumerate(order)])
    narrow = examples.where(F.col(split_col) == cut_split).select(*[c for c, _ in order])
    s = ordered_scan(narrow, [], list(order), seq_col="_pos", size_col="_n")
    threshold = s.where(F.col("_pos") == F.floor(F.col("_n") / 4)).select(key.alias("k")).scalar()
    in_dev = (F.col(split_col) == cut_split) & F.coalesce(key < threshold, F.lit(False))
    is_cut = F.col(split_col) == cut_split
    return examples.withColumn("part", F.when(in_dev, "dev").when(is_cut, cut_split).otherwise(F.col(split_col)))


def batch_ids(df: DataFrame, batch: int = 32, row_col: str = "row_id", out: str = "batch_id") -> DataFrame:
    """Batch number of a 0-based row position."""
    return df.withColumn(out, F.floor(F.col(row_col) / batch))


def label_ids(labels: DataFrame, col: str = "label", out: str = "label_id") -> DataFrame:
    """F2 (+U2 when ``labels`` is a union): sorted distinct labels -> dense
    0-based id. Spark's binary string order equals Python's code-point order."""
    distinct = labels.select(col).where(F.col(col).isNotNull()).distinct()
    return row_numbers(distinct, [(col, True)], out=out)


def prefix_limit(df: DataFrame, n: int, order: Sequence[tuple[str, bool]] = (("row_id", True),)) -> DataFrame:
    """the first ``n`` rows in ``order`` (the limit is the feature)."""
    cols = [F.col(c).asc() if a else F.col(c).desc() for c, a in order]
    return df.orderBy(*cols).limit(n)


def class_ratio(df: DataFrame, label: str = "label", reverse: bool = False) -> DataFrame:
    """One row ``neg, pos, ratio`` with ``pos = sum/len`` and ``neg = 1 -
    pos`` in that order (IEEE doubles, as in the reference). ``ratio`` is
    ``[neg, pos]`` (``[pos, neg]`` with ``reverse``)."""
    pos = F.sum(F.col(label)).cast("double") / F.count(F.lit(1)).cast("double")
    stats = df.agg(pos.alias("pos")).withColumn("neg", F.lit(1.0) - F.col("pos"))
    ratio = F.array("pos", "neg") if reverse else F.array("neg", "pos")
    return stats.select("neg", "pos", ratio.alias("ratio"))


def oversample_plan(df: DataFrame, label: str = "label") -> DataFrame:
    """The one-row decision of F4: ``minority_label``, ``extra_copies``, and
    whether oversampling applies (minority share x 2 <= majority share)."""
    stats = class_ratio(df, label)
    minority = F.least("neg", "pos")
    majority = F.greatest("neg", "pos")
    # ties choose label 0 (first position of [neg, pos])
    minority_label = F.when(F.col("pos") < F.col("neg"), 1).otherwise(0)
    applies = (minority * 2 <= majority) & (minority > 0)
    copies = F.when(applies, (F.lit(1.0) / minority - F.lit(1.0)).cast("int")).otherwise(0)
    return stats.select(minority_label.alias("minority_label"), copies.alias("extra_copies"), applies.alias("applies"))


def oversample(df: DataFrame, label: str = "label") -> DataFrame:
    """F4 (+P7, U1): every minority row gets ``int(1/share - 1)`` extra copies
    when the minority share is at most half the majority share. Adds
    ``copy_no`` (0 = original). The one-row decision enters as scalar
    subqueries (computed once, broadcast as constants)."""
    plan = oversample_plan(df, label)
    minority_label = plan.select("minority_label").scalar()
    extra = plan.select("extra_copies").scalar()
    n_copies = F.when(F.col(label) == minority_label, extra).otherwise(0)
    return df.withColumn("copy_no", F.explode(F.sequence(F.lit(0), n_copies)))


def shuffle_key(seed: int, *cols) -> Column:
    """a reproducible pseudo-random sort key (same value in DuckDB)."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def seeded_shuffle(df: DataFrame, seed: int = 1, cols: Sequence[str] = ("row_id", "copy_no")) -> DataFrame:
    """order rows by ``md5(seed:cols)``; a distributed range sort."""
    return df.withColumn("shuffle_key", shuffle_key(seed, *cols)).orderBy("shuffle_key", *cols)
