"""Subsample confidence intervals of F1.

``R`` repeats each draw ``k = floor(n * fraction)`` rows *without*
replacement, score F1 by three averages, and report mean and 2.5 / 97.5 %
quantiles per average.

* ``rows`` mode is deterministic: repeat ``r`` takes the ``k`` rows with the
  smallest ``md5(seed:r:row_id)`` (the same ranking runs in DuckDB). A count
  per (repeat, first two hex digits), combined on the map side, names the one
  bucket that holds rank ``k``: rows of lower buckets are taken as they are,
  and only that bucket (about 1/256 of the rows) is ranked, by an ordered
  scan. Cost: ``R x n`` hashes on the map side, ``R x n / 256`` rows shuffled.
* ``cells`` mode (the default) never touches a row twice. F1 depends only on
  how many sampled rows fall in each distinct (truth, prediction) cell, and
  drawing rows without replacement draws cell counts from a multivariate
  hypergeometric distribution. One pass counts the cells. They are dealt by
  hash over at most 256 blocks; the driver splits every repeat's ``k``
  rows over the block totals, then each block splits its own share over its
  cells, in parallel. Each split draws one hypergeometric count by its exact
  quantile at a uniform number taken from ``md5(seed:repeat:name)``. Cost:
  one pass over the rows, ``R x cells`` draws, whatever ``n`` and ``k`` are;
  no limit on the number of cells.

The mode is chosen by the caller and never by the size of the input, so
reported numbers do not change method with it. Both draw the same
distribution and are reproducible for a seed (the same draws run in DuckDB).

``pooled=True`` reproduces the reference's accumulation across averages
(micro scores include the weighted ones; macro includes all three).
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from dialogset.operators.metrics import AVERAGES, cells, class_counts, f1_averages, multilabel_counts, repeat_interval
from dialogset.operators.scan import ordered_scan
from dialogset.session import pin, ship_package

BLOCK_DIGITS = 2  # of the cells' hashes: they are dealt over 256 blocks
DRAW_CELLS = 1_000_000  # probabilities held at once by a draw


def _pool(per_repeat: DataFrame, pooled: bool) -> DataFrame:
    if not pooled:
        return per_repeat
    # average i also collects the scores of all averages before it
    rank = F.create_map(*[x for i, a in enumerate(AVERAGES) for x in (F.lit(a), F.lit(i))])
    src = per_repeat.withColumn("_rank", rank[F.col("average")])
    targets = F.filter(F.array(*[F.lit(i) for i in range(len(AVERAGES))]), lambda j: j >= F.col("_rank"))
    names = F.array(*[F.lit(a) for a in AVERAGES])
    return src.select("repeat", F.explode(F.transform(targets, lambda j: F.get(names, j))).alias("average"), "f1")


def sample_size(df: DataFrame, fraction: float = 0.1, size: int | None = None):
    """``floor(n * fraction)`` as a scalar subquery (or a fixed ``size``); a
    sample of 0 rows is an error."""
    if size is not None:
        k = size if isinstance(size, Column) else F.lit(int(size))
    else:
        n = df.select(F.count(F.lit(1))).scalar()
        k = F.floor(n * F.lit(float(fraction)))
    return F.when(k > 0, k).otherwise(F.raise_error(F.lit("subsample of 0 rows: fewer than 1/fraction rows")).cast("long"))


def subsample_f1_rows(
    df: DataFrame,
    true: str = "true",
    pred: str = "pred",
    row_id: str = "row_id",
    repeats: int = 200,
    fraction: float = 0.1,
    seed: int = 0,
    multilabel: bool = False,
    pooled: bool = False,
    size: int | Column | None = None,
) -> DataFrame:
    """Per-repeat F1 (``repeat, average, f1``), rows mode. A ``size`` above
    the number of rows takes all of them."""
    k = sample_size(df, fraction, size)
    hashed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("repeat").cast("string"), F.col(row_id).cast("string")))
    reps = (
        df.select(row_id, true, pred, F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
        .withColumn("_h", hashed)
        .withColumn("_b", F.substring("_h", 1, 2))
    )
    upto = F.sum("_n").over(Window.partitionBy("repeat").orderBy("_b"))
    reached = (
        reps.groupBy("repeat", "_b").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", upto - F.col("_n"))
        .where((F.col("_before") < k) & (F.col("_before") + F.col("_n") >= k))
        .select("repeat", F.col("_b").alias("_edge"), (k - F.col("_before")).alias("_take"))
    )
    # at most one row per repeat
    split = reps.join(F.broadcast(reached), "repeat", "left")
    below = split.where(F.col("_edge").isNull() | (F.col("_b") < F.col("_edge")))
    edge = pin(split.where(F.col("_b") == F.col("_edge")).select("repeat", "_h", row_id, true, pred, "_take"), "interval-edge")
    ranked = ordered_scan(edge, ["repeat"], [("_h", True), (row_id, True)], seq_col="_pos", size_col="_n")
    cols = ["repeat", true, pred]
    picked = below.select(*cols).unionByName(ranked.where(F.col("_pos") < F.col("_take")).select(*cols))
    counts = (multilabel_counts(picked, true, pred, ["repeat"]).drop("tn") if multilabel
              else class_counts(picked, true, pred, ["repeat"]))
    return _pool(f1_averages(counts, ["repeat"]), pooled)


def uniform(seed: int, repeats: int, name: str) -> np.ndarray:
    """One number in [0, 1) per repeat: 52 bits of ``md5(seed:repeat:name)``."""
    return np.array([int(hashlib.md5(f"{seed}:{r}:{name}".encode()).hexdigest()[:13], 16) for r in range(repeats)]) / 2.0**52


def hypergeometric(total: np.ndarray, held: int, take: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Quantile ``u`` of the number of ``held`` among ``take`` drawn without
    replacement from ``total`` (one draw per position).

    Probabilities come from the ratios of neighbours, summed over all counts
    within 12 deviations (and 40) of the mean: what lies beyond has a
    probability below 1e-30."""
    out = np.zeros(len(take), np.int64)
    if held == 0:
        return out
    share = held / np.maximum(total, 1)
    mean = take * share
    spread = np.sqrt(mean * (1 - share) * np.maximum(total - take, 0) / np.maximum(total - 1, 1))
    low = np.maximum(np.maximum(0, take - (total - held)), np.floor(mean - 12 * spread - 40).astype(np.int64))
    high = np.minimum(np.minimum(held, take), np.ceil(mean + 12 * spread + 40).astype(np.int64))
    width = int((high - low).max()) + 1
    step = max(1, DRAW_CELLS // width)
    for s in range(0, len(take), step):
        n, k, lo, hi = (x[s : s + step, None].astype(float) for x in (total, take, low, high))
        i = lo + np.arange(width - 1)
        inside = i < hi
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.log((held - i) * (k - i)) - np.log((i + 1) * (n - held - k + i + 1))
        logs = np.concatenate([np.zeros((len(lo), 1)), np.cumsum(np.where(inside, ratio, 0.0), 1)], 1)
        p = np.exp(logs - logs.max(1, keepdims=True))
        p[:, 1:] *= inside
        below = np.cumsum(p, 1)
        at = (below <= u[s : s + step, None] * below[:, -1:]).sum(1)
        out[s : s + step] = np.minimum(low[s : s + step] + at, high[s : s + step])
    return out


def split_sample(held: Sequence[int], names: Sequence[str], take: np.ndarray, seed: int) -> np.ndarray:
    """How many of each repeat's ``take`` rows fall in each of the parts of
    ``held`` rows, in their order (parts, repeats): part after part draws from
    what is left."""
    left = np.full(len(take), int(sum(held)), np.int64)
    out = np.zeros((len(held), len(take)), np.int64)
    take = take.astype(np.int64).copy()
    for j, (h, name) in enumerate(zip(held, names)):
        out[j] = hypergeometric(left, int(h), take, uniform(seed, len(take), name))
        left -= int(h)
        take -= out[j]
    return out


def _key(c: Column, kind) -> Column:
    """A cell's value as text."""
    return F.array_join(c.cast("array<string>"), ",") if isinstance(kind, ArrayType) else c.cast("string")


def cell_sizes(cells: DataFrame, true: str, pred: str, n: str) -> DataFrame:
    """``true, pred, _w, _h, _block``: equal cells added up, named and dealt
    by the hash of their text."""
    kinds = cells.schema
    text = F.concat_ws("|", F.coalesce(_key(F.col(true), kinds[true].dataType), F.lit("")), F.coalesce(_key(F.col(pred), kinds[pred].dataType), F.lit("")))
    sized = cells.groupBy(true, pred).agg(F.sum(n).cast("long").alias("_w"))
    return sized.withColumn("_h", F.md5(text)).withColumn("_block", F.substring("_h", 1, BLOCK_DIGITS))


def draw_cells(cells: DataFrame, true: str = "true", pred: str = "pred", n: str = "n", repeats: int = 200,
               fraction: float = 0.1, seed: int = 0, size: int | Column | None = None) -> DataFrame:
    """``repeat, true, pred, drawn``: how many of each repeat's rows fall in
    each cell (cells without any are left out). ``cells`` holds ``n`` rows a
    cell. A ``size`` above the number of rows takes all of them."""
    spark = cells.sparkSession
    ship_package(spark)
    sized = pin(cell_sizes(cells, true, pred, n), "interval-cells")
    blocks = sorted((r[0], r[1]) for r in sized.groupBy("_block").agg(F.sum("_w")).collect())  # at most 256 rows
    total = sum(w for _, w in blocks)
    if isinstance(size, Column):
        size = spark.range(1).select(size).first()[0]
    k = min(total, int(size)) if size is not None else int(np.floor(total * fraction))
    if k <= 0:
        raise ValueError("subsample of 0 rows: fewer than 1/fraction rows")
    shares = split_sample([w for _, w in blocks], [b for b, _ in blocks], np.full(repeats, k), seed)
    shared = spark.sparkContext.broadcast({b: shares[j] for j, (b, _) in enumerate(blocks)})  # at most 256 x R numbers

    def draw(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("_h")
        take = shared.value[block["_block"].iloc[0]]
        block["drawn"] = list(split_sample(block["_w"].tolist(), block["_h"].tolist(), take, seed))
        return block[[true, pred, "drawn"]]

    kinds = cells.schema
    schema = StructType([kinds[true], kinds[pred], StructField("drawn", ArrayType(LongType()))])
    drawn = sized.groupBy("_block").applyInPandas(draw, schema)
    out = drawn.select(true, pred, F.posexplode("drawn").alias("repeat", "drawn"))
    return out.where(F.col("drawn") > 0).select(F.col("repeat").cast("long").alias("repeat"), true, pred, "drawn")


def subsample_f1_cells(
    cells: DataFrame,
    true: str = "true",
    pred: str = "pred",
    n: str = "n",
    repeats: int = 200,
    fraction: float = 0.1,
    seed: int = 0,
    multilabel: bool = False,
    pooled: bool = False,
    size: int | Column | None = None,
) -> DataFrame:
    """Per-repeat F1 (``repeat, average, f1``) of a cell table, cells mode."""
    drawn = draw_cells(cells, true, pred, n, repeats, fraction, seed, size)
    counts = (multilabel_counts(drawn, true, pred, ["repeat"], "drawn").drop("tn") if multilabel
              else class_counts(drawn, true, pred, ["repeat"], "drawn"))
    return _pool(f1_averages(counts, ["repeat"]), pooled)


def cell_interval(cells: DataFrame, true: str = "true", pred: str = "pred", n: str = "n", **kw) -> DataFrame:
    """A17 from a cell table: ``average, lower, upper, mean`` per F1 average."""
    return repeat_interval(subsample_f1_cells(cells, true, pred, n, **kw), "f1", ["average"])


def subsample_interval(
    df: DataFrame,
    true: str = "true",
    pred: str = "pred",
    row_id: str = "row_id",
    mode: str = "cells",
    repeats: int = 200,
    fraction: float = 0.1,
    seed: int = 0,
    multilabel: bool = False,
    pooled: bool = False,
    size: int | Column | None = None,
) -> DataFrame:
    """``average, lower, upper, mean`` per F1 average. ``mode`` is the
    caller's choice and never depends on the input's size."""
    if mode == "rows":
        per = subsample_f1_rows(df, true, pred, row_id, repeats, fraction, seed, multilabel, pooled, size)
    elif mode == "cells":
        counted = cells(df, true, pred, n="_n")
        per = subsample_f1_cells(counted, true, pred, "_n", repeats, fraction, seed, multilabel, pooled, size)
    else:
        raise ValueError(mode)
    return repeat_interval(per, "f1", ["average"])
