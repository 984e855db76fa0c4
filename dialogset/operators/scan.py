"""Ordered scans within groups that stay parallel when one group is huge.

A window ``partitionBy(group).orderBy(...)`` runs each group in one task, so
a conversation (or a text, or a split) holding a third of all rows would be
processed by a single core. ``ordered_scan`` computes the same running values
in two levels instead:

1. ``repartitionByRange(group, order)`` cuts the sorted row sequence into
   contiguous blocks of similar size; a hot group spans many blocks. The block
   id is taken from the partition id and the result is pinned in the reliable
   checkpoint folder, so both branches below see identical blocks (also after
   an executor loss).
2. One small aggregate per (group, block) gives counts, sums, and the last
   value of each block; a window over that small table gives, per block, the
   totals of all earlier blocks of the group (the carry).
3. The rows are joined to their carry on (group, block) and finished by a
   window partitioned by (group, block): every task holds at most one block.

Most groups are small, and for them the block path only adds work. So the
scan first counts rows per group (a partial aggregate over a 64-bit hash of
the keys) and splits the input: groups above ``hot_group_rows`` (at most
rows / threshold of them, so the list is bounded and broadcast) take the
block path; all other rows take one plain window, whose largest partition is
bounded by the threshold. The threshold comes from the session conf
``dialogset.scan.hotGroupRows`` (default 1,000,000).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialogset.session import pin

Order = Sequence[tuple[str, bool]]  # (column, ascending)

HOT_GROUP_ROWS = 1_000_000
MAX_HOT_GROUPS = 100_000  # beyond this many hot groups every row takes the block path
MAX_BLOCKS = 20_000  # range-partition sample size grows with the block count


def _block_count(spark, rows: int, per_block: int) -> int:
    """Enough blocks that each holds about ``per_block`` rows (at least the
    shuffle partition count, at most ``MAX_BLOCKS``). Beyond ``MAX_BLOCKS *
    per_block`` rows the blocks grow and their sorts spill; results stay the
    same, and the carry of a global scan stays small enough to broadcast."""
    base = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return int(min(MAX_BLOCKS, max(base, -(-rows // max(per_block, 1)))))


def _order_cols(order: Order) -> list[Column]:
    return [F.col(c).asc() if asc else F.col(c).desc() for c, asc in order]


def _order_key(order: Order) -> Column:
    """A value that sorts ascending in the scan order (descending keys are
    negated, so they must be numeric). A single key stays a plain column so
    the block aggregate remains a hash aggregate."""
    fields = [(F.col(c) if asc else -F.col(c)).alias(f"k{i}") for i, (c, asc) in enumerate(order)]
    return fields[0] if len(fields) == 1 else F.struct(*fields)


def _block_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Order,
    *,
    sums: Sequence[str] = (),
    prev: Sequence[str] = (),
    firsts: Sequence[str] = (),
    blocks: int | None = None,
    seq_col: str = "seq",
    size_col: str = "group_n",
) -> DataFrame:
    """The two-level scan (see module doc); every task holds at most one block."""
    keys = list(keys)
    spark = df.sparkSession
    n_blocks = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))

    ranged = df.repartitionByRange(n_blocks, *[F.col(k) for k in keys], *_order_cols(order)).withColumn(
        "_blk", F.spark_partition_id()
    )
    ranged = pin(ranged, "scan")

    okey = _order_key(order)
    block_aggs = [F.count(F.lit(1)).alias("_bn")]
    block_aggs += [F.sum(c).alias(f"_bs_{c}") for c in sums]
    block_aggs += [F.max_by(c, okey).alias(f"_bl_{c}") for c in prev]
    block_aggs += [F.min_by(c, okey).alias(f"_bf_{c}") for c in firsts]
    per_block = ranged.groupBy(*keys, "_blk").agg(*block_aggs)

    wb = Window.partitionBy(*keys).orderBy("_blk")
    before = wb.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    # one key column: structs compare NULL fields as equal, so groups with NULL
    # keys meet their carry like any other
    group_key = [F.struct(*keys).alias("_kk")] if keys else []
    on = ["_kk", "_blk"] if keys else ["_blk"]
    carry_cols = [
        *group_key,
        "_blk",
        F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_cn"),
        F.sum("_bn").over(whole).alias(size_col),
    ]
    for c in sums:
        carry_cols.append(F.coalesce(F.sum(f"_bs_{c}").over(before), F.lit(0)).alias(f"_cs_{c}"))
        carry_cols.append(F.sum(f"_bs_{c}").over(whole).alias(f"{c}_total"))
    for c in prev:
        carry_cols.append(F.lag(f"_bl_{c}", 1).over(wb).alias(f"_cl_{c}"))
    for c in firsts:
        carry_cols.append(
            F.first(f"_bf_{c}").over(wb.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(
                f"{c}_first"
            )
        )
    carry = per_block.select(*carry_cols)
    if not keys:
        # one row per block: the size is bounded by the block count
        carry = F.broadcast(carry)

    # Explicit (group, block) partitioning of the rows: the local windows
    # below then never inherit a coarser partitioning from the carry side
    # (by group only), which would put a hot group back into one task.
    rows = ranged.select("*", *group_key).repartition(n_blocks, *on)
    joined = rows.join(carry, on)
    wl = Window.partitionBy(*on).orderBy(*_order_cols(order))
    rn = F.row_number().over(wl)
    out = joined.withColumn("_rn", rn).withColumn(seq_col, (F.col("_cn") + F.col("_rn") - 1).cast("long"))
    for c in sums:
        local = F.coalesce(F.sum(c).over(wl.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        out = out.withColumn(f"{c}_before", F.col(f"_cs_{c}") + local)
    for c in prev:
        out = out.withColumn(
            f"{c}_prev", F.when(F.col("_rn") == 1, F.col(f"_cl_{c}")).otherwise(F.lag(c, 1).over(wl))
        )
    drop = ["_kk", "_blk", "_cn", "_rn"] + [f"_cs_{c}" for c in sums] + [f"_cl_{c}" for c in prev]
    return out.drop(*drop)


def window_scan(df: DataFrame, keys, order: Order, sums, prev, firsts, seq_col: str, size_col: str) -> DataFrame:
    """The same columns as ``_block_scan`` from one window per group (for
    groups whose size is bounded by the hot-group threshold)."""
    w = Window.partitionBy(*keys).orderBy(*_order_cols(order))
    whole = Window.partitionBy(*keys)
    cols = [
        (F.row_number().over(w) - 1).cast("long").alias(seq_col),
        F.count(F.lit(1)).over(whole).alias(size_col),
    ]
    cols += [F.sum(c).over(whole).alias(f"{c}_total") for c in sums]
    cols += [
        F.first(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(f"{c}_first")
        for c in firsts
    ]
    cols += [
        F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"{c}_before")
        for c in sums
    ]
    cols += [F.lag(c, 1).over(w).alias(f"{c}_prev") for c in prev]
    return df.select("*", *cols)


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on ``keys`` where NULL keys are equal, as in GROUP BY."""
    renamed = right.select(*[F.col(c).alias(f"_j_{c}") if c in keys else F.col(c) for c in right.columns])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_j_{k}")) for k in keys])
    return left.join(renamed, same).drop(*[f"_j_{k}" for k in keys])


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Order,
    *,
    sums: Sequence[str] = (),
    prev: Sequence[str] = (),
    firsts: Sequence[str] = (),
    blocks: int | None = None,
    seq_col: str = "seq",
    size_col: str = "group_n",
    hot_group_rows: int | None = None,
    materialize: bool = False,
) -> DataFrame:
    """Add running values in ``order`` within each group of ``keys``.

    Output columns added to every row:

    * ``seq_col``: 0-based position in the group; ``size_col``: group size.
    * for each ``c`` in ``sums``: ``c_before`` (sum over earlier rows) and
      ``c_total`` (sum over the group).
    * for each ``c`` in ``prev``: ``c_prev``, the value of the previous row
      (NULL for the first row of the group).
    * for each ``c`` in ``firsts``: ``c_first``, the value of the group's first row.

    ``order`` must be a total order inside each group (add a tie breaker).
    With empty ``keys`` the whole frame is one group (a distributed global
    row number). Planning runs one small job (group sizes); with
    ``materialize`` the input is pinned first, so an expensive upstream plan
    runs once for the size check and the scan."""
    keys = list(keys)
    spark = df.sparkSession
    if materialize:
        df = pin(df, "scan-input")
    limit = hot_group_rows or hot_group_limit(spark)
    args = dict(sums=sums, prev=prev, firsts=firsts, seq_col=seq_col, size_col=size_col)

    def block(d, rows=0):
        return _block_scan(d, keys, order, blocks=blocks or _block_count(spark, rows, limit), **args)

    def window(d):
        return window_scan(d, keys, order, **args)

    if not keys:
        n = df.count()
        return block(df, n) if n > limit else window(df)
    cold, hot, n = split_hot(df, keys, limit)
    if hot is None:
        return window(cold)
    if cold is None:
        return block(hot, n)
    done = window(cold)
    return done.unionByName(block(hot, n).select(*done.columns))


def hot_group_limit(spark) -> int:
    """Rows above which a group is split over tasks."""
    return int(spark.conf.get("dialogset.scan.hotGroupRows", str(HOT_GROUP_ROWS)))


def split_hot(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> tuple[DataFrame | None, DataFrame | None, int]:
    """``(cold, hot, rows)``: the rows of groups of at most ``limit`` rows, the
    others (None if there are none) and their number. One small job counts the groups.

    Groups are told apart by a 64-bit hash of the keys: the count then shuffles
    8-byte values even when a key is a long text, and a collision only sends a
    small group among the hot ones. With more than ``MAX_HOT_GROUPS`` hot groups
    every row counts as hot."""
    spark = df.sparkSession
    limit = limit or hot_group_limit(spark)
    hashed = df.withColumn("_kh", F.xxhash64(*[F.col(k) for k in keys]))
    sizes = hashed.groupBy("_kh").agg(F.count(F.lit(1)).alias("_n"))
    hot_rows = sizes.where(F.col("_n") > limit).limit(MAX_HOT_GROUPS + 1).collect()
    if not hot_rows:
        return df, None, 0
    if len(hot_rows) > MAX_HOT_GROUPS:
        return None, df, sizes.agg(F.sum("_n")).first()[0]
    # at most rows / threshold hashes, and never more than MAX_HOT_GROUPS: broadcast
    hot_df = F.broadcast(spark.createDataFrame([(r[0],) for r in hot_rows], "_kh long"))
    cold = hashed.join(hot_df, "_kh", "left_anti").drop("_kh")
    hot = hashed.join(hot_df, "_kh", "left_semi").drop("_kh")
    return cold, hot, sum(r[1] for r in hot_rows)
