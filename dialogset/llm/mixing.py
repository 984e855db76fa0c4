"""Operator 8: mixing sources to target weights by systematic sampling.

Sources, ordered by code point (null last), weigh 1, 2, 3, 1, 2, 3, ... and
share the corpus's words by weight; a target stops at ``MAX_COPIES`` times
its source's words and the excess is shared again by weight among the others
until none is above (water-filling). A document of a source is expected
``target / source words`` times. Within each source the expected copies are
summed in order of (size, hash of the id), one random offset is added, and a
document is emitted once for every integer boundary its interval crosses.
Ordering by size makes the sample systematic in size too: the words taken
differ from the target by about one document at most, and no document is
taken more than ``MAX_COPIES`` times.

All of it is integer arithmetic (decimal(38) where products grow), so the sum
of expected copies at row k is exactly ``k * num / den`` and a rerun agrees to
the copy. The offset and the tie order come from md5 of a seed and the value.

Distribution: the rank of a row in its source is a two-level scan: rows are
range-partitioned by (source, size, hash) and sorted, so a hot source spans
many partitions; the rows' order in a partition and the prefix sums of its
few (source, partition) counts give the rank. That is the only exchange of
the rows. Sources are ranked and filled by ordered scans, which split them
over tasks when there are very many.

Edge cases: null text has size 0; a null source is a source of its own, last
in order; a source without words has target 0 and its documents are taken 0
times; rows with one doc_id rank next to each other and are drawn each; an
empty table gives an empty result; extra columns pass through ``mix`` (one
named like its copy number is replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialogset.llm.common import WORD, broadcast_if, text_or_empty
from dialogset.operators.scan import ordered_scan
from dialogset.session import pin

MAX_COPIES = 3
WEIGHTS = (1, 2, 3)
BROADCAST_SOURCES = 200_000
BIG = "decimal(38,0)"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """source, source_size, num, den, target: the target is the exact ratio
    num / den (in words)."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("none", F.col("source").isNull().cast("int"))
    ranked = ordered_scan(by, [], [("none", True), ("source", True)], seq_col="rank", size_col="sources")
    w = F.get(F.array(*[F.lit(x) for x in weights]), (F.col("rank") % len(weights)).cast("int")).cast("long")
    by = ranked.select("source", "source_size", "rank", w.alias("weight"), (F.col("source_size") * max_copies).alias("cap"))
    # capped sources are those of the smallest cap per weight: a source is
    # capped iff its cap is below its share of what the smaller ones leave
    fill = (F.col("cap").cast(BIG) * _lcm(weights) / F.col("weight")).cast(BIG)
    by = pin(by.withColumn("fill", fill), "mix-sources")
    by = ordered_scan(by, [], [("fill", True), ("rank", True)], sums=["source_size", "cap", "weight"], seq_col="place", size_col="sources")
    left, left_w = F.col("source_size_total") - F.col("cap_before"), F.col("weight_total") - F.col("weight_before")
    capped = F.col("cap").cast(BIG) * left_w <= F.col("weight").cast(BIG) * left
    by = pin(by.select("source", "source_size", "weight", "cap", capped.alias("capped")), "mix-caps")
    free = by.agg(
        F.sum("source_size") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))), F.lit(0)),
        F.coalesce(F.sum(F.when(~F.col("capped"), F.col("weight"))), F.lit(0)),
    ).first()  # two numbers
    by = by.withColumn("free_words", F.lit(free[0]).cast("long")).withColumn("free_weight", F.lit(free[1]).cast("long"))
    num = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * F.col("free_words"))
    den = F.when(F.col("capped"), F.lit(1)).otherwise(F.col("free_weight"))
    return by.select(
        "source",
        "source_size",
        num.cast("long").alias("num"),
        den.cast("long").alias("den"),
        (num.cast("double") / den).alias("target"),
    )


def _lcm(values: tuple[int, ...]) -> int:
    from math import lcm

    return lcm(*values)


def _hash32(*parts) -> F.Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def allocate(
    docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, carry: Column | None = None
) -> DataFrame:
    """One narrow row per document: doc_id, source, size, source_size, target,
    rank (from 1 in its source) and copies; and ``carry``, if given."""
    carried = [] if carry is None else [carry.alias("carried")]
    sized = docs.select(
        "doc_id", "source", F.regexp_count(text_or_empty("text"), F.lit(WORD)).cast("long").alias("size"), *carried
    )
    # the order hash breaks ties of size at random, but the same way on every run
    sized = sized.withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    n = int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("source").asc_nulls_last(), "size", "h", "doc_id"]
    ranged = sized.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # rows of a block stand in order: their place in it is their number
    ranged = pin(ranged.withColumn("block", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "mix-ranged")
    goal = pin(targets(ranged, weights, max_copies), "mix-targets")
    n_sources = goal.count()

    # rows before each (source, block): a table of at most sources + partitions rows
    starts = ranged.groupBy("source", "block").agg(F.count(F.lit(1)).alias("rows"), F.min("place").alias("first"))
    prior = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(
        F.col("source").alias("_source"), F.col("block").alias("_block"), "first", F.coalesce(F.sum("rows").over(prior), F.lit(0)).alias("start")
    )
    ranked = ranged.join(
        broadcast_if(starts, n_sources + n, BROADCAST_SOURCES),
        F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block")),
    ).withColumn("rank", F.col("start") + F.col("place") - F.col("first") + 1)

    t = goal.select(F.col("source").alias("_goal"), "source_size", "num", "den", "target")
    joined = ranked.join(broadcast_if(t, n_sources, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("_goal")))
    # copies expected up to rank k: k * num / unit; the offset is u / 2^32 of a copy
    small = "decimal(19,0)"
    unit = F.col("den").cast(small) * F.col("source_size").cast(small)
    u = _hash32(F.lit(seed), F.coalesce(F.col("source"), F.lit("\u0000"))).cast("decimal(10,0)")
    offset = F.call_function("div", unit.cast("decimal(28,0)") * u, F.lit(2**32).cast("decimal(11,0)"))

    def crossed(k):
        return F.call_function("div", k.cast(small) * F.col("num").cast(small) + offset.cast(small), unit)

    copies = F.when(F.col("source_size") > 0, crossed(F.col("rank")) - crossed(F.col("rank") - 1)).otherwise(0)
    return joined.select("doc_id", "source", "size", "source_size", "target", "rank", copies.cast("long").alias("copies"), *(["carried"] if carried else []))


def mix(docs: DataFrame, copy: str = "copy", **kw) -> DataFrame:
    """The mixed corpus: every row of ``docs`` once per copy taken, with a
    column ``copy`` that numbers the copies from 1. Whole rows travel through
    the range partitioning, so rows repeating a doc_id are never confused."""
    docs = docs.drop(copy)
    drawn = allocate(docs, carry=F.struct(*[F.col(f"`{c}`") for c in docs.columns]), **kw).where("copies > 0")
    numbered = drawn.select("carried", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_copy"))
    return numbered.select("carried.*", F.col("_copy").alias(copy))
