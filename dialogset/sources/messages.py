"""Load annotated chat messages.

The reference runs one SQL query per donor list against a PostgreSQL table.
Here one scan feeds everything: the loader selects the language column,
casts, and keeps annotated rows; the donor split is a join (see
``operators.conversations.tag_donors``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogset.schema import CONV_KEYS


def jdbc_options(
    url: str,
    table: str = "messenger",
    *,
    partition_column: str = "user_id",
    lower_bound: int,
    upper_bound: int,
    num_partitions: int,
    fetch_size: int = 10_000,
    **extra: str,
) -> dict[str, str]:
    """Options for a partitioned parallel JDBC read of the message table.

    ``user_id`` ranges split the scan over ``num_partitions`` connections."""
    opts = {
        "url": url,
        "dbtable": table,
        "partitionColumn": partition_column,
        "lowerBound": str(lower_bound),
        "upperBound": str(upper_bound),
        "numPartitions": str(num_partitions),
        "fetchsize": str(fetch_size),
    }
    opts.update({k: str(v) for k, v in extra.items()})
    return opts


def read_jdbc(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    return spark.read.format("jdbc").options(**options).load()


def load_messages(raw: DataFrame, text_col: str = "line_text", label_col: str = "gold_nhot",
                  annotated_col: str = "is_annotated_tagset_0", keep_unannotated: bool = False) -> DataFrame:
    """Normalise a raw message table to the ``MESSAGES`` schema.

    ``label_col`` names the source table's n-hot label column (cast from a
    small-int array), ``annotated_col`` its annotation flag.

    ``text_col`` chooses the language variant (``line_text`` or
    ``line_text_en``). The annotated filter keeps only rows whose flag is
    TRUE; NULL is not true."""
    out = raw.select(
        F.col("user_id").cast("long").alias("user_id"),
        F.col("thread_id").cast("long").alias("thread_id"),
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("line_num").cast("long").alias("line_num"),
        F.col("author").cast("string").alias("author"),
        F.col(text_col).cast("string").alias("text"),
        F.col(label_col).cast("array<int>").alias("label"),
        F.col(annotated_col).cast("boolean").alias("is_annotated"),
    )
    if not keep_unannotated:
        out = out.where(annotated_filter())
    return out


def annotated_filter(col: str = "is_annotated"):
    """``flag IS TRUE`` (NULL and FALSE are dropped)."""
    return F.col(col).eqNullSafe(F.lit(True))


def quarantine_null_text(msgs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split off rows whose text or order key is NULL: the reference would
    fail on them; here they go to a separate output instead of vanishing."""
    bad = F.col("text").isNull() | F.col("line_num").isNull()
    return msgs.where(~bad), msgs.where(bad)


def write_bucketed(msgs: DataFrame, table: str, buckets: int, path: str | None = None, keys: Sequence[str] = CONV_KEYS) -> None:
    """Store messages by conversation: ``buckets`` buckets of whole
    conversations, one file each, sorted by ``line_num``. Windows (W1-W4) and
    conversations (A1) over ``spark.table(table)`` then need no exchange for
    grouping and positions. ``path`` makes the table an external one (on
    storage every executor can read); choose ``buckets`` such that a bucket fits a task
    (a hot conversation stays in one, and its rows take the operators'
    range-block path as ever)."""
    writer = (
        msgs.repartition(buckets, *keys)
        .sortWithinPartitions(*keys, "line_num")
        .write.mode("overwrite")
        .format("parquet")
        .bucketBy(buckets, *keys)
        .sortBy(*keys, "line_num")
    )
    (writer.option("path", path) if path else writer).saveAsTable(table)
