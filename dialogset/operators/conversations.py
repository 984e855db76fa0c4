"""Conversation-level operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogset.operators.scan import join_null_safe, split_hot
from dialogset.operators.windows import utterance_positions, wide_positions
from dialogset.schema import CONV_KEYS

# Donor tables up to this many rows are broadcast; the size is known on the
# driver because the donor lists are parameters.
BROADCAST_DONOR_LIMIT = 1_000_000
IN_LIST_DONORS = 10_000  # longer lists reach the scan as a range of ids


def donor_table(spark, donors: dict[str, list[int]]) -> DataFrame:
    rows = [(int(u), split) for split, users in donors.items() for u in users]
    return spark.createDataFrame(rows, "user_id long, split string")


def tag_donors(msgs: DataFrame, donors: dict[str, list[int]]) -> DataFrame:
    """P2 + W8: keep messages of listed donors and tag each with its split in
    one pass (the reference ran one query per list). Donors in no list are
    dropped; a donor in two lists would duplicate rows, so that is rejected.
    The ids are also given as a plain filter, which a stored ``user_id`` column
    takes into its scan (Parquet statistics, the JDBC query)."""
    seen: dict[int, str] = {}
    for split, users in donors.items():
        for u in users:
            if int(u) in seen and seen[int(u)] != split:
                raise ValueError(f"donor {u} is in two splits")
            seen[int(u)] = split
    table = donor_table(msgs.sparkSession, donors)
    if len(seen) <= BROADCAST_DONOR_LIMIT:
        table = F.broadcast(table)
    ids = sorted(seen)
    if len(ids) <= IN_LIST_DONORS:
        listed = F.col("user_id").isin(ids)
    else:
        listed = F.col("user_id").between(ids[0], ids[-1])
    return msgs.where(listed).join(table, "user_id")


def conversation_sizes(msgs: DataFrame, keys=CONV_KEYS) -> DataFrame:
    """P4 input: one row per conversation with ``n_turns``."""
    return msgs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_turns"))


def conversations(
    msgs: DataFrame,
    positions: DataFrame | None = None,
    keys=CONV_KEYS,
    *,
    max_turns_per_row: int,
) -> DataFrame:
    """A1: conversations as ordered parallel arrays (``texts``, ``labels``,
    ``authors``, ``line_nums``) in ``line_num`` order.

    Part ``p`` of a conversation (column ``part_no``) holds its utterances
    ``p * max_turns_per_row`` and on, so no row has to hold an unbounded
    conversation; the caller says how many a row may hold. Conversations a
    task may hold take one exchange, which carries the texts; hot ones, or
    given ``positions``, meet their texts by ``line_num``."""
    payload = ["text", "label", "author"]
    cold, hot, _ = (None, msgs, 0) if positions is not None else split_hot(msgs, keys)
    found = []
    if cold is not None:
        found.append(wide_positions(cold, keys, *payload))
    if hot is not None:
        pos = positions if positions is not None else utterance_positions(hot, keys)
        found.append(join_null_safe(hot.select(*keys, "line_num", *payload), pos.select(*keys, "line_num", "idx", "n_turns"), [*keys, "line_num"]))
    names = [*keys, "line_num", "idx", "n_turns", *payload]
    rows = reduce(DataFrame.unionByName, [f.select(*names) for f in found])
    rows = rows.withColumn("part_no", F.floor(F.col("idx") / max_turns_per_row))
    elem = F.struct("idx", "line_num", "text", "label", "author")
    grouped = rows.groupBy(*keys, "part_no", "n_turns").agg(F.array_sort(F.collect_list(elem)).alias("_t"))
    return grouped.select(
        *keys,
        "part_no",
        "n_turns",
        F.transform("_t", lambda e: e["line_num"]).alias("line_nums"),
        F.transform("_t", lambda e: e["text"]).alias("texts"),
        F.transform("_t", lambda e: e["label"]).alias("labels"),
        F.transform("_t", lambda e: e["author"]).alias("authors"),
    )
