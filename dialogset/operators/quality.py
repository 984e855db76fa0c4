"""Noise filter and duplicate removal.

Dedup keys are texts, and one text (a greeting, an empty line) may occur in
a large share of all examples. Both dedups therefore avoid a plain window
over the text group:

* W5 keeps row number 1 of every text: the limit on the row number is applied
  inside every map task first, so a hot text sends one row a task.
* W6 needs the previous row of the same text; ``ordered_scan``, which splits
  a hot text over several range blocks, runs over narrow rows (digests and
  order keys, pinned), and only the keys of rejected rows meet the examples.

Texts are told apart by their SHA-256 (32 bytes), so no sort, exchange or
range sample carries a raw text as its key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialogset.operators.scan import ordered_scan
from dialogset.session import pin

# The code points with Unicode's public Emoji property (without
# digits, # and *, which count in keycaps only, and without regional
# indicators, which count in pairs only).
EMOJI_RANGES = """
00A9 00AE 203C 2049 2122 2139 2194-2199 21A9-21AA 231A-231B 2328 23CF 23E9-23F3 23F8-23FA 24C2
25AA-25AB 25B6 25C0 25FB-25FE 2600-2604 260E 2611 2614-2615 2618 261D 2620 2622-2623 2626 262A 262E-262F
2638-263A 2640 2642 2648-2653 265F-2660 2663 2665-2666 2668 267B 267E-267F 2692-2697 2699 269B-269C
26A0-26A1 26A7 26AA-26AB 26B0-26B1 26BD-26BE 26C4-26C5 26C8 26CE-26CF 26D1 26D3-26D4 26E9-26EA 26F0-26F5
26F7-26FA 26FD 2702 2705 2708-270D 270F 2712 2714 2716 271D 2721 2728 2733-2734 2744 2747 274C 274E
2753-2755 2757 2763-2764 2795-2797 27A1 27B0 27BF 2934-2935 2B05-2B07 2B1B-2B1C 2B50 2B55 3030 303D 3297 3299
1F004 1F0CF 1F170-1F171 1F17E-1F17F 1F18E 1F191-1F19A 1F201-1F202 1F21A 1F22F 1F232-1F23A 1F250-1F251
1F300-1F321 1F324-1F393 1F396-1F397 1F399-1F39B 1F39E-1F3F0 1F3F3-1F3F5 1F3F7-1F4FD 1F4FF-1F53D 1F549-1F54E
1F550-1F567 1F56F-1F570 1F573-1F57A 1F587 1F58A-1F58D 1F590 1F595-1F596 1F5A4-1F5A5 1F5A8 1F5B1-1F5B2 1F5BC
1F5C2-1F5C4 1F5D1-1F5D3 1F5DC-1F5DE 1F5E1 1F5E3 1F5E8 1F5EF 1F5F3 1F5FA-1F64F 1F680-1F6C5 1F6CB-1F6D2
1F6D5-1F6D7 1F6DC-1F6E5 1F6E9 1F6EB-1F6EC 1F6F0 1F6F3-1F6FC 1F7E0-1F7EB 1F7F0 1F90C-1F93A 1F93C-1F945
1F947-1F9FF 1FA70-1FA7C 1FA80-1FA89 1FA8F-1FAC6 1FACE-1FADC 1FADF-1FAE9 1FAF0-1FAF8
"""
# A flag is two regional indicators, a keycap is [0-9#*] + optional FE0F +
# 20E3; other emoji are a base symbol with optional skin tone and FE0F,
# chained by ZWJ. Pass another pattern to count differently.
EMOJI_BASE = "[" + "".join("-".join(f"\\x{{{end}}}" for end in r.split("-")) for r in EMOJI_RANGES.split()) + "]"
EMOJI_FLAG = "[\\x{1F1E6}-\\x{1F1FF}]{2}"
EMOJI_KEYCAP = "[0-9#*]\\x{FE0F}?\\x{20E3}"
_ONE = EMOJI_BASE + "[\\x{1F3FB}-\\x{1F3FF}]?\\x{FE0F}?"
EMOJI_PATTERN = f"{EMOJI_FLAG}|{EMOJI_KEYCAP}|{_ONE}(?:\\x{{200D}}{_ONE})*"
# Java tries a class range by range, for every character that is no emoji all
# of them (3 us). Looking first at the few blocks that hold the ranges finds
# the same matches; RE2, which has no look-ahead, takes the pattern above.
EMOJI_BLOCKS = "[\\x{A9}-\\x{AE}\\x{203C}-\\x{2B55}\\x{3030}-\\x{303D}\\x{3297}-\\x{3299}\\x{1F004}-\\x{1FAF8}]"
_EMOJI_GUARDED = f"{EMOJI_FLAG}|{EMOJI_KEYCAP}|(?={EMOJI_BLOCKS}){_ONE}(?:\\x{{200D}}{_ONE})*"

NOISE_MIN_LENGTH = 30  # fixed value: texts up to this length are never noise


def emoji_count(text, pattern: str = EMOJI_PATTERN) -> Column:
    """H3: number of emoji; a flag, keycap or ZWJ sequence counts once."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_count(text, F.lit(_EMOJI_GUARDED if pattern == EMOJI_PATTERN else pattern))


def is_noise(text, ratio: float, pattern: str = EMOJI_PATTERN) -> Column:
    """P5: longer than 30 characters and more than ``ratio`` x length emoji
    (both strict)."""
    text = F.col(text) if isinstance(text, str) else text
    n = F.length(text)
    return (n > NOISE_MIN_LENGTH) & (emoji_count(text, pattern) > n * F.lit(float(ratio)))


def _digest(col: str) -> Column:
    return F.unhex(F.sha2(F.col(col), 256))


def _first_rows(df: DataFrame, partition: Sequence[str], texts: Sequence[str], order: Sequence[tuple[str, bool]]) -> DataFrame:
    """The first row in ``order`` of every distinct value of ``texts``."""
    keys = [f"_t{i}" for i in range(len(texts))]
    w = Window.partitionBy(*partition, *keys).orderBy(*[F.col(c).asc() if asc else F.col(c).desc() for c, asc in order])
    hashed = df.select("*", *[_digest(c).alias(k) for c, k in zip(texts, keys)])
    return hashed.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select(*df.columns)


EXAMPLE_ORDER = [("user_id", True), ("thread_id", True), ("conv_id", True), ("target_idx", False)]


def first_occurrence_dedup(
    examples: DataFrame,
    ratio: float,
    *,
    partition: Sequence[str] = ("split",),
    text_col: str = "text",
    order: Sequence[tuple[str, bool]] = EXAMPLE_ORDER,
    pattern: str = EMOJI_PATTERN,
) -> tuple[DataFrame, DataFrame]:
    """W5 + A6: drop noise, then keep the first example of every text (per
    ``partition``) in ``order``.

    Returns ``(kept, rejections)``; ``rejections`` has one row per text with
    ``n_duplicate``, ``n_noise`` and their sum ``n_rejected`` (only texts with
    at least one rejection)."""
    partition = list(partition)
    payload = examples.columns
    flagged = examples.withColumn("_noise", is_noise(text_col, ratio, pattern))
    clean = flagged.where(~F.col("_noise"))
    kept = _first_rows(clean.select(*payload), partition, [text_col], order)
    rejections = (
        flagged.groupBy(*partition, text_col)
        .agg(
            F.sum(F.when(F.col("_noise"), 0).otherwise(1)).alias("_clean"),
            F.sum(F.when(F.col("_noise"), 1).otherwise(0)).alias("n_noise"),
        )
        .select(
            *partition,
            text_col,
            F.greatest(F.col("_clean") - 1, F.lit(0)).alias("n_duplicate"),
            "n_noise",
        )
        .withColumn("n_rejected", F.col("n_duplicate") + F.col("n_noise"))
        .where(F.col("n_rejected") > 0)
    )
    return kept, rejections


def last_context_dedup(
    examples: DataFrame,
    ratio: float,
    *,
    partition: Sequence[str] = ("split",),
    order: Sequence[tuple[str, bool]] = EXAMPLE_ORDER,
    pattern: str = EMOJI_PATTERN,
    exact: bool = False,
) -> DataFrame:
    """Drop examples whose ``text + context`` is noise; then drop an
    example iff its context equals the context of the last *kept* example of
    the same text. After noise removal that is the previous row of the same
    text (a rejected row repeats the last kept context), so contexts A, B, A
    are all kept. ``exact=True`` instead keeps only the first example of each
    (text, context) pair."""
    partition = list(partition)
    clean = examples.where(~is_noise(F.concat(F.col("text"), F.col("context")), ratio, pattern))
    if exact:
        return _first_rows(clean, partition, ["text", "context"], order)
    names = [c for c, _ in order]
    key = list(dict.fromkeys([*partition, *names]))
    # examples are built twice and never written: the scan sees 32-byte digests
    narrow = pin(clean.select(*key, _digest("text").alias("_t"), _digest("context").alias("_c")), "dedup-keys")
    scanned = ordered_scan(narrow, [*partition, "_t"], list(order), prev=["_c", *names], seq_col="_seq", size_col="_n")
    later = F.col("_seq") > 0
    tie = later & reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}_prev")) for c in names])
    again = later & F.col("_c").eqNullSafe(F.col("_c_prev"))
    # rows are told apart by their order: without a total order none could be rejected alone
    checked = F.when(tie, F.raise_error(F.lit("examples of one text with equal order keys")).cast("boolean")).otherwise(again)
    rejected = scanned.where(checked).select(*[F.col(c).alias(f"_r_{c}") for c in key])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in key])
    return clean.join(rejected, same, "left_anti")
