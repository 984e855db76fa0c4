"""Helpers shared by the operators: text rules, let-binding, checked broadcasts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"  # fixed value: what separates white-space words
WORD = r"[^\x20\x09-\x0D]+"  # fixed value: a white-space word
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else (``lower`` alone would also fold other
    alphabets; for an all-ASCII text the two agree and ``lower`` is cheaper)."""
    is_ascii = F.length(text) == F.octet_length(text)
    return F.when(is_ascii, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def split_words(text: Column, separators: str = SPACE) -> Column:
    """Non-empty pieces between separators, in order (array<string>)."""
    return F.array_remove(F.split(text, separators), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in ``body``. A plain column
    alias would be inlined into higher-order functions and evaluated again
    for every element."""
    return F.transform(F.array(value), body)[0]


def crc_mod(col: str | Column, modulus: int) -> Column:
    """``crc32(value as text) mod modulus``; null counts as the empty text."""
    col = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % modulus


def broadcast_if(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """``df`` with a broadcast hint when its counted size allows it; otherwise
    unchanged, so the join is a shuffle join that adaptive execution may split."""
    return F.broadcast(df) if rows <= limit else df
