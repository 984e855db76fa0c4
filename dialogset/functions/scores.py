"""Score expressions (H4-H8) on ``array<double>`` logits/probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def softmax(logits) -> Column:
    """H4: numerically stable softmax."""
    x = _c(logits)
    m = F.array_max(x)
    ex = F.transform(x, lambda v: F.exp(v - m))
    total = F.aggregate(ex, F.lit(0.0), lambda a, v: a + v)
    return F.transform(ex, lambda v: v / total)


def sigmoid(logits) -> Column:
    """H5."""
    return F.transform(_c(logits), lambda v: F.lit(1.0) / (F.lit(1.0) + F.exp(-v)))


def threshold_nhot(probs, threshold: float = 0.5) -> Column:
    """H6: 1 where ``p >= threshold``."""
    return F.transform(_c(probs), lambda v: F.when(v >= threshold, 1).otherwise(0))


def threshold_class(probs, threshold: float = 0.5) -> Column:
    """H7: first index with ``p >= threshold``, else 0."""
    hit = F.array_position(F.transform(_c(probs), lambda v: v >= threshold), True)
    return F.greatest(hit - 1, F.lit(0)).cast("int")


def argmax(probs) -> Column:
    """H8: index of the maximum, first of ties."""
    p = _c(probs)
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")
