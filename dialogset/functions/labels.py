"""Label expressions.

All builders return JVM-side Column expressions (higher-order functions on
arrays), so they stay inside whole-stage code generation.

An n-hot label is ``array<int>``; ``[1,0,0,0,0,0]`` is class 0, which is
exclusive with all others. An utterance is *positive* when ``label[0] != 1``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def utterance_positive(label) -> Column:
    """1 if the utterance carries any class but 0 (``label[0] != 1``), else 0."""
    return F.when(_c(label)[0] == 1, 0).otherwise(1)


def window_coarse(labels) -> Column:
    """A2: 0 iff every utterance of the window has ``label[0] == 1``."""
    labels = _c(labels)
    zero_count = F.aggregate(labels, F.lit(0), lambda acc, l: acc + l[0])
    return F.when(zero_count == F.size(labels), 0).otherwise(1)


def window_multi(labels) -> Column:
    """A3: class-0 one-hot if the window is all class 0; otherwise the
    element-wise OR over positions > 0 (position 0 forced to 0). The vector
    length is that of the first label."""
    labels = _c(labels)
    positions = F.transform(labels[0], lambda _x, i: i)
    zero_count = F.aggregate(labels, F.lit(0), lambda acc, l: acc + l[0])
    all_zero = zero_count == F.size(labels)
    one_hot0 = F.transform(positions, lambda i: F.when(i == 0, 1).otherwise(0))
    union = F.transform(
        positions, lambda i: F.when((i > 0) & F.exists(labels, lambda l: F.get(l, i) > 0), 1).otherwise(0)
    )
    return F.when(all_zero, one_hot0).otherwise(union)


def seq_coarse(labels) -> Column:
    """A4: per-utterance coarse labels of a window."""
    return F.transform(_c(labels), lambda l: F.when(l[0] == 1, 0).otherwise(1))


def target_coarse(label) -> Column:
    """A5: coarse label of the target alone (two-sided examples)."""
    return F.when(_c(label)[0] == 1, 0).otherwise(1)


def active_indices(vec) -> Column:
    """H9: positions whose value equals 1."""
    marked = F.transform(_c(vec), lambda x, i: F.when(x == 1, i))
    return F.filter(marked, lambda i: i.isNotNull())


def any_label_above_zero(vec) -> Column:
    """1 if an active position other than 0 exists (sum of active
    indices > 0), else 0."""
    return F.when(F.exists(active_indices(vec), lambda i: i > 0), 1).otherwise(0)


def nhot_to_coarse(label, strict: bool = True) -> Column:
    """0 if ``label[0] == 1``; 1 if any later position is set; otherwise
    an error (``strict``) or NULL (lenient; route such rows to quarantine)."""
    label = _c(label)
    rest = F.aggregate(F.slice(label, 2, F.greatest(F.size(label) - 1, F.lit(0))), F.lit(0), lambda a, x: a + x)
    invalid = F.raise_error(F.concat(F.lit("invalid n-hot label: "), F.to_json(label))) if strict else F.lit(None)
    return F.when(label[0] == 1, F.lit(0)).when(rest > 0, F.lit(1)).otherwise(invalid.cast("int"))


def clamp_label(x, max_excl) -> Column:
    """A label at or above the bound becomes 0."""
    x = _c(x)
    return F.when(x >= max_excl, F.lit(0)).otherwise(x)


def two_annotators(x, y, min_incl: int, max_excl: int) -> Column:
    """The distinct values of both, clamped."""
    return (
        F.array_distinct(F.array(clamp_label(x, max_excl), clamp_label(y, max_excl)))
    )


def keep_below(gs, max_excl) -> Column:
    """Gold labels below the upper bound, order and repeats kept."""
    return F.filter(_c(gs), lambda g: g < max_excl)


def merge_gold(l1, l2, gs, is_checked_sup, min_incl: int, max_excl: int) -> Column:
    """Gold labels if any remain below the bound; else ``[min]`` when a
    supervisor checked the item; else equal clamped labels give that one, and
    others those above ``min``, in order."""
    c1, c2 = clamp_label(l1, max_excl), clamp_label(l2, max_excl)
    gold = keep_below(gs, max_excl)
    above = F.filter(F.array(c1, c2), lambda v: v > min_incl)
    return (
        F.when(F.size(gold) > 0, gold)
        .when(_c(is_checked_sup), F.array(F.lit(min_incl)))
        .when(c1 == c2, F.array(c1))
        .otherwise(above)
    )


def zip_shortest(*arrays) -> Column:
    """Zip arrays into structs ``f0, f1, ...``, cut to the shortest
    (``arrays_zip`` alone pads with NULL)."""
    cols = [_c(a) for a in arrays]
    n = F.least(*[F.size(c) for c in cols])
    names = [f"f{i}" for i in range(len(cols))]
    return F.transform(
        F.slice(cols[0], 1, n),
        lambda x, i: F.struct(x.alias(names[0]), *[F.get(c, i).alias(nm) for c, nm in zip(cols[1:], names[1:])]),
    )


def window_certain(a1, a2, is_decided) -> Column:
    """False iff some position of the (shortest) zip differs between the
    annotators and is explicitly not decided (``False``; NULL counts as decided)."""
    z = zip_shortest(a1, a2, is_decided)
    return F.forall(z, lambda e: e["f0"].eqNullSafe(e["f1"]) | ~e["f2"].eqNullSafe(F.lit(False)))


def to_nhot(labels, width: int = 6) -> Column:
    """Label list -> n-hot vector of ``width`` positions."""
    labels = _c(labels)
    return F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.when(F.array_contains(labels, i), 1).otherwise(0)
    )
