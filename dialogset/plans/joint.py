"""K3: one logistic regression per label position, fitted together.

Tokens are hashed in the JVM; the rows' (feature, weight) pairs are counted,
weighted and pinned once. Every label has an L-BFGS search of its own on the driver, but
all searches advance in step: one pass over the rows evaluates the loss and
the gradient of every label still searching, at that label's own next point.
Passes therefore number as many as the slowest label needs, not the sum, and
each label ends where it would alone. A pass sums its gradients by feature
(combined in each task before the exchange); the driver holds vectors of at
most ``num_features`` entries per label, its history ``HISTORY`` times that."""

from __future__ import annotations

from collections.abc import Generator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialogset.functions.text import tokens
from dialogset.session import pin, ship_package

HISTORY = 10
SEARCH_STEPS = 30


@dataclass
class JointModel:
    """``idf`` per used feature, weights (feature, label) and intercepts;
    ``used`` maps a hashed feature to its place."""

    num_features: int
    used: dict[int, int]
    idf: np.ndarray
    weights: np.ndarray
    intercepts: np.ndarray
    passes: int = 0


def token_features(text: str, num_features: int):
    """The hashed tokens of a text, repeats included (null text: none)."""
    found = F.coalesce(tokens(F.lower(F.col(text))), F.array().cast("array<string>"))
    return F.transform(found, lambda t: F.pmod(F.xxhash64(t), F.lit(num_features)).cast("int"))


def _places(used: dict[int, int], num_features: int) -> np.ndarray:
    """The place of every hashed feature, -1 for unknown ones."""
    out = np.full(num_features, -1, np.int64)
    out[np.fromiter(used.keys(), np.int64, len(used))] = np.fromiter(used.values(), np.int64, len(used))
    return out


def _weighted(ids: pa.Array, places: np.ndarray, idf: np.ndarray):
    """rows, places and tf-idf values of a batch; unknown features are left out."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(ids), 0))
    at = places[np.asarray(ids.flatten(), np.int64)]
    row = np.repeat(np.arange(len(ids), dtype=np.int64), sizes)
    key, tf = np.unique((row * max(len(idf), 1) + at)[at >= 0], return_counts=True)
    row, place = np.divmod(key, max(len(idf), 1))
    return row, place, tf * idf[place]


def _packed(values: np.ndarray, row: np.ndarray, n: int) -> pa.Array:
    """The values of each of ``n`` rows as bytes."""
    ends = np.searchsorted(row, np.arange(n + 1)) * values.itemsize
    held = values.tobytes()
    return pa.array([held[a:b] for a, b in zip(ends, ends[1:])], pa.binary())


def _unpacked(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """rows and values of a ``_packed`` column."""
    held = column.to_pylist()
    sizes = np.array([len(x) for x in held], np.int64) // np.dtype(kind).itemsize
    return np.repeat(np.arange(len(held)), sizes), np.frombuffer(b"".join(held), kind)


def _margins(row, place, value, n: int, weights: np.ndarray, intercepts: np.ndarray) -> np.ndarray:
    out = np.tile(intercepts, (n, 1))
    for j in range(weights.shape[1]):
        out[:, j] += np.bincount(row, value * np.ascontiguousarray(weights[:, j])[place], n)
    return out


def lbfgs(size: int, max_iter: int, tol: float) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """L-BFGS from zero: yields the points whose loss and gradient it wants,
    returns the last point. Step lengths meet the weak Wolfe conditions."""
    x = np.zeros(size)
    loss, grad = yield x
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(max_iter):
        if np.abs(grad).max(initial=0.0) <= tol:
            break
        d, back = -grad, []
        for s, y, rho in reversed(pairs):
            back.append(rho * (s @ d))
            d = d - back[-1] * y
        if pairs:
            s, y, _ = pairs[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y, rho), a in zip(pairs, reversed(back)):
            d = d + (a - rho * (y @ d)) * s
        slope = grad @ d
        step = 1.0 if pairs else min(1.0, 1.0 / np.linalg.norm(grad))
        low, high = 0.0, np.inf
        for _ in range(SEARCH_STEPS):
            new_loss, new_grad = yield x + step * d
            if new_loss > loss + 1e-4 * step * slope:
                high = step
            elif new_grad @ d < 0.9 * slope:
                low = step
            else:
                break
            step = (low + high) / 2 if high < np.inf else 2 * step
        if not new_loss < loss:
            break  # no further progress in doubles
        s, y = step * d, new_grad - grad
        if s @ y > 0:
            pairs = [*pairs, (s, y, 1 / (s @ y))][-HISTORY:]
        x, loss, grad = x + s, new_loss, new_grad
    return x


def fit_joint(train: DataFrame, width: int, text: str = "text", label: str = "multi", num_features: int = 1 << 18,
              max_iter: int = 50, tol: float = 1e-6, reg: float = 0.0) -> JointModel:
    """Mean logistic loss plus ``reg / 2`` times the squared weights (not the
    intercept), for each of ``width`` positions of ``label``. Labels that are
    null do not count for their position."""
    spark = train.sparkSession
    ship_package(spark)
    labels = F.array(*[F.get(F.col(label), i).cast("double") for i in range(width)])
    rows = pin(train.select(token_features(text, num_features).alias("ids"), labels.alias("y")), "joint-rows")
    n = rows.count()
    # at most num_features rows
    df = rows.select(F.explode(F.array_distinct("ids")).alias("f")).groupBy("f").count().collect()
    used = {f: j for j, f in enumerate(sorted(r.f for r in df))}
    idf = np.zeros(len(used))
    for r in df:
        idf[used[r.f]] = np.log((n + 1) / (r["count"] + 1))
    counts = rows.select(*[F.count(F.col("y")[j]).alias(f"n{j}") for j in range(width)]).first()
    size = len(used) + 1
    rows = _weighted_rows(rows, _places(used, num_features), idf)
    searches = {j: lbfgs(size, max_iter, tol) for j in range(width)}
    points = {j: next(s) for j, s in searches.items()}
    out = np.zeros((width, size))
    passes = 0
    while points:
        at = sorted(points)
        found = _evaluate(rows, np.stack([points[j] for j in at], 1), at)
        passes += 1
        for k, j in enumerate(at):
            m = max(int(counts[j]), 1)
            loss, grad = found[0][k] / m, found[1][:, k] / m
            x = points[j]
            loss += reg / 2 * float(x[:-1] @ x[:-1])
            grad = grad + reg * np.append(x[:-1], 0.0)
            try:
                points[j] = searches[j].send((loss, grad))
            except StopIteration as done:
                out[j] = done.value
                del points[j]
    return JointModel(num_features, used, idf, out[:, :-1].T, out[:, -1], passes)


def _weighted_rows(rows: DataFrame, places: np.ndarray, idf: np.ndarray) -> DataFrame:
    """``y`` and the packed places and tf-idf values of every row, pinned: the
    passes over them look nothing up and count no token again."""
    shared = rows.sparkSession.sparkContext.broadcast((places, idf))

    def run(batches):
        known, weights = shared.value
        for b in batches:
            row, place, value = _weighted(b.column(0), known, weights)
            packed = [_packed(x, row, b.num_rows) for x in (place.astype(np.int32), value)]
            yield pa.RecordBatch.from_arrays([b.column(1), *packed], ["y", "place", "value"])

    held = pin(rows.mapInArrow(run, "y array<double>, place binary, value binary"), "joint-weights")
    shared.destroy()
    return held


def _evaluate(rows: DataFrame, points: np.ndarray, at: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Summed losses (label) and gradients (feature and intercept, label), in one pass."""
    shared = rows.sparkSession.sparkContext.broadcast(points)
    width, size = len(at), len(points)

    def run(batches):
        x = shared.value
        grad, loss = np.zeros((width, size)), np.zeros(width)
        for b in batches:
            y = np.asarray(b.column(0).flatten().to_numpy(zero_copy_only=False), float).reshape(b.num_rows, -1)[:, at]
            row, place = _unpacked(b.column(1), np.int32)
            _, value = _unpacked(b.column(2), float)
            z = _margins(row, place, value, b.num_rows, x[:-1], x[-1])
            known = ~np.isnan(y)
            y = np.where(known, y, 0.0)
            loss += np.where(known, np.logaddexp(0, z) - y * z, 0.0).sum(0)
            g = np.where(known, 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y, 0.0)
            for j in range(width):
                grad[j, :-1] += np.bincount(place, value * np.ascontiguousarray(g[:, j])[row], size - 1)
            grad[:, -1] += g.sum(0)
        touched = np.flatnonzero(grad.any(0))
        columns = [np.append(grad[j, touched], loss[j]) for j in range(width)]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(touched, size)), *map(pa.array, columns)], ["f", *[f"g{j}" for j in range(width)]])

    schema = ", ".join(["f long", *[f"g{j} double" for j in range(width)]])
    sums = rows.mapInArrow(run, schema).groupBy("f").agg(*[F.sum(f"g{j}").alias(f"g{j}") for j in range(width)]).toPandas()
    shared.destroy()
    total = np.zeros((size + 1, width))
    total[sums["f"].to_numpy()] = sums.drop(columns="f").to_numpy()
    return total[size], total[:size]


def predict_joint(model: JointModel, df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``probs``: the probability of every label position."""
    spark = df.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    held = df.select(*keep, token_features(text, model.num_features).alias("_ids"))
    schema = T.StructType([*held.schema.fields[:-1], T.StructField("probs", T.ArrayType(T.DoubleType()))])

    def run(batches):
        m = shared.value
        places = _places(m.used, m.num_features)
        for b in batches:
            row, place, value = _weighted(b.column(b.num_columns - 1), places, m.idf)
            z = _margins(row, place, value, b.num_rows, m.weights, m.intercepts)
            p = pa.array(list(1 / (1 + np.exp(-np.clip(z, -500, 500)))), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], p], schema.names)

    return held.mapInArrow(run, schema)
