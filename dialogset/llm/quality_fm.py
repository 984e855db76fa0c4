"""Operator 11: quality classifier, a factorisation machine.

A text is a sparse vector ``x`` of hashed words (``HASHES`` buckets, damped
counts of length 1), ``STRUCTURE`` statistics of the whole text and numeric
``metadata`` columns, the latter two standardised over the sample. Its score is

    sigmoid(b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)

where the pairwise sum is taken in time linear in the entries of ``x``, as
half of ``sum_f (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2``.

``learn`` fits ``b``, ``w`` and ``v`` on a bounded sample of labelled rows:
the ``SAMPLE_DOCS`` rows per label with the least hashes of their id (evenly
from ``SAMPLE_PARTS`` parts of the hashes, limited per map task before the
shuffle, so no task ranks a whole label), each weighed so that both labels
count as often as in all training rows. Words are hashed inside tasks; at most
``2 * SAMPLE_DOCS`` sparse rows of at most ``HASHES`` entries (100 MB at the
very most) reach the driver, where numpy runs AdaGrad with a fixed seed. The
model (``HASHES`` times ``FACTORS`` numbers) goes to the tasks as a broadcast
variable; ``score`` is one pass over the rows without a shuffle. Inputs are
the text and the metadata columns only.

Edge cases: null text counts as empty, an empty text has no words and
statistics of 0 and is scored like any; null or non-finite metadata counts as
the sample's mean; labels other than 0 and 1 and rows of a null id are not
learned from; a repeated id is learned once per label, repeated rows are each
scored; with no training rows every score is 0.5, with one label only its share decides; an
empty table gives an empty result; other columns pass through ``score``
untouched, but one named like its output is replaced.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialogset.llm.common import crc_mod
from dialogset.session import ship_package

HASHES = 4096
FACTORS = 8
SAMPLE_DOCS = 2048
SAMPLE_PARTS = 16
EPOCHS = 20
BATCH = 128
RATE = 0.05
DECAY = 1e-4
HELD_OUT = (3, 1)  # modulus and remainder of the rows kept out of learning
STRUCTURE = (
    "log_words",
    "word_length",
    "symbols_per_word",
    "bars_per_word",
    "digits",
    "capitals",
    "punctuation",
    "other_alphabets",
    "lines_per_word",
    "repeated_lines",
    "different_words",
    "commonest_word",
    "log_line_length",
    "longest_word",
)
ROWS = 512  # texts turned into one sparse matrix at a time
_CLASSES = {
    "symbols": b"#*$%&|<>",
    "bars": b"|",
    "digits": b"0123456789",
    "capitals": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "punctuation": b".,;:!?",
    "other": bytes(range(128, 256)),
}


def structure(data: bytes, words: list[bytes], counts: Counter) -> list[float]:
    """The statistics of ``STRUCTURE`` of a text in UTF-8."""
    n, size = max(len(words), 1), max(len(data), 1)
    among = {k: len(data) - len(data.translate(None, c)) for k, c in _CLASSES.items()}
    lines = [x for x in data.split(b"\n") if x.strip()]
    return [
        math.log1p(len(words)),
        sum(map(len, words)) / n,
        among["symbols"] / n,
        among["bars"] / n,
        among["digits"] / size,
        among["capitals"] / size,
        among["punctuation"] / size,
        among["other"] / size,
        len(lines) / n,
        1 - len(set(lines)) / max(len(lines), 1),
        len(counts) / n,
        max(counts.values(), default=0) / n,
        math.log1p(len(data) / max(len(lines), 1)),
        math.log1p(max(map(len, words), default=0)),
    ]


def hashed(counts: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (ascending) and damped counts, of length 1."""
    if not counts:
        return np.zeros(0, np.int64), np.zeros(0)
    where = np.fromiter((crc32(w) % HASHES for w in counts), np.int64, len(counts))
    total = np.bincount(where, np.fromiter(counts.values(), np.float64, len(counts)), HASHES)
    at = np.flatnonzero(total)
    value = np.log1p(total[at])
    return at, value / math.sqrt(value @ value)


def entries(data: bytes | None) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Word buckets, their values and the structure of one text."""
    data = data or b""
    words = data.lower().split()  # bytes: A-Z only, white space of ASCII only
    counts = Counter(words)
    return (*hashed(counts), structure(data, words, counts))


@dataclass
class Matrix:
    """Rows of (index, value) entries, one after the other; no row is empty."""

    at: np.ndarray
    value: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, words: Sequence[tuple[np.ndarray, np.ndarray]], dense: np.ndarray) -> Matrix:
        columns = np.arange(HASHES, HASHES + dense.shape[1])
        at = [x for (i, _), _ in zip(words, dense) for x in (i, columns)]
        value = [x for (_, v), d in zip(words, dense) for x in (v, d)]
        sizes = np.array([len(i) + len(columns) for i, _ in words])
        return cls(np.concatenate(at).astype(np.int64), np.concatenate(value), np.cumsum(sizes) - sizes)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts)), np.diff(np.append(self.starts, len(self.at))))


@dataclass
class Machine:
    """The fitted model; ``mean`` and ``scale`` standardise the dense features."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def standard(self, dense: np.ndarray) -> np.ndarray:
        return np.clip(np.where(np.isfinite(dense), (dense - self.mean) / self.scale, 0.0), -4.0, 4.0)

    def raw(self, m: Matrix) -> tuple[np.ndarray, np.ndarray]:
        """The sums before the sigmoid, and ``sum_i v_i x_i`` of each row."""
        v = self.factors[m.at] * m.value[:, None]
        sums = np.add.reduceat(v, m.starts)
        squares = np.add.reduceat(v * v, m.starts)
        line = np.add.reduceat(self.linear[m.at] * m.value, m.starts)
        return self.bias + line + 0.5 * (sums * sums - squares).sum(1), sums

    def probability(self, words, dense: np.ndarray) -> np.ndarray:
        return _sigmoid(self.raw(Matrix.of(words, self.standard(dense)))[0])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def gradient(model: Machine, m: Matrix, label: np.ndarray, weight: np.ndarray):
    """Of the weighted mean logistic loss: by bias, linear part and factors."""
    raw, sums = model.raw(m)
    g = weight * (_sigmoid(raw) - label) / weight.sum()
    rows = m.rows()
    gx = g[rows] * m.value
    linear = np.bincount(m.at, gx, len(model.linear))
    each = gx[:, None] * (sums[rows] - model.factors[m.at] * m.value[:, None])
    k = model.factors.shape[1]
    flat = (m.at[:, None] * k + np.arange(k)).ravel()
    return g.sum(), linear, np.bincount(flat, each.ravel(), model.factors.size).reshape(model.factors.shape)


def fit(words, dense: np.ndarray, label: np.ndarray, weight: np.ndarray, width: int, seed: int = 0) -> Machine:
    """AdaGrad over mini-batches; the same rows in the same order give the same model."""
    rng = np.random.default_rng(seed)
    n = len(label)
    known = np.isfinite(dense)
    mean = np.array([dense[k, j].mean() if (k := known[:, j]).any() else 0.0 for j in range(width)])
    scale = np.array([dense[k, j].std() if (k := known[:, j]).any() else 1.0 for j in range(width)])
    model = Machine(0.0, np.zeros(HASHES + width), rng.normal(0, 0.01, (HASHES + width, FACTORS)), mean, np.where(scale > 1e-9, scale, 1.0))
    if not n:
        model.factors[:] = 0
        return model
    share = (weight @ label) / weight.sum()
    model.bias = math.log((share + 1e-3) / (1 - share + 1e-3))
    if share in (0.0, 1.0):
        model.factors[:] = 0
        return model
    dense = model.standard(dense)
    seen = [np.full_like(x, 1e-8) for x in (np.zeros(1), model.linear, model.factors)]
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for s in range(0, n, BATCH):
            rows = order[s : s + BATCH]
            m = Matrix.of([words[i] for i in rows], dense[rows])
            gb, gl, gf = gradient(model, m, label[rows], weight[rows])
            touched = gl != 0
            gl += DECAY * model.linear * touched
            gf += DECAY * model.factors * touched[:, None]
            for acc, x in zip(seen, (gb, gl, gf)):
                acc += x * x
            model.bias -= RATE * gb / math.sqrt(seen[0][0])
            model.linear -= RATE * gl / np.sqrt(seen[1])
            model.factors -= RATE * gf / np.sqrt(seen[2])
    return model


def sample(docs: DataFrame, labels: DataFrame, metadata: Sequence[str], sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """label, text and metadata of the chosen labelled rows."""
    modulus, rest = HELD_OUT
    train = labels.where((crc_mod("doc_id", modulus) != rest) & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    train = train.select("doc_id", F.col("quality").alias("_label"), F.xxhash64(F.col("doc_id").cast("string")).alias("_h")).distinct()
    parts = min(SAMPLE_PARTS, sample_docs)
    rank = F.row_number().over(Window.partitionBy("_label", F.pmod("_h", F.lit(parts))).orderBy("_h", "doc_id"))
    chosen = train.withColumn("_rank", rank).where(F.col("_rank") <= sample_docs // parts)
    # at most 2 * sample_docs narrow rows
    joined = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"), *[F.col(c).cast("double").alias(f"_m{i}") for i, c in enumerate(metadata)]).join(
        F.broadcast(chosen.select("doc_id", "_label", "_h")), "doc_id"
    )
    first = F.row_number().over(Window.partitionBy("doc_id", "_label").orderBy(F.xxhash64("_text"), *[f"_m{i}" for i in range(len(metadata))]))
    return joined.withColumn("_first", first).where(F.col("_first") == 1).select("_label", "_h", "doc_id", *[f"_m{i}" for i in range(len(metadata))], "_text")


def learn(docs: DataFrame, labels: DataFrame, metadata: Sequence[str] = ("n_chars",), sample_docs: int = SAMPLE_DOCS) -> Machine:
    """A machine fitted on labelled rows (``labels``: doc_id, quality)."""
    ship_package(docs.sparkSession)
    modulus, rest = HELD_OUT
    width = len(STRUCTURE) + len(metadata)
    schema = "label int, h long, doc_id string, at array<int>, value array<float>, dense array<double>"

    def extract(batches):
        for b in batches:
            found = [entries(t) for t in b.column(b.num_columns - 1).cast(pa.binary()).to_pylist()]
            meta = [b.column(3 + i).to_pylist() for i in range(len(metadata))]
            dense = [[*d, *[m[r] for m in meta]] for r, (_, _, d) in enumerate(found)]
            columns = [
                b.column(0).cast(pa.int32()),
                b.column(1),
                b.column(2).cast(pa.string()),
                pa.array([i.astype(np.int32) for i, _, _ in found], pa.list_(pa.int32())),
                pa.array([v.astype(np.float32) for _, v, _ in found], pa.list_(pa.float32())),
                pa.array(dense, pa.list_(pa.float64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["label", "h", "doc_id", "at", "value", "dense"])

    chosen = sample(docs, labels, metadata, sample_docs).withColumn("doc_id", F.col("doc_id").cast("string"))
    rows = sorted(chosen.mapInArrow(extract, schema).collect(), key=lambda r: (r.h, r.doc_id, r.label))
    counted = labels.where((crc_mod("doc_id", modulus) != rest) & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    counts = {r[0]: r[1] for r in counted.groupBy("quality").count().collect()}  # two rows
    taken = Counter(r.label for r in rows)
    label = np.array([r.label for r in rows], float)
    weight = np.array([counts[r.label] / taken[r.label] for r in rows], float)
    dense = np.array([[np.nan if x is None else x for x in r.dense] for r in rows], float).reshape(-1, width)
    dense[:, len(STRUCTURE) :] = _damped(dense[:, len(STRUCTURE) :])
    words = [(np.array(r.at, np.int64), np.array(r.value, float)) for r in rows]
    return fit(words, dense, label, weight, width)


def _damped(meta: np.ndarray) -> np.ndarray:
    return np.sign(meta) * np.log1p(np.abs(meta))


def score(docs: DataFrame, model: Machine, metadata: Sequence[str] = ("n_chars",), out: str = "quality_score") -> DataFrame:
    """``docs`` plus a double column ``out``: the probability of label 1."""
    docs = docs.drop(out)
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])
    at = docs.columns.index("text")
    meta_at = [docs.columns.index(c) for c in metadata]

    def run(batches):
        machine = shared.value
        for batch in batches:
            for s in range(0, batch.num_rows, ROWS):
                b = batch.slice(s, ROWS)
                found = [entries(t) for t in b.column(at).cast(pa.binary()).to_pylist()]
                meta = [pc.cast(b.column(i), pa.float64(), safe=False).to_numpy(zero_copy_only=False) for i in meta_at]
                dense = np.array([d for _, _, d in found]).reshape(b.num_rows, -1)
                if meta:
                    dense = np.column_stack([dense, _damped(np.column_stack(meta))])
                p = machine.probability([(i, v) for i, v, _ in found], dense)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], schema.names)

    return docs.mapInArrow(run, schema)
