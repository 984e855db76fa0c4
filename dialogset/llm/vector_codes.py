"""Operator 12: vector code compression (product quantisation) over
Hilbert-sorted flat blocks.

Every vector becomes integers ``floor(scale * x)`` and is cut into ``PARTS``
equal parts; each part position has a codebook of ``ENTRIES`` entries, begun
with that part of the vectors of the least ids and moved ``ROUNDS`` times to
the floor of the mean of the parts assigned to it.

The parts of a position are sorted by a Hilbert key (a range exchange on
position, key and row number, so equal vectors spread over tasks too) and cut
into flat blocks of at most ``BLOCK`` neighbours. A block stores its points
in one binary value, the least and greatest value of each component (its box)
and the sums of the components. In a round, the squared distances of all entries to
the box from below and above leave a shortlist: an entry whose nearest point
of the box is farther than the farthest point of another is never nearest,
not even on a tie. A block with one entry left adds its stored sums unseen; the
others compare their points with their shortlist in 64-bit integers. Only
sums and counts per entry (``PARTS * ENTRIES`` rows) leave the tasks; the
blocks are written once and read each round, so a lost executor costs the
tasks of one round.

Distances are exact: components of which a squared distance would not fit in
64 bits stop the job with an error (from about 2 ** 29 for eight components
a part).

Edge cases: rows whose vector is null, empty or holds a null or non-finite
component are left out; kept vectors must agree in length, a multiple of
``PARTS`` (else an error); a null id comes after all others; rows repeating an id are
coded each (the codebook begins with the least by id, then vector); with
fewer than ``ENTRIES`` rows the codebook is that much smaller; null labels
are one label; an empty table gives an empty result and empty codebooks. Only
id, vector and label are read: other columns, whatever their names, are not returned.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogset.session import pin, ship_package

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
BLOCK = 256
KEY_BITS = 63
BROADCAST_LABELS = 100_000
SALTS = 16


@dataclass
class Codebooks:
    """``entries[part]``: an integer matrix, one row an entry."""

    entries: list[np.ndarray]

    def text(self) -> str:
        return ",".join(str(int(x)) for part in self.entries for row in part for x in row)

    def sha256(self) -> str:
        return hashlib.sha256(self.text().encode()).hexdigest()


def integers(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def kept_rows(vectors: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """vec_id, label and the integer vector of rows that can be coded."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    fine = F.coalesce((F.size(vector) > 0) & ~F.exists(vector, bad), F.lit(False))
    return vectors.where(fine).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), integers(F.col(vector)).alias("q"))


def hilbert_keys(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Place of every point on a Hilbert curve over the box from ``low`` to
    ``high``. The axes of a point are untangled from the finest bit up
    (exchanges and inversions of the lower bits), Gray-decoded and interleaved."""
    p = points.shape[1]
    used = min(p, KEY_BITS)
    bits = max(1, KEY_BITS // used)
    span = np.maximum(high - low, 1)[:used]
    cells = (points[:, :used] - low[:used]).astype(np.float64) / span * ((1 << bits) - 1)
    x = np.clip(cells, 0, (1 << bits) - 1).astype(np.int64).T.copy()
    q = 1 << (bits - 1)
    while q > 1:
        below = q - 1
        for i in range(used):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(on, below, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, used):
        x[i] ^= x[i - 1]
    flip = np.zeros(points.shape[0], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[used - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros(points.shape[0], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(used):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def box_distances(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest squared distance of entries (E, p) from boxes (B, p)."""
    e = entries[None, :, :]
    below, above = low[:, None, :] - e, e - high[:, None, :]
    near = np.maximum(np.maximum(below, above), 0)
    far = np.maximum(np.abs(below), np.abs(above))
    return (near * near).sum(2), (far * far).sum(2)


def shortlists(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """(B, E): whether an entry may be nearest to a point of the box."""
    near, far = box_distances(low, high, entries)
    return near <= far.min(1, keepdims=True)


def nearest(points: np.ndarray, entries: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of ``among`` (ascending; ties to the lower)
    and its squared distance, in integers."""
    d = points[:, None, :] - entries[None, among, :]
    d = np.einsum("ijk,ijk->ij", d, d)
    best = d.argmin(1)
    return among[best], d[np.arange(len(points)), best]


def _blocks(parts_table: DataFrame, width: int, bounds: list[tuple[list[int], list[int]]], kind: str) -> DataFrame:
    """part, ids, labels, points, low, high, sums: the flat blocks of all positions."""
    low = [np.array(a, np.int64) for a, _ in bounds]
    high = [np.array(b, np.int64) for _, b in bounds]

    def split(batches):
        for b in batches:
            if not b.num_rows:
                continue
            q = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
            for k in range(PARTS):
                points = np.ascontiguousarray(q[:, k * width : (k + 1) * width])
                key = hilbert_keys(points, low[k], high[k])
                packed = np.ascontiguousarray(points.astype(kind))
                size = packed.itemsize * width
                offsets = pa.py_buffer(np.arange(0, (b.num_rows + 1) * size, size, dtype=np.int32))
                data = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, offsets, pa.py_buffer(packed)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(b.num_rows, k, np.int32)), b.column(0), pa.array(key), data], ["part", "rid", "key", "point"]
                )

    def cut(batches):
        def block(part, rid, point):
            m = np.frombuffer(b"".join(point), kind).reshape(-1, width).astype(np.int64)
            return part, rid, b"".join(point), m.min(0), m.max(0), m.sum(0)

        def emit(rows):
            part, ids, point, lo, hi, sums = zip(*rows)
            longs = pa.list_(pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(ids, longs), pa.array(point, pa.binary()), pa.array(lo, longs), pa.array(hi, longs), pa.array(sums, longs)],
                ["part", "rids", "points", "low", "high", "sums"],
            )

        now, rid, point, out = None, [], [], []
        for b in batches:
            for p, i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if rid and (p != now or len(rid) == BLOCK):
                    out.append(block(now, rid, point))
                    rid, point = [], []
                now = p
                rid.append(i)
                point.append(x)
            if len(out) >= 64:
                yield emit(out)
                out = []
        if rid:
            out.append(block(now, rid, point))
        if out:
            yield emit(out)

    keyed = parts_table.mapInArrow(split, "part int, rid long, key long, point binary")
    # the row number parts equal keys
    ordered = keyed.repartitionByRange("part", "key", "rid").sortWithinPartitions("part", "key", "rid").select("part", "rid", "point")
    return ordered.mapInArrow(cut, "part int, rids array<long>, points binary, low array<long>, high array<long>, sums array<long>")


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(rows, -1)


def _round(blocks: DataFrame, books: Codebooks, width: int, kind: str) -> list:
    """part, entry, count and component sums of the parts assigned to each entry."""
    shared = blocks.sparkSession.sparkContext.broadcast(books.entries)

    def run(batches):
        entries = shared.value
        size = max(len(e) for e in entries)
        sums = np.zeros((PARTS, size, width), np.int64)
        count = np.zeros((PARTS, size), np.int64)
        for b in batches:
            part = b.column(0).to_numpy()
            points = b.column(1)
            low, high, total = (_matrix(b.column(i), b.num_rows) for i in (2, 3, 4))
            for k in np.unique(part):
                at = np.flatnonzero(part == k)
                lists = shortlists(low[at], high[at], entries[k])
                alone = lists.sum(1) == 1
                for i, chosen, one in zip(at, lists, alone):
                    among = np.flatnonzero(chosen)
                    raw = points[int(i)].as_buffer()
                    if one:
                        sums[k, among[0]] += total[i]
                        count[k, among[0]] += raw.size // (np.dtype(kind).itemsize * width)
                        continue
                    m = np.frombuffer(raw, kind).reshape(-1, width).astype(np.int64)
                    code, _ = nearest(m, entries[k], among)
                    np.add.at(sums[k], code, m)
                    count[k] += np.bincount(code, minlength=size)
        k, e = np.nonzero(count)
        if len(k):
            yield pa.RecordBatch.from_arrays(
                [pa.array(k.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[k, e]), pa.array(list(sums[k, e]), pa.list_(pa.int64()))],
                ["part", "entry", "n", "sums"],
            )

    found = blocks.select("part", "points", "low", "high", "sums").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    totals = [F.sum(F.col("sums")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(width)]
    return found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *totals).collect()  # PARTS * ENTRIES rows


def _coded(blocks: DataFrame, books: Codebooks, width: int, kind: str) -> DataFrame:
    """rid, part, code, dist of every part."""
    shared = blocks.sparkSession.sparkContext.broadcast(books.entries)

    def run(batches):
        entries = shared.value
        for b in batches:
            part = b.column(0).to_numpy()
            low, high = (_matrix(b.column(i), b.num_rows) for i in (3, 4))
            for i in range(b.num_rows):
                k = int(part[i])
                among = np.flatnonzero(shortlists(low[i : i + 1], high[i : i + 1], entries[k])[0])
                m = np.frombuffer(b.column(2)[i].as_buffer(), kind).reshape(-1, width).astype(np.int64)
                code, dist = nearest(m, entries[k], among)
                ids = b.column(1)[i].values
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.full(len(code), k, np.int32)), pa.array(code.astype(np.int32)), pa.array(dist)], ["rid", "part", "code", "dist"]
                )

    return blocks.select("part", "rids", "points", "low", "high").mapInArrow(run, "rid long, part int, code int, dist long")


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` plus label_error, the error summed over equal labels. A few
    labels are broadcast; of many, each total meets its rows in ``SALTS`` parts."""
    totals = pin(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "code-labels")
    same = F.col("label").eqNullSafe(F.col("_label"))
    if totals.count() <= BROADCAST_LABELS:
        return coded.join(F.broadcast(totals), same).drop("_label")
    salted = totals.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = coded.withColumn("_d", F.pmod(F.xxhash64("codes", "error", "vec_id"), F.lit(SALTS)).cast("int"))
    return rows.join(salted, same & (F.col("_d") == F.col("_s"))).drop("_label", "_d", "_s")


def compress(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS
) -> tuple[DataFrame, Codebooks]:
    """vec_id, label, codes (array<int>), error, label_error of the kept rows,
    and the final codebooks."""
    spark = vectors.sparkSession
    ship_package(spark)
    # row numbers must not change between reads
    rows = pin(kept_rows(vectors, vec_id, vector, label).withColumn("rid", F.monotonically_increasing_id()), "code-vectors")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(ENTRIES).select("q").collect()
    if not first:
        empty = rows.select("vec_id", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error"))
        return empty.withColumn("label_error", F.lit(0).cast("long")), Codebooks([np.zeros((0, 0), np.int64) for _ in range(PARTS)])
    length = len(first[0].q)
    stats = rows.agg(F.min(F.size("q")).alias("a"), F.max(F.size("q")).alias("b")).first()
    if stats.a != stats.b or length % PARTS:
        raise ValueError(f"vectors of {stats.a} to {stats.b} components: not one multiple of {PARTS}")
    width = length // PARTS
    component = [F.col("q")[j] for j in range(length)]
    ends = rows.agg(*[F.min(c).alias(f"a{j}") for j, c in enumerate(component)], *[F.max(c).alias(f"b{j}") for j, c in enumerate(component)]).first()
    low, high = list(ends[:length]), list(ends[length:])
    if (max(high) - min(low)) ** 2 * width >= 2**63:
        raise ValueError("components too far apart for exact distances in 64 bits")
    kind = next(k for k in ("<i2", "<i4", "<i8") if np.iinfo(k).min <= min(low) and max(high) <= np.iinfo(k).max)
    bounds = [(low[k * width : (k + 1) * width], high[k * width : (k + 1) * width]) for k in range(PARTS)]
    start = np.array([r.q for r in first], np.int64)
    books = Codebooks([start[:, k * width : (k + 1) * width].copy() for k in range(PARTS)])
    blocks = pin(_blocks(rows.select("rid", "q"), width, bounds, kind), "code-blocks")
    for _ in range(rounds):
        for r in _round(blocks, books, width, kind):
            books.entries[r.part][r.entry] = [int(r[f"s{j}"]) // r.n for j in range(width)]
    final = _coded(blocks, books, width, kind)
    by_part = F.transform(F.array_sort(F.collect_list(F.struct("part", "code"))), lambda x: x["code"])  # PARTS entries
    coded = final.groupBy("rid").agg(by_part.alias("codes"), F.sum("dist").alias("error"))
    coded = pin(rows.select("rid", "vec_id", "label").join(coded, "rid").drop("rid"), "codes")
    return with_label_error(coded), books
