"""Operator 13: ranked lexical search with norm buckets (after LEMP).

Terms are the maximal runs of ASCII letters and digits and of all characters
beyond ASCII; only A-Z are lower-cased. A document's score for an item is the
inner product of the item's term weights ``w`` with the document's impacts
``x = (10^9 tf) div (1000 tf + 8 m)``, so the search is one for the largest
inner products:

* one pass over the texts keeps, of every document, its length and the
  counts of the items' terms (the texts are not read again); ``N``, ``L`` and
  ``df`` are counted over all of them;
* a task cuts its documents' vectors, ``CHUNK_ENTRIES`` entries at a time,
  into buckets of ``BUCKET`` vectors in falling order of length;
* an item whose length times a bucket's greatest length cannot reach the
  item's ``k``-th best score so far skips the bucket (Cauchy-Schwarz);
* inside, the coordinates of the item's heaviest terms (its focus) are taken
  exactly; what the others can add is bounded by Cauchy-Schwarz over the rest
  of both vectors and by the greatest value of each coordinate in the bucket:
  a pair of item and document that cannot reach the ``k``-th best score is filtered;
* the survivors are scored exactly in 64-bit integers.

Bounds are widened by ``SLACK`` against rounding, and only a bound strictly
below the ``k``-th score prunes, so ties are kept. Each task returns its best
``k`` per item, and the best of these are the result: a score never depends
on how rows are dealt, and no exchange carries vectors. A vector's
coordinate is ``w^(1 - TILT) x`` and an item's ``w^TILT``; every ``TILT`` has the same
products, and a low one makes vectors without rare terms short.

Items are a stated query set: they are taken in blocks of at most
``BLOCK_TERMS`` terms (or one item), and each block's terms (the only thing broadcast)
are searched for in all documents. Items come to the driver one by one.

Edge cases: null text has no terms; an item without a known term has no
result; a null id is ranked before others of its score; repeated documents
are ranked each; repeated items are answered each; fewer than ``k`` documents with a
score above 0 give fewer rows; empty tables give an empty result. Of the
documents only ``doc_id`` and ``text`` are read and of the items ``item_id`` and ``text``: other
columns, whatever their names, are not returned.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dialogset.llm.common import text_or_empty
from dialogset.session import pin, ship_package

TOP = 10
BUCKET = 512
BUCKET_PAIRS = 2_000_000  # of items and documents; smaller buckets for very many items
CHUNK_ENTRIES = 2_000_000
FOCUS = 0.1  # an item's focus: its heaviest terms, until the others have at most this share of its weight
TILT = 0.0
SLACK = 1 + 1e-9
BLOCK_TERMS = 200_000
MAX_PAIRS = 4_000_000  # item and document entries expanded at a time
LEAST = np.iinfo(np.int64).min  # stands for a null id, which comes first

# one byte for each: A-Z to a-z, and a blank for what parts terms
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)


def terms(data: bytes) -> list[bytes]:
    """The terms of a text in UTF-8 (every byte of a character beyond ASCII is
    at least 0x80, so single bytes decide)."""
    return data.translate(_FOLD).split()


def count_terms(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n, terms, counts: of every document with a term its number of
    terms and how often each term of ``vocabulary`` occurs."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        known = shared.value
        for b in batches:
            n, at, tf = [], [], []
            for data in b.column(1).cast(pa.binary()):
                words = terms(data.as_py())
                found = [(known[w], c) for w, c in Counter(words).items() if w in known]
                n.append(len(words))
                at.append([i for i, _ in found])
                tf.append([c for _, c in found])
            ints = pa.list_(pa.int32())
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(at, ints), pa.array(tf, ints)], ["doc_id", "n", "terms", "counts"])
            yield out.filter(pa.array([x > 0 for x in n], pa.bool_()))

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<int>")


class Items:
    """The items of a block as columns: the weights of all terms, the items
    that hold each, and apart those that have it in focus or outside."""

    def __init__(self, held: list[list[int]], weight: np.ndarray, focus: float = FOCUS, tilt: float = TILT):
        self.n = len(held)
        self.weight = weight
        w = np.maximum(weight, 1).astype(float)  # a term of weight 0 adds nothing; 1 only widens bounds
        self.scale = w ** (1 - tilt)
        focal = []
        for i, ts in enumerate(held):
            left, total = weight[ts].sum(), weight[ts].sum()
            for t in sorted(ts, key=lambda t: (-weight[t], t)):
                if left <= focus * total:
                    break
                focal.append((t, i))
                left -= weight[t]
        pairs = sorted((t, i) for i, ts in enumerate(held) for t in ts)
        heavy = set(focal)
        self.first, self.item, term = self._columns(pairs)
        self.focus_first, self.focus_item, _ = self._columns(sorted(focal))
        self.rest_first, self.rest_item, rest = self._columns([p for p in pairs if p not in heavy])
        self.length = np.sqrt(np.bincount(self.item, w[term] ** (2 * tilt), self.n))
        self.rest = np.sqrt(np.bincount(self.rest_item, w[rest] ** (2 * tilt), self.n))
        self.rest_term = rest

    def _columns(self, pairs: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each term's pairs begin, and the items and terms of the pairs."""
        term = np.array([t for t, _ in pairs], np.int64)
        return np.searchsorted(term, np.arange(len(self.weight) + 1)), np.array([i for _, i in pairs], np.int64), term


class Best:
    """The best ``k`` scores above 0 of every item so far, ties by least id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.zeros((n, k), np.int64)  # 0: free
        self.doc = np.full((n, k), np.iinfo(np.int64).max)

    def least(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        good = (score > 0) & (score >= self.least()[item])
        item, doc, score = item[good], doc[good], score[good]
        if not len(item):
            return
        touched = np.unique(item)
        item = np.concatenate([item, np.repeat(touched, self.k)])
        doc = np.concatenate([doc, self.doc[touched].ravel()])
        score = np.concatenate([score, self.score[touched].ravel()])
        order = np.lexsort((doc, -score, item))
        item, doc, score = item[order], doc[order], score[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        keep = place < self.k
        self.doc[item[keep], place[keep]] = doc[keep]
        self.score[item[keep], place[keep]] = score[keep]


def _expand(row: np.ndarray, term: np.ndarray, value: np.ndarray, first: np.ndarray, items: np.ndarray):
    """(row, item, value) for every entry and every item that holds its term."""
    n = first[term + 1] - first[term]
    total = int(n.sum())
    ahead = np.cumsum(n) - n
    at = np.arange(total) - np.repeat(ahead, n) + np.repeat(first[term], n)
    return np.repeat(row, n), items[at], np.repeat(value, n)


def search_bucket(doc, starts, term, impact, length, items: Items, best: Best) -> int:
    """Search one bucket: vectors of falling ``length``; rows of entries begin
    at ``starts``. Returns the number of pairs scored exactly."""
    n = len(doc)
    sizes = np.diff(np.append(starts, len(term)))
    row = np.repeat(np.arange(n), sizes)
    bar = best.least().astype(float)
    open_ = (items.length * length[0] * SLACK >= bar) & (items.length > 0)
    if not open_.any():
        return 0
    value = items.weight[term] * impact
    # focus coordinates: exact part of the product, and their share of the vector's length
    r, i, e = _expand(row, term, np.arange(len(term)), items.focus_first, items.focus_item)
    cell = r * items.n + i
    part = np.bincount(cell, value[e], n * items.n).reshape(n, items.n)
    inside = np.bincount(cell, ((items.scale[term] * impact) ** 2)[e], n * items.n).reshape(n, items.n)
    left = np.sqrt(np.maximum(length[:, None] ** 2 * SLACK - inside, 0))
    greatest = np.zeros(len(items.weight), np.int64)
    np.maximum.at(greatest, term, value)
    most = np.bincount(items.rest_item, greatest[items.rest_term], items.n)
    alive = open_ & ((part + np.minimum(items.rest * left, most)) * SLACK + 1 >= bar)
    if not alive.any():
        return 0
    score = np.zeros(n * items.n, np.int64)
    ways = np.cumsum(items.first[term + 1] - items.first[term])
    cuts = np.searchsorted(ways, np.arange(MAX_PAIRS, (ways[-1] if len(ways) else 0) + MAX_PAIRS, MAX_PAIRS))
    begin = 0
    for end in [*cuts, len(term)]:
        end = max(int(end), begin + 1) if begin < len(term) else begin
        if begin >= len(term):
            break
        s = slice(begin, min(end, len(term)))
        r, i, v = _expand(row[s], term[s], value[s], items.first, items.item)
        keep = alive[r, i]
        np.add.at(score, r[keep] * items.n + i[keep], v[keep])
        begin = s.stop
    rows, at = np.nonzero(alive)
    best.add(at, doc[rows], score[rows * items.n + at])
    return len(rows)


def _vectors(n: np.ndarray, sizes: np.ndarray, tf: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Impacts of the entries of documents with ``n`` terms and ``sizes`` entries."""
    m = np.array([10 + (90 * int(x) * n_docs) // n_terms for x in n], np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, sizes))


def _top(counted: DataFrame, numbers: list[int], held: list[list[int]], weight: list[int], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """item_no, doc_id, score: every task's best ``k`` of each item."""
    shared = counted.sparkSession.sparkContext.broadcast((np.array(numbers, np.int64), held, np.array(weight, np.int64)))

    def run(batches):
        item_no, *columns = shared.value
        items = Items(*columns)
        best = Best(items.n, k)

        def search(doc, n, sizes, term, tf):
            impact = _vectors(n, sizes, tf, n_docs, n_terms)
            starts = np.cumsum(sizes) - sizes
            square = np.bincount(np.repeat(np.arange(len(n)), sizes), (items.scale[term] * impact) ** 2, len(n))
            order = np.argsort(-square, kind="stable")
            bucket = max(1, min(BUCKET, BUCKET_PAIRS // items.n))
            for s in range(0, len(order), bucket):
                rows = order[s : s + bucket]
                at = np.arange(int(sizes[rows].sum())) + np.repeat(starts[rows] - (np.cumsum(sizes[rows]) - sizes[rows]), sizes[rows])
                search_bucket(doc[rows], np.cumsum(sizes[rows]) - sizes[rows], term[at], impact[at], np.sqrt(square[rows]), items, best)

        held_back, waiting = [], 0
        for b in batches:
            ids = b.column(0).fill_null(LEAST).to_numpy()
            sizes = b.column(2).value_lengths().to_numpy().astype(np.int64)
            some = sizes > 0
            piece = (ids[some], b.column(1).to_numpy()[some], sizes[some])
            held_back.append((*piece, b.column(2).flatten().to_numpy().astype(np.int64), b.column(3).flatten().to_numpy().astype(np.int64)))
            waiting += int(sizes.sum())
            if waiting >= CHUNK_ENTRIES:
                search(*map(np.concatenate, zip(*held_back)))
                held_back, waiting = [], 0
        if held_back:
            search(*map(np.concatenate, zip(*held_back)))
        i, place = np.nonzero(best.score)
        doc = best.doc[i, place]
        ids = pa.array(doc, pa.int64(), mask=doc == LEAST)
        yield pa.RecordBatch.from_arrays([pa.array(item_no[i]), ids, pa.array(best.score[i, place])], ["item_no", "doc_id", "score"])

    return counted.select("doc_id", "n", "terms", "counts").mapInArrow(run, "item_no long, doc_id long, score long")


def _blocks(items: DataFrame, block_terms: int):
    """Blocks of items: (row number of each item, its terms), read one by one."""
    block, size = [], 0
    for r in items.select("item_no", "text").toLocalIterator():
        own = sorted(set(terms(r.text.encode())))
        if not own:
            continue
        if block and size + len(own) > block_terms:
            yield block
            block, size = [], 0
        block.append((r.item_no, own))
        size += len(own)
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, k: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the best ``k`` documents of every item."""
    spark = docs.sparkSession
    ship_package(spark)
    asked = pin(items.select("item_id", text_or_empty("text").alias("text"), F.monotonically_increasing_id().alias("item_no")), "search-items")
    found = []
    for block in _blocks(asked, block_terms):
        words = sorted({w for _, own in block for w in own})
        number = {w: i for i, w in enumerate(words)}
        counted = pin(count_terms(docs, number), "search-counts")
        total = counted.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
        if not total.docs:
            continue
        # at most a row for each term of the block
        df = {r[0]: r[1] for r in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}
        weight = [math.floor(1000 * math.log((2 * total.docs + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(words))]
        held = [[number[w] for w in own] for _, own in block]
        best = _top(counted, [no for no, _ in block], held, weight, total.docs, total.terms, k)
        found.append(pin(best, "search-best"))
    kind = asked.select("item_id", "item_no")
    if not found:
        return kind.where("false").select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    rank = F.row_number().over(Window.partitionBy("item_no").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.join(kind, "item_no").select("item_id", "rank", "doc_id", "score")
