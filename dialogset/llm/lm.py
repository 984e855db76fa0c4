"""Operator 5: language-model scores by deleted interpolation.

A text's tokens are its white-space words (A-Z lower-cased) and one end. The
model mixes three maximum-likelihood estimates: c(prev, w) / c(prev), c(w) / N
and 1 / (V + 1). The mixture weights depend on how often the context (the
previous word, or the beginning of a text) was seen: contexts are put in
buckets of the logarithm of their count, and expectation-maximisation learns
each bucket's weights on held-out counts: one part of the training documents
is deleted from the counts, and the weights maximise that part's likelihood.
The final counts are those of all training documents.

How the counts travel. Documents are read once into *chunks* (a pinned table):
up to ``CHUNK_TOKENS`` tokens of one role (training, deleted part, held out) as
numbers into the chunk's own word list. A chunk's distinct unigrams and
bigrams, as sorted 64-bit keys with their counts, are cut by key range into
shards; a shard adds up each key over all chunks and sends the totals back to
every chunk that asked, in the order of its keys. So each distinct n-gram of a
chunk crosses the network once each way in a few bytes, a frequent n-gram is
one entry per chunk, and no task holds more than one chunk or one shard. The
number of shards grows with the corpus (``SHARD_KEYS`` keys each), and
only slices that hold keys are sent.

All texts are scored whole; all training texts are counted. Recovery: chunks
and totals are written tables in the checkpoint folder, every later step is a
deterministic function of them.

Edge cases: null text is empty (one token, the end); without training
documents every estimate is uniform and base scores use N = 0, V = 0; a null
doc_id takes the role of the empty text's crc32; rows repeating a doc_id each
count and are each scored; an empty table gives an empty result. Words are
identified by 62 bits of their hash.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogset.llm.common import crc_mod
from dialogset.session import pin, ship_package

HELD_OUT = 10  # training documents: crc32(doc_id) mod HELD_OUT is not 0
DELETED = 1  # the remainder of the deleted part
CHUNK_TOKENS = 1 << 21
SHARD_KEYS = 1 << 21
BUCKETS = 16
EM_ROUNDS = 12
SMOOTH = 0.1  # fixed value: added to every count of the base score
TRAIN, PART, TEST = 0, 1, 2
_U, _B = np.uint64(1), np.uint64(2)  # low bits of a key: unigram, bigram
_START = np.uint64(0x9E3779B97F4A7C15)
_END = -1  # local number of the end token


# ---------------------------------------------------------------- packing

def pack(values: np.ndarray) -> bytes:
    """Byte planes of an integer array, compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T) if values.size else b""
    return zstandard.ZstdCompressor(level=1).compress(bytes(planes))


def unpack(data: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).reshape(-1) if raw.size else np.empty(0, dtype)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


# ---------------------------------------------------------------- chunks

CHUNK = "chunk long, role int, n_tokens long, n_words long, ids array<long>, lens array<int>, words binary, stream binary"


class _Builder:
    def __init__(self, role: int):
        self.role, self.numbers, self.stream, self.ids, self.lens = role, {}, array("i"), [], []

    def add(self, doc_id, text: str | None) -> None:
        words = (text or "").encode().lower().split()
        number, known = self.numbers.setdefault, self.numbers
        self.stream.extend([number(w, len(known)) for w in words])
        self.stream.append(_END)
        self.ids.append(doc_id)
        self.lens.append(len(words) + 1)

    def row(self, chunk: int) -> dict:
        words = np.fromiter((xxhash.xxh64_intdigest(w, 0) for w in self.numbers), np.uint64, len(self.numbers))
        return {
            "chunk": chunk,
            "role": self.role,
            "n_tokens": len(self.stream),
            "n_words": len(self.numbers),
            "ids": self.ids,
            "lens": self.lens,
            "words": words.tobytes(),
            "stream": pack(np.frombuffer(self.stream, np.int32)),
        }


def chunks(docs: DataFrame, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """The corpus as chunk rows (see the module text)."""
    ship_package(docs.sparkSession)
    rem = crc_mod("doc_id", HELD_OUT)
    role = F.when(rem == 0, TEST).when(rem == DELETED, PART).otherwise(TRAIN)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", role.cast("int").alias("role"))
    schema = pa.schema(
        [("chunk", pa.int64()), ("role", pa.int32()), ("n_tokens", pa.int64()), ("n_words", pa.int64()),
         ("ids", pa.list_(pa.int64())), ("lens", pa.list_(pa.int32())), ("words", pa.binary()), ("stream", pa.binary())]
    )

    def run(batches):
        from pyspark import TaskContext

        base, made, open_ = TaskContext.get().partitionId() << 32, 0, {}
        for b in batches:
            for doc_id, text, r in zip(*(c.to_pylist() for c in b.columns)):
                builder = open_.setdefault(r, _Builder(r))
                builder.add(doc_id, text)
                if len(builder.stream) >= chunk_tokens:
                    yield pa.RecordBatch.from_pylist([open_.pop(r).row(base + made)], schema)
                    made += 1
        for builder in open_.values():
            yield pa.RecordBatch.from_pylist([builder.row(base + made)], schema)
            made += 1

    return rows.mapInArrow(run, CHUNK)


def _keys(words: np.ndarray, stream: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unigram keys by local word number, and the bigram key of every token
    (its previous word, or the start of the text, and itself)."""
    with np.errstate(over="ignore"):
        hashes = np.append(words, np.uint64(0xD6E8FEB86659FD93))  # the last one stands for the end (number -1)
        cur = hashes[stream]
        prev = np.empty_like(cur)
        prev[1:] = cur[:-1]
        prev[np.concatenate(([0], np.cumsum(lens)[:-1])).astype(np.int64)] = _START
        x = prev * np.uint64(0xBF58476D1CE4E5B9) ^ (cur + np.uint64(0x94D049BB133111EB))
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(32)
        low = ~np.uint64(3)
        return (words & low) | _U, (x & low) | _B


def _distinct(words, stream, lens):
    """All distinct keys of a chunk in order, their counts in the chunk, and
    where each word's and each token's key stands."""
    uni, bi = _keys(words, stream, lens)
    keys, at_bi, n_bi = np.unique(bi, return_inverse=True, return_counts=True)
    n_uni = np.bincount(stream[stream >= 0], minlength=len(words))
    both = np.concatenate((uni, keys))
    order = np.argsort(both, kind="stable")
    place = np.empty(len(both), np.int64)
    place[order] = np.arange(len(both))
    counts = np.concatenate((n_uni, n_bi))[order]
    return both[order], counts.astype(np.uint32), place[: len(words)], place[len(words) :][at_bi]


def _cuts(keys: np.ndarray, shards: int) -> np.ndarray:
    edges = np.array([(i << 64) // shards for i in range(1, shards)], dtype=np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)])).astype(np.int64)


def _read(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["words"], np.uint64), unpack(row["stream"], np.int32), np.asarray(row["lens"], np.int64)


def _questions(chunked: DataFrame, shards: int) -> DataFrame:
    names = ["shard", "chunk", "role", "keys", "counts"]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                keys, counts, _, _ = _distinct(*_read(row))
                cuts = _cuts(keys, shards)
                for s in range(shards):
                    lo, hi = cuts[s], cuts[s + 1]
                    if lo < hi:
                        one = [s, row["chunk"], row["role"], pack_sorted(keys[lo:hi]), pack(counts[lo:hi])]
                        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(one, types)], names)

    return chunked.select("chunk", "role", "lens", "words", "stream").mapInArrow(
        run, "shard int, chunk long, role int, keys binary, counts binary"
    )


def _answer(table: pa.Table) -> pa.Table:
    """Totals of one shard, in each chunk's key order; and, with chunk -1, the
    number of distinct unigrams seen in training."""
    rows = table.to_pylist()
    parts = [unpack_sorted(r["keys"]) for r in rows]
    counts = [unpack(r["counts"], np.uint32) for r in rows]
    keys, at = np.unique(np.concatenate(parts), return_inverse=True)

    def total(roles):
        w = np.concatenate([c if r["role"] in roles else np.zeros(len(c), np.uint32) for r, c in zip(rows, counts)])
        return np.bincount(at, weights=w, minlength=len(keys)).astype(np.uint64)

    train, part = total((TRAIN, PART)), total((PART,))
    seen = int(((keys & np.uint64(3)) == _U)[train > 0].sum())
    out, i = [], 0
    for r, p in zip(rows, parts):
        mine = at[i : i + len(p)]
        i += len(p)
        out.append(
            {"chunk": r["chunk"], "shard": r["shard"], "seen": 0, "train": pack(train[mine]),
             "part": pack(part[mine]) if r["role"] == PART else None}
        )
    out.append({"chunk": -1, "shard": rows[0]["shard"], "seen": seen, "train": None, "part": None})
    return pa.Table.from_pylist(
        out, pa.schema([("chunk", pa.int64()), ("shard", pa.int32()), ("seen", pa.int64()), ("train", pa.binary()), ("part", pa.binary())])
    )


class Totals:
    """Scalars of the training documents."""

    def __init__(self, tokens: int, docs: int, part_tokens: int, part_docs: int, distinct: int):
        self.tokens, self.docs, self.part_tokens, self.part_docs = tokens, docs, part_tokens, part_docs
        self.vocabulary = distinct + (docs > 0)  # the end is a token


def _estimates(row, answers, totals: Totals, without_part: bool):
    """Per token of a chunk: count of the token, context bucket, bigram and
    unigram estimates."""
    words, stream, lens = _read(row)
    _, _, at_word, at_pair = _distinct(words, stream, lens)
    answers = sorted(answers, key=lambda a: a["shard"])
    got = np.concatenate([unpack(a["train"], np.uint64) for a in answers] or [np.empty(0, np.uint64)]).astype(np.float64)
    docs, tokens = totals.docs, totals.tokens
    if without_part:
        got -= np.concatenate([unpack(a["part"], np.uint64) for a in answers]).astype(np.float64)
        docs, tokens = docs - totals.part_docs, tokens - totals.part_tokens
    uni = np.append(got[at_word], docs)  # by local number; the last is the end
    token = uni[stream]
    context = np.empty_like(token)
    context[1:] = token[:-1]
    context[np.concatenate(([0], np.cumsum(lens)[:-1])).astype(np.int64)] = docs
    bucket = np.minimum(np.log2(context + 1), BUCKETS - 1).astype(np.int64)
    p2 = got[at_pair] / np.maximum(context, 1)
    p1 = token / max(tokens, 1)
    return token, bucket, p2, p1, lens


def _held_out_table(chunked: DataFrame, answers: DataFrame, totals: Totals) -> DataFrame:
    """(bucket, p2, p1, n) of the deleted part's tokens under the other counts."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.to_pylist()
        if not rows:
            return pa.Table.from_pylist([], em_schema)
        _, bucket, p2, p1, _ = _estimates(rows[0], right.to_pylist(), totals, True)
        order = np.lexsort((p1, p2, bucket))
        b, x, y = bucket[order], p2[order], p1[order]
        new = np.concatenate(([True], (b[1:] != b[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(b)))
        return pa.Table.from_arrays([pa.array(b[first].astype(np.int32)), pa.array(x[first]), pa.array(y[first]), pa.array(n)], schema=em_schema)

    em_schema = pa.schema([("bucket", pa.int32()), ("p2", pa.float64()), ("p1", pa.float64()), ("n", pa.int64())])
    mine = chunked.where(F.col("role") == PART).groupBy("chunk")
    theirs = answers.where(F.col("part").isNotNull()).groupBy("chunk")
    rows = mine.cogroup(theirs).applyInArrow(run, "bucket int, p2 double, p1 double, n long")
    return rows.groupBy("bucket", "p2", "p1").agg(F.sum("n").alias("n"))


def learn_weights(table: DataFrame, vocabulary: int, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Mixture weights (BUCKETS x 3: bigram, unigram, uniform) by EM. Each
    round is one aggregation of the held-out table to a row per bucket.
    A bucket without held-out tokens keeps the pooled weights."""
    p0 = 1.0 / (vocabulary + 1)
    weights = np.full((BUCKETS + 1, 3), 1 / 3)  # the last row pools all buckets
    for _ in range(rounds):
        def mixed(r: int, at):
            return F.get(F.array(*[F.lit(float(x)) for x in weights[:, r]]), at)

        shares = []
        for name, at in (("own", F.col("bucket")), ("all", F.lit(BUCKETS))):
            parts = [mixed(0, at) * F.col("p2"), mixed(1, at) * F.col("p1"), mixed(2, at) * p0]
            whole = parts[0] + parts[1] + parts[2]
            shares += [F.sum(F.col("n") * x / whole).alias(f"{name}{k}") for k, x in enumerate(parts)]
        rows = table.groupBy("bucket").agg(*shares).collect()  # at most BUCKETS rows
        pooled = np.zeros(3)
        for r in sorted(rows):
            own = np.array(r[1:4])
            pooled += np.array(r[4:7])
            weights[r[0]] = own / own.sum()
        if not rows:
            return weights[:BUCKETS]
        weights[BUCKETS] = pooled / pooled.sum()
        for b in set(range(BUCKETS)) - {r[0] for r in rows}:
            weights[b] = weights[BUCKETS]
    # the uniform estimate keeps every probability above zero
    weights = 0.999999 * weights + 0.000001 * np.array([0.0, 0.0, 1.0])
    return weights[:BUCKETS]


SCORES = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, rounds: int = EM_ROUNDS, chunk_tokens: int = CHUNK_TOKENS, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """One row per row of ``docs``: see ``SCORES``."""
    spark = docs.sparkSession
    chunked = pin(chunks(docs, chunk_tokens), "lm-chunks")
    sums = {
        r["role"]: r
        for r in chunked.groupBy("role").agg(F.sum("n_tokens").alias("t"), F.sum(F.size("ids")).alias("d"), F.sum(F.col("n_tokens") + F.col("n_words")).alias("k")).collect()
    }
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, -(-sum(r["k"] for r in sums.values()) // shard_keys))
    asked = _questions(chunked, shards)
    answers = pin(
        asked.repartition(max(n, shards), "shard").groupBy("shard").applyInArrow(_answer, "chunk long, shard int, seen long, train binary, part binary"),
        "lm-totals",
    )
    distinct = answers.agg(F.sum("seen")).first()[0] or 0

    def of(name, *roles):
        return sum(sums[r][name] for r in roles if r in sums)

    totals = Totals(of("t", TRAIN, PART), of("d", TRAIN, PART), of("t", PART), of("d", PART), distinct)
    answers = answers.where(F.col("chunk") >= 0)
    held_out = pin(_held_out_table(chunked, answers, totals), "lm-em")
    weights = learn_weights(held_out, totals.vocabulary, rounds)
    p0 = 1.0 / (totals.vocabulary + 1)

    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()),
         ("base_score", pa.float64()), ("score", pa.float64())]
    )

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            token, bucket, p2, p1, lens = _estimates(row, right.to_pylist(), totals, False)
            w = weights[bucket]
            logs = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] * p0)
            base = np.log10((token + SMOOTH) / (totals.tokens + SMOOTH * (totals.vocabulary + 1)))
            starts = np.concatenate(([0], np.cumsum(lens)[:-1])).astype(np.int64)
            out.append(
                pa.Table.from_arrays(
                    [pa.array(row["ids"], pa.int64()), pa.array(lens), pa.array(np.add.reduceat((token > 0).astype(np.int64), starts)),
                     pa.array(np.full(len(lens), totals.tokens)), pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(logs, starts))],
                    schema=schema,
                )
            )
        return pa.concat_tables(out) if out else pa.Table.from_pylist([], schema)

    return chunked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, SCORES)
