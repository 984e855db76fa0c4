"""Operator 6: SimHash near-duplicates.

A text's fingerprint has a bit set where more than half of its shingles'
64-bit hashes (XXH64, seed 42) have it. Fingerprints are linked when they
differ in at most ``max_bits`` bits; a component is a set of texts connected
by links.

Candidates come from pigeonhole blocks: the 64 bits are cut into ``max_bits +
2`` blocks, and two fingerprints within ``max_bits`` bits agree in at least
two whole blocks, so joining on every pair of blocks (a key of about 32 bits)
finds every link; the Hamming distance is then checked.

Copies are folded first: only distinct fingerprints take part. A key shared by
up to ``BUCKET`` fingerprints is compared inside one row (a bounded array). A
key shared by more is resolved without comparing pairs: the fingerprints are
grouped once for every choice of ``max_bits`` free bits outside the key's
blocks, by all their other bits. Members of such a group differ in those free
bits only (at most ``2**max_bits`` fingerprints), so each is linked to the
least one; any linked pair shares a group. Both ways yield the same
components, and no group emits its pairs.

Components are found by alternating stars on the distributed links
(``components``); nothing about documents is collected to the driver.

Edge cases: null text is empty; a text without words has fingerprint zero,
linked like any other; a text with fewer words than a shingle is one shingle;
rows repeating a doc_id each get their own row; a null doc_id sorts after all
others (its component is null only if no member has an id); an empty table
gives an empty result; a text of any length is hashed whole, in slices.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogset.llm.components import components
from dialogset.session import pin, ship_package

SHINGLE = 3
MAX_BITS = 2
SEED = 42
BUCKET = 1024
_SLICE = 1 << 14


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of one text as a signed integer."""
    words = (text or "").encode().lower().split()  # on bytes: A-Z and ASCII white space only
    n = len(words)
    if not n:
        return 0
    if n <= shingle:
        spans, joined = [(0, None)], b" ".join(words)
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)  # one past the space after each word
        starts = np.concatenate(([0], ends[: n - shingle]))
        spans = list(zip(starts.tolist(), (ends[shingle - 1 :] - 1).tolist()))
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for i in range(0, len(spans), _SLICE):
        part = spans[i : i + _SLICE]
        h = np.array([digest(joined[a:b], SEED) for a, b in part], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(spans), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (long) per row of ``docs``."""
    ship_package(docs.sparkSession)

    def run(batches):
        for b in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _blocks(max_bits: int) -> list[list[int]]:
    n = max_bits + 2
    return [list(range(64 * i // n, 64 * (i + 1) // n)) for i in range(n)]


def links(distinct: DataFrame, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between the rows of ``distinct`` (one column ``fp``) that
    connect exactly the fingerprints reachable over distances of at most
    ``max_bits``: every link of small buckets, stars in large ones."""
    blocks = _blocks(max_bits)
    keys = list(combinations(range(len(blocks)), 2))
    masks = [_signed(sum(1 << b for i in pair for b in blocks[i])) for pair in keys]
    keyed = distinct.select(
        "fp",
        F.inline(F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])),
    )
    sizes = keyed.groupBy("c", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    sizes = pin(sizes, "simhash-buckets")
    cold = keyed.join(sizes.where(F.col("n") <= bucket).select("c", "key"), ["c", "key"], "left_semi")
    groups = cold.groupBy("c", "key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))  # at most `bucket` each
    near = F.flatten(
        F.transform(
            "fps",
            lambda a, i: F.transform(
                F.filter(
                    F.col("fps"),
                    lambda b: (b > a) & (F.bit_count(a.bitwiseXOR(b)) <= max_bits),
                ),
                lambda b: F.struct(a.alias("a"), b.alias("b")),
            ),
        )
    )
    out = groups.select(F.inline(near))
    hot = sizes.where(F.col("n") > bucket).select("c", "key")
    if hot.isEmpty():
        return out.distinct()
    choices = [
        (i, _signed(~sum(1 << b for b in free) & ((1 << 64) - 1)))
        for i, pair in enumerate(keys)
        for free in combinations([b for k, blk in enumerate(blocks) if k not in pair for b in blk], max_bits)
    ]
    free = docs_masks(distinct, choices)
    starred = (
        keyed.join(hot, ["c", "key"], "left_semi")
        .join(F.broadcast(free), "c")  # a fixed table: block pairs x choices of free bits
        .groupBy("c", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("rest"))
        .agg(F.collect_set("fp").alias("fps"))  # at most 2 ** max_bits
        .where(F.size("fps") > 1)
        .select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
        .where("a != b")
    )
    return out.unionByName(starred).distinct()


def docs_masks(like: DataFrame, choices: list[tuple[int, int]]) -> DataFrame:
    return like.sparkSession.createDataFrame(choices, "c int, mask long")


def _rooted(docs: DataFrame, shingle: int, max_bits: int, bucket: int) -> DataFrame:
    """doc_id, fp, root (a fingerprint naming the component), component_id per
    row of ``docs``."""
    fps = pin(fingerprints(docs, shingle), "simhash-fps")
    classes = pin(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    roots = components(links(classes.select("fp"), max_bits, bucket), "a", "b")
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = rooted.select("fp", "root").join(least, "root")
    return fps.join(found, "fp").select("doc_id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fp (long), component_id (least doc_id reachable) per row of ``docs``."""
    return _rooted(docs, shingle, max_bits, bucket).drop("root")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """``docs`` with one row of each component: that of the component's least
    doc_id (of rows repeating that id, the one with the least text hash; of a
    component without ids, the row with the least text hash). All columns are
    kept. One narrow row per document decides; the documents are shuffled
    once, by id. Rows without an id or repeating one are told apart by their
    fingerprint."""
    verdicts = pin(_rooted(docs, shingle, max_bits, bucket), "simhash-verdicts")
    by_id = verdicts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("component_id").alias("c"))
    plain = by_id.where("n = 1 AND doc_id = c").select(F.col("doc_id").alias("_keep"))
    out = docs.join(plain, docs["doc_id"] == plain["_keep"], "left_semi")
    odd = pin(by_id.where("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("_odd")), "simhash-odd")
    if odd.isEmpty():
        return out

    @F.pandas_udf("long")
    def fp(text):
        return text.map(lambda t: fingerprint(t, shingle))

    rows = docs.join(odd, docs["doc_id"].eqNullSafe(odd["_odd"]), "left_semi").select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        docs["doc_id"].cast("long").alias("id"),
        F.xxhash64(docs["text"]).alias("h"),
        fp(docs["text"]).alias("fp"),
    )
    least = verdicts.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        F.col("doc_id").alias("_id"), F.col("fp").alias("_fp"), "root"
    )
    stays = rows.join(least.distinct(), F.col("id").eqNullSafe(F.col("_id")) & (F.col("fp") == F.col("_fp")))
    one = stays.groupBy("root").agg(F.min_by("row", "h").alias("row"))
    return out.unionByName(one.select("row.*"))
