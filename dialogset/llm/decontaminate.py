"""Operator 3: benchmark decontamination by winnowing (DataFrame functions only).

Every text is a sequence of words. For each ``k``-word gram a 64-bit hash is
taken, and in every window of ``span - k + 1`` consecutive grams the grams
with the minimum hash are kept (all of them on ties). Two texts sharing
``span`` words share such a window, hence at least one kept gram: joining the
kept grams finds every document with a shared span. Its hits are *extended*:
all its windows of ``span`` words are looked up in the items' windows (two
independent 64-bit hashes of all their words), the occurring windows are laid
over each other, and their items gathered. Shorter matches and hash collisions
of single grams fall away. The work on a document grows with its own words,
however often they repeat and whatever number of items share a passage.

Items of fewer than ``span`` words are one window: their single gram is as
long as the item, and all document grams of that length are looked up.

Distribution: document grams are exploded and joined to the distinct
benchmark grams, then the windows of documents with a hit to the distinct
benchmark windows. Both tables hold 8 to 36 bytes a row and are broadcast only
up to ``broadcast_rows`` counted rows (a shuffle join beyond that). Items with equal
words, and windows with the same items, are folded before. Only occurring
windows are grouped by document; the texts meet the verdicts by document id
and a hash of the text, and move only where the verdicts are too large for
Spark's own broadcast limit.

Edge cases: null text has no words (never contaminated); null or wordless
items match nothing; repeated items with one id count once; a null item_id is
written as the empty string; rows repeating a doc_id are judged each by its
own words; a null doc_id is matched null-safely; empty tables give empty or
clean results; extra columns of ``docs`` pass through
(one named like the output is replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialogset.llm.common import ascii_lower, broadcast_if, let, split_words, text_or_empty
from dialogset.session import pin

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # fixed value: between words, after lower-casing
SPAN = 13
GRAM = 8
BROADCAST_ROWS = 500_000


def words_of(text: Column) -> Column:
    return split_words(ascii_lower(text_or_empty(text)), SEPARATORS)


def _grams(hashes: Column, k: int) -> Column:
    """Hash of every ``k`` consecutive word hashes."""
    return F.transform(
        F.slice(hashes, 1, F.greatest(F.size(hashes) - (k - 1), F.lit(0))),
        lambda x, i: F.xxhash64(F.lit(k), x, *[F.get(hashes, i + j) for j in range(1, k)]),
    )


def _winnow(grams: Column, window: int) -> Column:
    """Grams that are the minimum of some window of ``window`` grams, as
    structs (h, pos). Sequences shorter than a window keep none."""

    def select(h: Column, m: Column) -> Column:
        kept = F.transform(
            h,
            lambda x, i: F.when(
                x == F.greatest(*[F.get(m, i - j) for j in range(window)]), F.struct(x.alias("h"), i.alias("pos"))
            ),
        )
        return F.filter(kept, lambda s: s.isNotNull())

    def minima(h: Column) -> Column:
        m = F.transform(
            F.slice(h, 1, F.greatest(F.size(h) - (window - 1), F.lit(0))),
            lambda x, i: F.least(x, *[F.get(h, i + j) for j in range(1, window)]),
        )
        return let(m, lambda mm: select(h, mm))

    return let(grams, minima)


def _all_grams(hashes: Column, k: int) -> Column:
    return F.transform(_grams(hashes, k), lambda x, i: F.struct(x.alias("h"), i.alias("pos")))


def _fingerprints(words: Column, k: int, span: int, short_lengths: list[int]) -> Column:
    """Winnowed grams plus, for each short item length, all grams of it."""

    def body(wh: Column) -> Column:
        parts = [_winnow(_grams(wh, k), span - k + 1), *[_all_grams(wh, n) for n in short_lengths]]
        return parts[0] if len(parts) == 1 else F.concat(*parts)

    return let(F.transform(words, lambda w: F.xxhash64(w)), body)


def _windows(words: Column, lengths: list[int]) -> Column:
    """Every run of ``n`` words for each of ``lengths``: structs (n, a, b, pos)
    with two hashes of its words."""

    def of(n: int, one: Column, two: Column) -> Column:
        both = F.zip_with(_grams(one, n), _grams(two, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return F.transform(both, lambda s, i: F.struct(F.lit(n).alias("n"), s["a"].alias("a"), s["b"].alias("b"), i.alias("pos")))

    def runs(one: Column, two: Column) -> Column:
        return F.concat(*[of(n, one, two) for n in lengths])

    first = F.transform(words, lambda w: F.xxhash64(w))
    second = F.transform(words, lambda w: F.xxhash64(F.lit(7), w))
    return let(first, lambda one: let(second, lambda two: runs(one, two)))


def _items(benchmark: DataFrame) -> DataFrame:
    """One row per distinct word sequence: item_no, words, ids (distinct)."""
    rows = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), words_of(F.col("text")).alias("words")
    ).where(F.size("words") > 0)
    folded = rows.groupBy("words").agg(F.collect_set("id").alias("ids"))
    # a hash of the words numbers the items the same way on every run
    return folded.select(F.xxhash64("words", F.lit(1)).alias("item_no"), "words", "ids")


def _item_windows(items: DataFrame, span: int, short: list[int]) -> tuple[DataFrame, DataFrame]:
    """The distinct windows (n, a, b, ids_no) of all items, and the sets of
    item ids (ids_no, ids) that hold them."""
    own = F.filter(_windows(F.col("words"), [span, *short]), lambda w: w["n"] == F.least(F.size("words"), F.lit(span)))
    held = items.select("ids", F.inline(own)).groupBy("n", "a", "b").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
    held = pin(held, "decon-windows")
    sets = pin(held.select("ids").distinct().withColumn("ids_no", F.monotonically_increasing_id()), "decon-sets")
    return pin(held.join(sets, "ids").select("n", "a", "b", "ids_no"), "decon-window-sets"), sets


def _verdicts(matched: DataFrame, sets: DataFrame) -> DataFrame:
    """doc_id, text_key, n_hit, spans, items from the occurring windows (doc_id, text_key, pos, n, ids_no)."""
    key = ["doc_id", "text_key"]
    order = Window.partitionBy(*key).orderBy("pos")
    reached = F.max(F.col("pos") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    laid = matched.groupBy(*key, "pos").agg(F.max("n").alias("n")).withColumn("reached", reached)
    fresh = F.coalesce(F.col("pos") > F.col("reached"), F.lit(True)).cast("long")
    # touching windows are one interval
    laid = laid.withColumn("island", F.sum(fresh).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    islands = laid.groupBy(*key, "island").agg(F.min("pos").alias("lo"), F.max(F.col("pos") + F.col("n")).alias("hi"))
    found = matched.select(*key, "ids_no").distinct().join(sets, "ids_no").select(*key, "ids")
    both = islands.select(*key, F.struct("lo", "hi").alias("span")).unionByName(found, allowMissingColumns=True)
    return both.groupBy(*key).agg(
        F.sum(F.col("span.hi") - F.col("span.lo")).alias("n_hit"),
        F.array_sort(F.collect_list("span")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("items"),
    )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    span: int = SPAN,
    gram: int = GRAM,
    ratio: int = 20,
    broadcast_rows: int = BROADCAST_ROWS,
    out: str = "decontamination",
) -> DataFrame:
    """``docs`` plus a struct column ``out``: n_words, n_hit (words inside an
    occurrence of a window), items (sorted ids), spans (the disjoint intervals
    of hit words), contaminated (n_hit > 0 and ratio * n_hit >= n_words)."""
    if not 1 <= gram <= span:
        raise ValueError("gram must lie in 1..span")
    docs = docs.drop(out)
    items = pin(_items(benchmark), "decon-items")
    lengths = items.where(F.size("words") < span).select(F.size("words").alias("n")).distinct()
    short = sorted(r[0] for r in lengths.collect())  # fewer than `span` values

    hashes = F.transform("words", lambda w: F.xxhash64(w))
    winnowed = F.transform(_fingerprints(F.col("words"), gram, span, []), lambda s: s["h"])
    own = F.when(F.size("words") >= span, winnowed).otherwise(F.transform(F.array(hashes), lambda wh: _whole_gram(wh, short)))
    grams = pin(items.select(F.explode(own).alias("h")).distinct(), "decon-grams")
    windows, sets = _item_windows(items, span, short)
    n_grams, n_windows = grams.count(), windows.count()

    # a row meets only its own candidates, also where many share an id or have none
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    shared = keyed.select(
        "doc_id", "text_key", F.explode(F.transform(_fingerprints(words_of(F.col("text")), gram, span, short), lambda s: s["h"])).alias("h")
    ).join(broadcast_if(grams, n_grams, broadcast_rows), "h", "left_semi")
    hit = pin(shared.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct(), "decon-hits")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("text_key").eqNullSafe(F.col("_key"))
    extended = keyed.join(hit, same, "left_semi").select("doc_id", "text_key", F.inline(_windows(words_of(F.col("text")), [span, *short])))
    matched = extended.join(broadcast_if(windows, n_windows, broadcast_rows), ["n", "a", "b"]).select("doc_id", "text_key", "pos", "n", "ids_no")
    verdicts = _verdicts(pin(matched, "decon-matched"), sets)

    found = verdicts.select(*[F.col(c).alias(f"__{c}") for c in verdicts.columns])
    met = docs["doc_id"].eqNullSafe(found["__doc_id"]) & F.xxhash64(docs["text"]).eqNullSafe(found["__text_key"])
    joined = docs.join(found, met, "left")

    def judged(n_words: Column) -> Column:
        n_hit = F.coalesce(F.col("__n_hit"), F.lit(0)).cast("long")
        return F.struct(
            n_words.alias("n_words"),
            n_hit.alias("n_hit"),
            F.coalesce(F.col("__items"), F.array().cast("array<string>")).alias("items"),
            F.coalesce(F.col("__spans"), F.array().cast("array<struct<lo:int,hi:int>>")).alias("spans"),
            ((n_hit > 0) & (n_hit * ratio >= n_words)).alias("contaminated"),
        )

    n_words = F.size(words_of(docs["text"])).cast("long")
    return joined.select(*[docs[c] for c in docs.columns], let(n_words, judged).alias(out))


def _whole_gram(wh: Column, lengths: list[int]) -> Column:
    """The one gram covering all of a short item."""
    c = F.lit(None).cast("long")
    for n in lengths:
        c = F.when(F.size(wh) == n, F.xxhash64(F.lit(n), *[F.get(wh, F.lit(j)) for j in range(n)])).otherwise(c)
    return c
