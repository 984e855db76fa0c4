"""Split files: write (S7), read (S3, S5), legacy JSON import.

The reference writes three JSON documents per dataset
(``split-{i}_{tag}.{train,dev,test}``), each holding four parallel tuple
lists (``coarse, multi, seq_coarse, seq_multi``). Here a dataset is one
wide table partitioned by ``split_id / tag / part``; the four granularities
are column projections of the same row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogset.operators.scan import ordered_scan
from dialogset.session import pin
from dialogset.sources.publish import read_published, write_published

GRANULARITIES = ("coarse", "multi", "seq_coarse", "seq_multi")
_LIST = r'"(coarse|multi|seq_coarse|seq_multi)"\s*:\s*\['  # where a list of a document begins


SPLIT_KEYS = ("split_id", "tag", "part")


def write_splits(dataset: DataFrame, root: str, split_id: str, tag: str) -> None:
    """Write a dataset (with column ``part``) under ``root`` partitioned by
    ``split_id, tag, part`` and publish it in one step. Parts written before are
    replaced, others stay, so a second run gives the same dataset; a killed
    run changes nothing."""
    tagged = dataset.withColumn("split_id", F.lit(str(split_id))).withColumn("tag", F.lit(tag))
    write_published(tagged, root, SPLIT_KEYS)


def read_splits(spark: SparkSession, root: str) -> DataFrame:
    """All published split files under ``root``; partition values are read as
    the strings they are (``split_id=01`` is not 1)."""
    return read_published(spark, root, SPLIT_KEYS)


def read_split(spark: SparkSession, root: str, split_id: str, tag: str, part: str | None = None) -> DataFrame:
    """All columns of one split; the partition filters prune directories."""
    df = read_splits(spark, root).where((F.col("split_id") == str(split_id)) & (F.col("tag") == tag))
    if part is not None:
        df = df.where(F.col("part") == part)
    return df


def read_split_labels(spark: SparkSession, root: str, split_id: str, tag: str, part: str,
                      granularity: str = "coarse") -> DataFrame:
    """S3 (+S4, P8, P9): text and one label granularity of a part."""
    if granularity not in GRANULARITIES:
        raise ValueError(granularity)
    return read_split(spark, root, split_id, tag, part).select("text", F.col(granularity).alias("label"))


def read_two_sided(spark: SparkSession, root: str, split_id: str, tag: str, part: str,
                   granularity: str = "seq_coarse", class_names: list[str] | None = None) -> DataFrame:
    """Text, context and the verbalised label of a two-sided split.

    ``seq_coarse`` reads the coarse label, ``seq_multi`` the target's n-hot
    vector, ``seq_multi_per_utterance`` the per-utterance vectors."""
    from dialogset.functions.text import verbalize_label

    src = {"seq_coarse": "coarse", "seq_multi": "multi", "seq_multi_per_utterance": "seq_multi"}
    if granularity not in src:
        raise ValueError(granularity)
    df = read_split(spark, root, split_id, tag, part)
    return df.select(
        "text",
        "context",
        verbalize_label(F.col(src[granularity]), granularity, class_names).alias("label"),
    )


def write_legacy_json(examples: DataFrame, path: str, keys: list[str], rows_per_document: int = 1000) -> None:
    """Export one-sided examples in the layout ``read_legacy_json`` reads, as
    JSON lines: each document holds the examples of one group of ``keys`` and
    one run of ``rows_per_document`` targets, so no document grows without
    bound."""
    def text(c):  # a JSON string, taken out of a one-element JSON array
        return F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")

    ids = [F.col("thread_id").cast("string"), F.col("conv_id").cast("string")]
    labels = {g: F.col(g).cast("string") if g == "coarse" else F.to_json(g) for g in GRANULARITIES}
    tuples = {g: F.concat(F.lit("["), F.concat_ws(",", text(F.col("text")), v, *ids), F.lit("]")) for g, v in labels.items()}
    one = F.struct("target_idx", *[t.alias(g) for g, t in tuples.items()])
    docs = examples.groupBy(*keys, F.floor(F.col("target_idx") / rows_per_document).alias("_run")).agg(
        F.array_sort(F.collect_list(one)).alias("_rows"))
    lists = [F.concat(F.lit(f'"{g}":['), F.array_join(F.col(f"_rows.{g}"), ","), F.lit("]")) for g in GRANULARITIES]
    docs.select(F.concat(F.lit("{"), F.concat_ws(",", *lists), F.lit("}")).alias("value")).write.text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, seq, piece``: the files cut at every closing bracket, in
    order. Spark's text source finds the cuts in byte ranges, so one file of
    any size is read by many tasks; the rows are pinned, as their numbers must
    not change between reads."""
    pieces = spark.read.option("lineSep", "]").text(path).select(
        F.input_file_name().alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("value").alias("piece"),
    )
    return pin(pieces, "json-pieces")


def _tuples(pieces: DataFrame) -> DataFrame:
    """``file, granularity, pos, tuple``: the elements of the lists of every
    document (JSON text), found in parallel.

    Three running sums over narrow rows say what a walk over the bytes would
    know. The quotes so far tell whether a piece begins inside a string (where
    brackets do not count; an escape never ends a piece, as none is followed
    by a bracket). The brackets outside strings so far give the depth: a piece
    that ends at depth 1 ends a tuple, one that ends at depth 0 a list. The
    tuples and lists ended so far number them."""
    order, at = [("block", True), ("seq", True)], ["file", "block", "seq"]
    bare = F.regexp_replace("piece", r"(?s)\\.", "")  # without escapes every quote counts
    count = lambda x, c: (F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))).cast("long")
    outside = F.regexp_replace("bare", r'"[^"]*(?:"|$)', "")
    inside = F.regexp_replace(F.regexp_replace("bare", r'^[^"]*(?:"|$)', ""), r'"[^"]*(?:"|$)', "")
    name = F.regexp_extract("piece", _LIST, 1)
    narrow = pieces.select(*at, bare.alias("bare"), name.alias("name")).select(
        *at, "name", (count("bare", '"') % 2).alias("odd"), count(outside, "[").alias("opens"), count(inside, "[").alias("opens_inside"))

    def scan(rows: DataFrame, *sums: str) -> DataFrame:
        return ordered_scan(rows, ["file"], order, sums=sums, seq_col="_i", size_col="_n", materialize=True).drop("_i", "_n", *[f"{c}_total" for c in sums])

    quoted = scan(narrow, "odd")
    begins, ends = F.col("odd_before") % 2 == 1, (F.col("odd_before") + F.col("odd")) % 2 == 1
    change = F.when(begins, F.col("opens_inside")).otherwise(F.col("opens")) - F.when(ends, 0).otherwise(1)
    deep = scan(quoted.select(*at, "name", ends.alias("in_string"), change.cast("long").alias("change")), "change")
    depth = F.col("change_before") + F.col("change")
    ended = lambda d: (~F.col("in_string") & (depth == d)).cast("long")
    starts = (F.col("change_before") == 0) & (F.col("name") != "")
    numbered = scan(deep.select(*at, F.when(starts, F.col("name")).alias("name"), ended(1).alias("tuples"), ended(0).alias("lists")), "tuples", "lists")
    numbered = pin(numbered, "json-places")
    # four rows a file
    lists = numbered.groupBy("file", "lists_before").agg(F.max("name").alias("granularity"), F.min("tuples_before").alias("first")).where("granularity is not null")
    members = numbered.where("lists = 0").join(lists, ["file", "lists_before"])
    parts = members.select(*at, "granularity", (F.col("tuples_before") - F.col("first")).alias("pos")).join(pieces, at)
    whole = parts.groupBy("file", "granularity", "pos").agg(F.array_sort(F.collect_list(F.struct("block", "seq", "piece"))).alias("ps"))
    text = F.concat(F.array_join(F.transform("ps", lambda p: p["piece"]), "]"), F.lit("]"))
    return whole.select("file", "granularity", "pos", F.regexp_replace(F.regexp_replace(text, rf"^[^\[]*?{_LIST}", ""), r"^[\s,]*", "").alias("tuple"))


def _documents(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    """``file, pos`` and the tuple of each granularity (null where a list is
    shorter): of JSON lines a document a line, else of whole files."""
    if lines:
        raw = spark.read.json(path).withColumn("file", F.input_file_name())
        sizes = F.array(*[F.coalesce(F.size(g), F.lit(-1)) for g in GRANULARITIES])
        unequal = F.raise_error(F.concat(F.lit("lists of unequal length in "), F.col("file"), F.lit(": "), sizes.cast("string")))
        zipped = F.when(F.size(F.array_distinct(sizes)) == 1, F.arrays_zip(*GRANULARITIES)).otherwise(unequal)
        return raw.select("file", F.posexplode(zipped).alias("pos", "z")).select("file", "pos", "z.*")
    broken = F.raise_error(F.concat(F.lit("no JSON list in "), F.col("file"), F.lit(": "), F.left("tuple", F.lit(80)))).cast("array<string>")
    parsed = _tuples(_pieces(spark, path)).withColumn("t", F.from_json("tuple", "array<string>")).withColumn("t", F.coalesce("t", broken))
    held = parsed.groupBy("file", "pos").agg(*[F.max(F.when(F.col("granularity") == g, F.col("t"))).alias(g) for g in GRANULARITIES])
    short = F.raise_error(F.concat(F.lit("lists of unequal length in "), F.col("file"))).cast("array<string>")
    return held.select("file", F.col("pos").cast("int").alias("pos"), *[F.coalesce(F.col(g), short).alias(g) for g in GRANULARITIES])


def read_legacy_json(spark: SparkSession, path: str, two_sided: bool = False, lines: bool = False) -> DataFrame:
    """Import split documents in the reference's JSON layout.

    Each file (each line with ``lines``) is one JSON object whose four keys
    hold parallel tuple lists; the tuples are read as ``array<string>`` and typed by position. One row
    per example with all four granularities; ``file`` keeps the source. Lists
    of unequal length are an error. A file of one document is read by many
    tasks, however large it is."""
    rows = _documents(spark, path, lines)
    first = 2 if two_sided else 1
    at = {"coarse": first, "multi": first, "seq_coarse": first + two_sided, "seq_multi": first + two_sided}
    types = {"multi": "array<int>", "seq_coarse": "array<int>", "seq_multi": "array<array<int>>"}
    values = {g: F.col(g)[k] for g, k in at.items()}
    labels = [(F.from_json(v, types[g]) if g in types else v.cast("int")).alias(g) for g, v in values.items()]
    head = F.col("coarse")
    texts = [head[0].alias("text"), *([head[1].alias("context")] if two_sided else [])]
    ids = [head[first + 1].cast("long").alias("thread_id"), head[first + 2].cast("long").alias("conv_id")]
    return rows.select("file", "pos", *texts, *labels, *ids)


def legacy_counts(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A19 on imported files: the number of examples under each key of a
    document, counted before the lists are zipped."""
    if lines:
        raw = spark.read.json(path).withColumn("file", F.input_file_name())
        return raw.select("file", *[F.size(g).alias(f"n_{g}") for g in GRANULARITIES])
    pieces = _pieces(spark, path)
    rows = _tuples(pieces).select("file", "granularity").unionByName(pieces.select("file").distinct(), allowMissingColumns=True)
    return rows.groupBy("file").agg(*[F.count_if(F.col("granularity") == g).cast("int").alias(f"n_{g}") for g in GRANULARITIES])


def granularity_counts(df: DataFrame) -> DataFrame:
    """Count of non-null labels per granularity (equal by construction
    in the wide layout; imported files: ``legacy_counts``)."""
    return df.agg(*[F.count(g).alias(f"n_{g}") for g in GRANULARITIES])
