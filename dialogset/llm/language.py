"""Operator 10: language identification by compression.

For every language of the training documents a dictionary of raw text is
gathered; a text belongs to the language whose dictionary lets zstandard
encode it in the fewest bytes. Texts are encoded whole, in independent
blocks of ``BLOCK`` bytes, so that the dictionary and not the text's own
beginning explains every block. The margin is ``1 - best / second``; a text
whose margin is below ``MIN_MARGIN`` is not accepted.

The dictionaries are fitted on a bounded sample of labelled rows: the
``SAMPLE_DOCS`` training documents per language with the least hashes of their
id (evenly from ``SAMPLE_PARTS`` parts of the hashes, so no task ranks a whole
language), the first ``SAMPLE_CHARS`` characters of each after that reduction; all of it
goes into the dictionary (``DICT_BYTES`` is the most it can take). Texts and samples are reduced to lower-case words of letters first,
so that markup and numbers say nothing about a language. Choosing the sample ranks narrow rows (id and language), limited per
map task before the shuffle. The dictionaries (a number of languages times
``DICT_BYTES``, checked against ``MAX_LANGUAGES``) go to the tasks as a
broadcast variable. Prediction is one pass over the rows without a shuffle.

Edge cases: null text or a text without a letter is ``und`` with score 0; a
null language is not learned from; with one learned language its score is 1;
with none every text is ``und``; equal sizes go to the language with the most
training documents (then by code point) with score 0; repeated rows are each predicted; an empty table gives an
empty result; other columns pass through ``identify``
untouched, but one named like its output is replaced.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialogset.llm.common import crc_mod
from dialogset.session import ship_package

SAMPLE_DOCS = 256
SAMPLE_PARTS = 16
SAMPLE_CHARS = 1024
DICT_BYTES = SAMPLE_DOCS * (4 * SAMPLE_CHARS + 1)  # the whole sample in any script
BLOCK = 1024
LEVEL = 3
MIN_MATCH = 3
MIN_MARGIN = 0.002
MAX_LANGUAGES = 1000
HELD_OUT = 5
UNKNOWN = "und"


def letters(text: str | Column) -> Column:
    """Lower-case runs of letters, separated by one space."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where((crc_mod("doc_id", HELD_OUT) != 0) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> dict[str, bytes]:
    """Language -> raw dictionary content, from training rows of ``docs``."""
    train = training_rows(docs)
    parts = min(SAMPLE_PARTS, sample_docs)
    rank = F.row_number().over(Window.partitionBy("lang", F.pmod("h", F.lit(parts))).orderBy("h", "doc_id", "piece"))
    # pieces are cut before ranking, so a ranked row is bounded
    pieces = train.select(
        "lang", "doc_id", F.xxhash64(F.col("doc_id").cast("string")).alias("h"), F.substring(F.ltrim(letters("text")), 1, SAMPLE_CHARS).alias("piece")
    )
    chosen = pieces.withColumn("_rank", rank).where(F.col("_rank") <= sample_docs // parts)
    rows = chosen.select("lang", "h", "piece").limit(MAX_LANGUAGES * sample_docs + 1).collect()
    texts: dict[str, list] = {}
    for lang, r, piece in rows:
        texts.setdefault(lang, []).append((r, piece))
    if len(texts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    counts = {r[0]: r[1] for r in train.groupBy("lang").count().collect()}  # at most MAX_LANGUAGES rows
    out = {}
    for lang in sorted(texts, key=lambda k: (-counts[k], k)):
        whole = "\n".join(p for _, p in sorted(texts[lang])).encode()
        # a dictionary of under 8 bytes is not accepted by the library
        out[lang] = whole.ljust(8, b" ")
    return out


class Classifier:
    """Compressors of all languages; made once per task."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = list(dictionaries)
        self.compressors = []
        for lang in self.langs:
            content = dictionaries[lang]
            params = zstandard.ZstdCompressionParameters.from_level(
                LEVEL,
                source_size=BLOCK,
                dict_size=len(content),
                min_match=MIN_MATCH,
                strategy=zstandard.STRATEGY_GREEDY,
                write_content_size=False,
            )
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))

    def predict(self, text: str | None) -> tuple[str, float]:
        """``text`` as ``letters`` gives it."""
        if not self.langs or not (text or "").strip(" "):
            return UNKNOWN, 0.0
        data = text.encode()
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        sizes = [sum(len(c.compress(b)) for b in blocks) for c in self.compressors]
        if len(sizes) == 1:
            return self.langs[0], 1.0
        best, second = sorted(sizes)[:2]
        return self.langs[sizes.index(best)], 1.0 - best / second


def identify(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN, out: str = "language") -> DataFrame:
    """``docs`` plus a struct column ``out``: lang, score, accepted."""
    docs = docs.drop(out)
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(dictionaries)
    kind = T.StructType(
        [T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())]
    )
    schema = T.StructType([*docs.schema.fields, T.StructField(out, kind)])

    def run(batches):
        model = Classifier(shared.value)
        for b in batches:
            found = [model.predict(t.as_py()) for t in b.column(b.num_columns - 1)]
            lang = pa.array([x[0] for x in found], pa.string())
            score = pa.array([x[1] for x in found], pa.float64())
            sure = pc.and_(pc.greater_equal(score, min_margin), pc.not_equal(lang, UNKNOWN))
            struct = pa.StructArray.from_arrays([lang, score, sure], ["lang", "score", "accepted"])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], struct], schema.names)

    return docs.select("*", letters("text").alias(out)).mapInArrow(run, schema)
