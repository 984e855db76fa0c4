"""A training corpus from ``documents``, in five stages.

Each stage calls one operator of ``dialogset.llm`` on everything its
predecessor kept; ``run`` writes every stage's rows as Parquet into the folder
of ``spark.checkpoint.dir`` and reads them back as the next one's documents, so
a lost executor costs at most one stage's tasks.

1. ``language_id``: documents whose language is not identified (no letter, or
   too narrow a margin) go;
2. ``near_duplicates``: of each SimHash component one document stays;
3. ``decontaminate``: documents contaminated with ``benchmark`` passages go;
4. ``pii``: personal data in the text is masked, ``n_chars`` counted again;
5. ``mix``: documents are repeated or left out until every source has its
   target weight; a column ``copy`` numbers the copies of a document.

All stages but the last return the columns of ``documents``. Edge cases are
those of the operators: null texts and texts without letters go in stage 1,
an empty table stays empty, extra columns pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogset.llm import decontaminate as decontamination
from dialogset.llm import language, mixing, pii, simhash
from dialogset.llm.common import table
from dialogset.session import pin


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = language.identify(docs, language.learn(docs), out="_language")
    return found.where(F.col("_language.accepted")).drop("_language")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), out="_found")
    return judged.where(~F.col("_found.contaminated")).drop("_found")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs, pii.learn(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("pii", mask_personal_data),
    ("mix", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = pin(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


# Compression, fingerprints and the tagger cannot be said in SQL: tests/llm
# holds run() against a plain version of the five rules.
ORACLE_SQL = None
