"""Fixture views derived from the driver tables (FIXTURES.md part B).

Each view is a plain projection of a driver table, so its size grows with
the table. The same definitions exist as DuckDB SQL in ``checks/oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Donor lists of the fixture views (5 test donors, 17 train donors).
TEST_DONORS = [2000, 2001, 2002, 2003, 2004]
TRAIN_DONORS = [2005, 2006, 2007, 2008, 2009, 2010, 2011, 2012, 2013, 2014, 2015, 2016, 2017, 2018, 2019, 2020, 2021]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _label_columns(order_col: str) -> list:
    m = F.length("text") % 8
    return [
        F.when(m < 4, 1).otherwise(0).alias("y0"),
        F.when(m.isin(4, 7), 1).otherwise(0).alias("y1"),
        F.when(m == 5, 1).otherwise(0).alias("y2"),
        F.when(m.isin(6, 7), 1).otherwise(0).alias("y3"),
        F.lit(0).alias("y4"),
        F.when((m == 5) & (F.col(order_col) % 2 == 1), 1).otherwise(0).alias("y5"),
        F.when(m < 4, 0).otherwise(m - 3).alias("l1"),
        ((F.length("text") + F.col(order_col)) % 9).alias("l2"),
    ]


def _flag(conv: str = "conv_id"):
    return (
        F.when(F.col(conv) % 10 == 9, F.lit(None).cast("boolean"))
        .when(F.col(conv) % 10 == 8, F.lit(False))
        .otherwise(F.lit(True))
    )


def _finish(df: DataFrame) -> DataFrame:
    return df.withColumn("gold_nhot", F.array(*[F.col(f"y{i}") for i in range(6)]))


def messenger_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: one message per conversation turn (raw messenger layout)."""
    c = table(spark, sf_dir, "conversations")
    df = c.select(
        (F.lit(2000) + F.col("conv_id") % 22).alias("user_id"),
        (F.col("conv_id") % 7).alias("thread_id"),
        "conv_id",
        F.col("turn").alias("line_num"),
        F.col("role").alias("author"),
        F.col("text").alias("line_text"),
        F.lower("text").alias("line_text_en"),
        _flag().alias("is_annotated_tagset_0"),
        *_label_columns("turn"),
        (F.col("conv_id") % 5 == 0).alias("is_checked_sup"),
        "text",
    ).drop("text")
    return _finish(df)


def lines_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2: every document is a conversation, every line an utterance."""
    d = table(spark, sf_dir, "documents")
    ex = d.select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    df = ex.select(
        (F.lit(2000) + F.col("doc_id") % 22).alias("user_id"),
        (F.col("doc_id") % 7).alias("thread_id"),
        F.col("doc_id").alias("conv_id"),
        F.col("pos").cast("long").alias("line_num"),
        F.col("source").alias("author"),
        F.col("line").alias("line_text"),
        F.lower("line").alias("line_text_en"),
        _flag().alias("is_annotated_tagset_0"),
        F.col("line").alias("text"),
    )
    df = df.select("*", *_label_columns("line_num"), (F.col("conv_id") % 5 == 0).alias("is_checked_sup")).drop("text")
    return _finish(df)


def imbalance_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a binary label whose positive class is the minority."""
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id").select(F.col("doc_id").alias("row_id"), "text", F.col("toxic").alias("label"))


def scored_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truths with logits and hard predictions taken from the embeddings."""
    e = table(spark, sf_dir, "embeddings")
    emb = F.col("embedding")
    return e.select(
        F.col("vec_id").alias("row_id"),
        F.col("label").alias("true_class"),
        F.when(F.col("label") < 3, 1).otherwise(0).alias("y_true"),
        (emb[0].cast("double") * 8).alias("logit0"),
        (emb[1].cast("double") * 8).alias("logit1"),
        F.when(emb[2] > 0, 1).otherwise(0).alias("y_pred"),
    )


def generated_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated label strings next to the verbalised truths."""
    e = table(spark, sf_dir, "embeddings")
    v, lab = F.col("vec_id"), F.col("label")
    return e.select(
        v.alias("row_id"),
        F.when(lab < 3, "positive").otherwise("negative").alias("true_coarse"),
        F.when(v % 4 == 0, " positive").when(v % 4 == 1, "other").otherwise("negative").alias("pred_coarse"),
        F.concat(F.lit("c"), lab.cast("string"), F.when(v % 3 == 0, ", c1").otherwise("")).alias("true_text"),
        F.concat(F.lit(" c"), ((lab + v) % 11).cast("string"), F.lit(", c2")).alias("pred_text"),
        F.concat(F.lit("c"), lab.cast("string"), F.expr("repeat('; c1', CAST(vec_id % 3 AS INT))")).alias("true_seq"),
        F.concat(
            F.lit("c"), ((lab + v) % 11).cast("string"), F.expr("repeat('; c2', CAST((vec_id + 1) % 3 AS INT))")
        ).alias("pred_seq"),
    )
