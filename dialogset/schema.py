"""Explicit schemas (no inference anywhere)."""

from pyspark.sql import types as T

CONV_KEYS = ["user_id", "thread_id", "conv_id"]

MESSAGES = T.StructType(
    [
        T.StructField("user_id", T.LongType(), False),
        T.StructField("thread_id", T.LongType(), False),
        T.StructField("conv_id", T.LongType(), False),
        T.StructField("line_num", T.LongType(), False),
        T.StructField("author", T.StringType(), True),
        T.StructField("text", T.StringType(), True),
        T.StructField("label", T.ArrayType(T.IntegerType()), True),
        T.StructField("is_annotated", T.BooleanType(), True),
    ]
)

RUN_CONFIG = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("tag", T.StringType()),
        T.StructField("dir", T.StringType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("max_length", T.IntegerType()),
        T.StructField("epochs", T.IntegerType()),
        T.StructField("target_names", T.ArrayType(T.StringType())),
        T.StructField("per_device_batch", T.IntegerType()),
        T.StructField("learning_rate", T.DoubleType()),
        T.StructField("save_total_limit", T.IntegerType()),
        T.StructField("early_stopping_patience", T.IntegerType()),
        T.StructField("logging_strategy", T.StringType()),
        T.StructField("evaluation_strategy", T.StringType()),
        T.StructField("save_strategy", T.StringType()),
        T.StructField("gradient_acc", T.IntegerType()),
    ]
)

METRICS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("split_id", T.StringType()),
        T.StructField("tag", T.StringType()),
        T.StructField("metric", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)
