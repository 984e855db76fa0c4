import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from dialogset.session import ensure_checkpoint_dir

    s = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "16k")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    yield s


def message_frame(spark, convs):
    """convs: list of (conv_id, texts, labels[, user_id]) -> MESSAGES frame
    with line numbers 10, 20, ... (not consecutive on purpose)."""
    from dialogset.schema import MESSAGES

    rows = []
    for c in convs:
        conv, texts, labels = c[0], c[1], c[2]
        user = c[3] if len(c) > 3 else 1
        for i, (t, l) in enumerate(zip(texts, labels)):
            rows.append((user, 0, conv, 10 * (i + 1), "a", t, l, True))
    return spark.createDataFrame(rows, MESSAGES)
