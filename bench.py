"""Benchmark the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Runs each query to completion (a full aggregate over the result, so every
row is produced) and prints ONE JSON line with per-query seconds (median
of ``BENCH_REPEATS`` runs, default 1). Before timing, every headline query runs once on the
smallest tables (``BENCH_WARMUP_DIR``) so JVM code generation and Python
workers are warm; no data of the measured scale is cached. Times include
building the plan (which runs the small planning jobs, e.g. group sizes)."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

HEADLINE = [
    "s1_load_messages",
    "a1_conversations",
    "w4a_one_sided",
    "w4a_one_sided_1000",
    "w4a_one_sided_lines",
    "w4b_two_sided",
    "w4b_two_sided_lines",
    "w5_first_dedup",
    "w6_last_context_dedup",
    "w7_dev_test_cut",
    "w10_build_dataset",
    "f4_oversample",
    "a14_roc_auc",
    "a17_subsample_ci",
    "a17_subsample_ci_cells",
    "k4_binary_report",
    "k6_generated_per_utterance",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    from dialogset.operators.intervals import subsample_interval
    from dialogset.plans.registry import QUERIES, scored
    from dialogset.session import get_spark

    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=max(cpus, 8))

    def cells(spark, sf):
        s = scored(spark, sf).select("row_id", F.col("true_class").alias("true"), F.col("pred_class").alias("pred"))
        return subsample_interval(s, mode="cells", repeats=200)

    queries = dict(QUERIES)
    queries["a17_subsample_ci_cells"] = cells

    def run(name):
        df = queries[name](spark, sf_dir)
        # consume every row and column without moving the result to the driver
        return df.select(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*df.columns)).alias("h")).collect()[0]

    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir):
        for name in HEADLINE:
            df = queries[name](spark, warm_dir)
            df.select(F.count(F.lit(1))).collect()
    times = {}
    for name in HEADLINE:
        runs = []
        for _ in range(repeats):
            t = time.perf_counter()
            run(name)
            runs.append(time.perf_counter() - t)
        times[name] = round(statistics.median(runs), 3)
    sf = sf_dir.rsplit("sf", 1)[-1]
    out = {
        "metric": "total_seconds_headline_queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
