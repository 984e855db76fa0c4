"""Print the formatted physical plans of registered queries.

    python -m checks.plans [sf_dir] [query ...]

Shows exchanges (shuffle keys), join strategies, pushed filters and read
schemas, i.e. what to review when changing an operator."""

from __future__ import annotations

import sys


def main(argv):
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:] or ["w10_build_dataset", "w4b_two_sided", "w6_last_context_dedup", "a17_subsample_ci"]
    sys.path.insert(0, ".")
    from dialogset.plans.registry import QUERIES
    from dialogset.session import get_spark

    spark = get_spark()
    for name in names:
        print(f"==================== {name}")
        QUERIES[name](spark, sf).explain("formatted")


if __name__ == "__main__":
    main(sys.argv)
