"""Headline queries, timed.  Prints one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the number of local cores.  Every query
runs once to warm up and once timed; plan building, which may include jobs, is part of
the time.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.queries import QUERIES  # noqa: E402

HEADLINE = [
    "d14_long_profile",  # monthly profile of all columns with two slices, sketches
    "d14_exact_profile",  # the same with exact distinct counts and medians
    "d17_mergeable_base",  # the same kind of metrics in one pass with sketches
    "e6_ks_test",  # distribution tests, numeric
    "e8_total_variation",  # distribution tests, categorical
    "d16_incremental_refresh",
    "i3_weighted_bootstrap",
    "i8_median_interval",
    "i10_drift_thresholds_from_counts",
    "k4_process_requests",
    "n2_numeric_or_categorical",
    "n5_english_confidence",
    "d26_usage_rollup",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    seconds: dict[str, float] = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(sf[1]) if sf else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
