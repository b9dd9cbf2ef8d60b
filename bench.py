"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from trellis import suite

HEADLINE = [
    "scan_label", "filtered_scan", "single_hop", "filtered_hop", "two_hop", "three_hop_aggregate", "aggregation_count", "aggregation_avg",
    "pricing_summary", "variable_length", "optional_match", "exists_semi", "top_k", "set_from_aggregate", "window_tumbling",
    # 15,000 people and 75,000 edges at sf0.1
    "people_scan", "people_filtered_scan", "people_single_hop", "people_filtered_hop", "people_two_hop", "people_count", "people_avg",
    "people_variable_length", "people_reachable",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(3):
            began = time.perf_counter()
            suite.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        times[name] = round(best, 4)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
