"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from rangevec.plans import catalog

HEADLINE = [
    "exact_knn", "exact_knn_range_shared", "exact_knn_range_per_query", "exact_knn_kernel", "radius_search", "hybrid_weighted", "assign_fine", "assign_fine_arrow",
    "lloyd_step_1", "ivf_search", "two_level_search", "two_level_range_pruned", "budgeted_scan", "prefix_budget_scan", "scalar_synopsis", "scalar_utility",
    "imbalance_metrics", "delete_then_search", "pq_adc_topk", "beam_repair_search",
]


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["exact_knn_kernel"](spark, d).count()  # starts workers and compiles code
    took = {}
    for name in HEADLINE:
        began = time.time()
        catalog.QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": d.rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
