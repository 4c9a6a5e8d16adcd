"""Times the headline queries: prints one JSON line. BENCH_SF_DIR, BENCH_CPUS and BENCH_RUNS choose tables, cores and runs."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

HEADLINE = (
    "tree_count_chain4", "tree_count_star", "tree_count_q9", "tree_count_binary_l3", "tree_count_ternary_l3",
    "join_native_q9", "join_reduce_q9", "join_serial_q9", "join_count_expand_q9", "reduced_sizes", "max_contribution", "answer_at_index_range",
    "h1", "h3", "h5", "h9", "h18", "rollup_avg", "cume_window", "topn_per_group",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from treeline.queries import QUERIES

    times = {}
    for name in sys.argv[1:] or HEADLINE:
        best = None
        for _ in range(runs + 1):  # the first run warms up
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - began
            best = took if best is None or took < best else best
        times[name] = round(best, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
