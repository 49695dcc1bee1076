"""Times the headline queries on one session and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 4), BENCH_REPEATS (default 3, the median counts).
Results go to the noop sink, so every column is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ("episode_accuracy", "bin_features", "norm_stats", "session_fingerprint", "step_sample", "delivery_frontier", "dup_groups",
            "pair_global", "pair_diagonal", "pair_pma", "pair_softdtw", "support_agg_compatibility", "recognize", "open_set_eval",
            "auroc_fpr95", "spearman_ci", "truncation_curve")


def main() -> None:
    from pyspark.sql import SparkSession

    from sessionloom.plans.catalog import REGISTRY

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("sessionloom-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    REGISTRY["episode_accuracy"][0](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        runs = []
        for _ in range(repeats):
            started = time.perf_counter()
            REGISTRY[name][0](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - started)
        times[name] = round(statistics.median(runs), 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": folder.rsplit("sf", 1)[-1], "cpus": int(cpus), "repeats": repeats}))


if __name__ == "__main__":
    main()
