"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from gridloom.plans import registry
from gridloom.session import session

NAMES = ("q_selection_delta", "q_metric_summary", "q_counting_error", "q_stratified_split", "q_holdout_split", "q_label_audit", "q_heatmap", "q_eta_fold", "q_running_seconds", "q_box_overlap", "q_prioritised_match", "q_audit_report")

#: Timed runs of each query, after one that is not; the median counts.
RUNS = 3


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    spark = session("bench", cpus=cpus, shuffle_partitions=cpus, **{"spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/region.parquet").count()
    took = {}
    for name in NAMES:
        runs = []
        for _ in range(1 + RUNS):  # the first warms up what the query compiles
            began = time.perf_counter()
            registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(statistics.median(runs[1:]), 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
