"""Time the headline queries and print one JSON line.

Environment: ``BENCH_SF_DIR`` (tables), ``BENCH_CPUS`` (local cores),
``BENCH_RUNS`` (timed runs per query, the median counts).  Every query is run
once untimed first and written to a sink that keeps all rows and columns.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))
HEADLINE = [
    "daily_counts", "side_features", "grid_daily", "grid_hourly", "prior_3m", "prior_28d", "panel_daily", "panel_hourly",
    "prior_shifted", "rollup_week", "rollup_month", "rollup_anchored", "last_snapshot", "forecast_grid", "tiers",
    "topk_per_window", "time_split", "undersample", "impute_median", "valid_columns", "pr_curve", "best_f1", "horizon_hours",
]


def main() -> None:
    from riskloom.plans.queries import QUERIES
    from riskloom.session import build_session

    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{CPUS}]", spark__sql__shuffle__partitions=CPUS, spark__driver__memory="16g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in names:
        timings = []
        for run in range(RUNS + 1):
            start = time.perf_counter()
            QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
            if run:
                timings.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(timings), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
