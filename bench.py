"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs to completion on the ``noop`` sink (full execution, nothing
collected), ``BENCH_RUNS`` times (default 3); the best run is reported, the
first one doubling as warm-up for JIT and code generation.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from skyledger.plans.registry import QUERIES  # noqa: E402
from skyledger.session import build_session  # noqa: E402

HEADLINE = [
    "nearest_place",            # C1
    "avg_city_temperature",     # D1 / H1 windows
    "drones_per_org",           # D2
    "drones_per_city",          # D3
    "get_temperature",          # D4 + G2 (flagship slice)
    "commit_outcomes",          # E1 + E2
    "cart_fold_outcomes",       # H5 batch twin
    "arrival_window_city_temperature",   # H2 batch twin
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus, app_name="skyledger-bench")
    QUERIES["get_temperature"](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    n_events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    times = {}
    for name in HEADLINE:
        best = None
        for _ in range(runs):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
            spark.catalog.clearCache()
        times[name] = round(best, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""), "cpus": cpus,
        "runs_per_query": runs, "timing": "best of runs, each a full execution from parquet",
        "input_events": n_events,
        "events_per_sec": {k: round(n_events / v, 1) for k, v in times.items() if v > 0},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
