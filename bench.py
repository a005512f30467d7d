"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list or "all"),
BENCH_RUNS (timed runs after one warm-up, default 1; the median counts).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from wardlens.catalog import load
from wardlens.session import build_session

HEADLINE = [
    "ward_windows", "anomaly_windows", "parsed_messages", "arrival_order_windows", "running_rainfall", "counter_rates",
    "pixel_indices", "satellite_features", "latest_weather", "merged_scores", "refreshed_scores", "latest_table",
    "threshold_alerts", "hourly_forecast", "budgeted_recommendations", "benefit_recommendations", "projected_effects",
    "city_scenarios", "live_ward_weather", "risk_kpis", "top_combined_wards", "quality_report", "drift_report",
    "regression_metrics", "node_error_percentiles", "exact_percentiles", "rolling_rewards", "early_stopping",
    "nearest_neighbours", "pairs_within", "ward_graph", "neighbour_means", "located_reports", "sliding_samples",
    "training_windows", "top_features", "image_verdicts", "accepted_reports", "streamed_windows",
]


def run_once(query, spark, folder: str) -> float:
    start = time.perf_counter()
    query.run(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    catalog = load()
    names = list(catalog) if wanted == "all" else (wanted.split(",") if wanted else HEADLINE)
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
                          spark__ui__showConsoleProgress="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        run_once(catalog[name], spark, folder)
        times[name] = round(statistics.median(run_once(catalog[name], spark, folder) for _ in range(runs)), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
