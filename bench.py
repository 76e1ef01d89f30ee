"""Headline queries, timed end to end on local Spark; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "panel_features",
    "feature_table",
    "impute",
    "training_counts",
    "prediction_facts",
    "backtest_metrics",
    "leaderboard_wide",
    "performance_over_time",
    "retention",
    "complexity_profile",
    "build_summary",
    "explore_paths",
    "numeric_summary",
    "lagged_correlations",
    "correlation_by_snapshot",
    "linear_backtest_pooled",
    "linear_backtest_series",
    "missing_months",
    "changed_payloads",
]


def main() -> None:
    from hindcast.plans.catalog import QUERIES
    from hindcast.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "hindcast-bench")
    # Load classes and compile the common paths once on the smallest tables.
    warm = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    if os.path.isdir(warm):
        for name in HEADLINE:
            QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
    timings = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - started, 3)
    per_fit = {}
    if os.path.isdir(warm):  # the size of the published champion, on the smallest tables
        started = time.perf_counter()
        rows = QUERIES["boosted_backtest"](spark, warm).select("series", "fit_date", "config_id").distinct().count()
        per_fit = {"boosted_500_trees": round((time.perf_counter() - started) / max(rows, 1), 4), "published": 0.179}
    print(
        json.dumps(
            {
                "metric": "headline_total_seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "seconds_per_fit": per_fit,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
