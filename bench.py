"""Times the headline queries: one JSON line with seconds per query, the better of two runs."""
from __future__ import annotations

import json
import os
import tempfile
import time

from gate import views
from gate.catalog import QUERIES
from fareloom.session import build_session

HEADLINE = [
    "daily_fare", "weekly_fare", "monthly_fare", "route_analysis", "airline_analysis", "booking_window_by_route",
    "weekday_weekend", "fare_distribution", "index_route_daily", "index_daily", "index_weekly", "backtest_metrics",
    "market_features", "outlier_route_iqr", "dedup_records", "record_id", "join_search_metadata", "fare_summary",
    "quality_summary", "filter_observations", "flights_query", "filter_values", "paginate", "flatten_responses",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g",
        "spark.checkpoint.dir": os.environ.get("BENCH_WORK_DIR") or tempfile.mkdtemp(prefix="bench-"),
    })
    spark.sparkContext.setLogLevel("ERROR")
    begin = time.perf_counter()
    views.sparse(spark, sf_dir).count(), views.landed(spark, sf_dir).count()
    prepare = time.perf_counter() - begin
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            begin = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - begin)
        seconds[name] = round(min(runs), 3)
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "prepare_sec": round(prepare, 3), "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
