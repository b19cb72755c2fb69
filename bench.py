"""Time the headline queries and print one JSON line.

BENCH_SF_DIR   table folder     (default /root/testdata/sf0.1)
BENCH_CPUS     local cores      (default 8)
BENCH_RUNS     timed runs each  (default 3; the median is reported, after one warm-up run)
BENCH_QUERIES  comma-separated names, or "all"
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from tickersift.registry.queries import QUERIES
from tickersift.session import local_session

HEADLINE = (
    "bars_weekly",
    "bars_monthly",
    "moving_averages",
    "latest_ma",
    "session_panel",
    "rank_by_next_return",
    "screen_valley_turnover",
    "screen_cross_all_ma",
    "screen_turnover_surge",
    "screen_weekly_rising",
    "screen_high_transfer",
    "forecast_enrich",
    "ledger_profit",
    "ledger_cashflow",
    "page_links",
    "page_records",
    "page_link_follow",
    "page_chapters",
)


def timed(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else list(HEADLINE)
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench", shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    for _ in range(2):  # let the JVM compile before anything is measured
        timed(spark, "screen_cross_all_ma", sf_dir)
    seconds = {}
    for name in names:
        timed(spark, name, sf_dir)
        seconds[name] = round(statistics.median(timed(spark, name, sf_dir) for _ in range(runs)), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
    spark.stop()
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
