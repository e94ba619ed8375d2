"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from panelyard.session import build_session  # noqa: E402
from workload.queries import QUERIES  # noqa: E402

HEADLINE = [
    "screen_page", "screen_masked", "search", "movers", "group_medians_sector", "group_medians_industry",
    "group_medians_bucketed", "headline", "breadth_by_industry", "valuation_by_tier", "factor_overlap", "factor_stats",
    "percentile_ranks", "percentile_ranks_bucketed", "derived_trend", "quarterly_summary", "yearly_summary",
    "record_verdicts", "wide_assembly", "record_profit_counts", "snapshot_changes", "screen_changes",
    "universe_series", "split_factors", "lifetime_highs", "relative_strength_211", "repaired_state", "scan_results",
    "merged_list", "coverage_report", "compare",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["group_medians_sector"](spark, sf).collect()  # JVM and file-system warm-up
    times = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(min(runs), 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
