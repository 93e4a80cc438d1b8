"""Time the headline queries: prints one JSON line.

``BENCH_SF_DIR`` names the table folder (default sf0.1), ``BENCH_CPUS`` the
number of local cores (default 8).  Each query is run once, its rows written to
the no-op sink, so that every row is produced and none is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog.queries import queries  # noqa: E402
from gaugework.session import build_session  # noqa: E402

HEADLINE = (
    "detect_types", "numeric_stats", "numeric_stats_messy", "categorical_stats", "top_values", "text_stats",
    "normaltest", "datetime_gaps", "missing_per_column", "missing_related", "outlier_summary", "exact_duplicates",
    "near_duplicates", "pearson", "cramers_v", "dataset_summary", "recommendations", "ffill", "dedup_first",
    "to_datetime", "outlier_cap", "clean_pipeline", "scan_csv", "histogram", "kde",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
            "spark.sql.shuffle.partitions": cpus,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/orders.parquet").count()  # start the session before the clock
    known, times = queries(), {}
    for name in HEADLINE:
        started = time.perf_counter()
        known[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
