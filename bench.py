"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8)
set the data and the cores. The session is warmed up by one report over JSON
documents; then each query is built and fully read, and the median of three such
runs counts. The value is the sum over all queries.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from runlens.session import build_session

HEADLINE = (
    "a00_horizon",
    "a01_slow_mean",
    "a03_full_scans",
    "a04_insights",
    "a05_failed",
    "a14_index_report",
    "a15_hot_objects",
    "a16_waiting",
    "a17_blocking",
    "a18_failed_txns",
    "a19_write_hotspots",
    "a20_slow_performers",
    "a21_random_sample",
    "a22_offset_sample",
    "a23_latency",
    "a24_run_compare",
    "a25_keyed_update",
    "e17_root_cause",
    "i05_live_slices",
    "i07_contention",
    "i08_insights_dedupe",
    "i10_stmt_upsert",
    "i16_backfill_per_column",
    "m08_alert_lag",
    "r04_duplicates",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    from catalogue.queries import queries

    registered = queries()
    registered["a03_full_scans"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            began = time.perf_counter()
            registered[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(runs), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
