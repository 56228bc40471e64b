"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data folder and ``BENCH_CPUS`` the number of local cores. Every query runs once to warm
the session up and once for the clock, and its rows are all computed and thrown away.
"""

from __future__ import annotations

import json
import os
import tempfile
import time
from datetime import datetime

from pyspark.sql import SparkSession
from pyspark.sql.types import StructField, StructType

from lakelog.plans.catalogue import QUERIES
from lakelog.schemas import RUNLOG
from lakelog.sinks.tables import append_rows, ensure_log_table

HEADLINE = [
    "scan_lake_counts",
    "search_numeric",
    "search_substring_ci",
    "search_or",
    "search_and",
    "search_lake",
    "search_summary",
    "search_results",
    "dirty_columns",
    "safe_names",
    "runlog_build",
    "runlog_skip",
    "runlog_first_failure",
    "runlog_detail",
    "run_summary",
    "run_summary_top20",
    "runlog_join_activity",
    "runlog_join_steps",
    "runlog_append",
    "log_json_roundtrip",
    "step_spans",
    "step_open",
    "step_metrics",
    "stream_run_summary",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lakelog-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", f"{scratch}/warehouse")
        .config("spark.checkpoint.dir", f"{scratch}/checkpoint")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # no call-site lookup per expression
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in HEADLINE:
        run(name)
        seconds[name] = round(run(name), 3)

    # Two rows in one commit: the one write the baseline gives a time for.
    values = ["r", "p", 0, "/n", "ok", datetime(2024, 1, 1), datetime(2024, 1, 1), 0, "", "{}", "", "", "", "", None]
    rows = spark.createDataFrame([tuple(values), tuple([*values[:2], 1, *values[3:]])], StructType(
        [StructField(f.name, f.dataType, True) for f in RUNLOG.fields]
    ))
    ensure_log_table(spark, "bench.runlog")
    for _ in range(2):
        start = time.perf_counter()
        append_rows(rows, "bench.runlog")
        seconds["append_two_rows"] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
