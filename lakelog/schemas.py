"""Explicit schemas; nothing in this package infers one from data."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(columns: str, nullable: bool = True) -> T.StructType:
    """``"a string, b long"`` to a StructType, without needing a session."""
    maps = T.MapType(T.StringType(), T.StringType())
    out = T.StructType()
    for column in columns.split(","):
        name, kind = column.split()
        out = out.add(name, maps if kind == "map" else kind, nullable)
    return out


# The fifteen run-log columns, in table order, and the status words.
RUNLOG = _struct(
    "pipeline_run_id string, pipeline_name string, child_index long, notebook_path string, status string, "
    "started_at timestamp, finished_at timestamp, duration_ms long, exit_value string, args_json string, "
    "error_class string, error_message string, error_traceback string, orchestrator_notebook string, "
    "audited_at timestamp",
    nullable=False,
)
#: The column that a run log partitioned by day has behind the fifteen: the UTC day a child started on.
DAY = "started_on"
OK, FAILED, TIMEOUT, SKIPPED = "ok", "failed", "timeout", "skipped"

# One row per planned child; the run header repeats on each of its children.
PLAN = _struct(
    "pipeline_run_id string, pipeline_name string, log_table string, child_index long, path string, name string, "
    "timeout_seconds integer, args map, fail_fast boolean, extras map"
)

# One row per attempted child; a child that raised carries an error class, a message or both.
OUTCOME = _struct(
    "pipeline_run_id string, child_index long, started_at timestamp, finished_at timestamp, duration_ms long, "
    "returned string, error_class string, error_message string, error_traceback string"
)

LOG_RECORDS = _struct(
    "ts timestamp, level string, logger string, msg string, pipeline_run_id string, pipeline_name string, "
    "child_index long, step string, phase string, duration_ms long, error_class string, error_message string, "
    "exc_info string, attrs map, metrics map"
)

# The keys of a JSON log line, in line order. Attribute and metric maps stay off the line.
LOG_LINE_KEYS = [f.name for f in LOG_RECORDS.fields if f.name not in ("attrs", "metrics")]

RUN_SUMMARY = _struct(
    "pipeline_run_id string, children long, failed long, run_start timestamp, run_end timestamp"
)

LAKE_COLUMNS = _struct("database string, table string, column string, data_type string, ordinal integer")
SKIPPED_TABLES = _struct("database string, table string, reason string")
RUN_KEY = "pipeline_run_id"
CHILD_KEY = [RUN_KEY, "child_index"]
