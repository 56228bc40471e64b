"""Step events: the start record and the exit record of a timed step, and the facts behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lakelog.functions.text import MESSAGE_LIMIT, truncate
from lakelog.operators.slices import TIME_BITS, with_next
from lakelog.schemas import LOG_RECORDS, RUN_KEY

LOGGER = "lakelog.steps"
START, STEP_OK, STEP_FAILED = "start", "ok", "failed"
EXITS = (STEP_OK, STEP_FAILED)


def merge_metrics(attrs: Column, metrics: Column) -> Column:
    """Attributes and metrics in one map; where both have a key the metric wins, even with a null value."""
    none = F.create_map().cast("map<string,string>")
    attrs, metrics = F.coalesce(attrs, none), F.coalesce(metrics, none)
    return F.map_concat(F.map_filter(attrs, lambda k, _: ~F.map_contains_key(metrics, k)), metrics)


def step_events(facts: DataFrame, logger: str = LOGGER) -> DataFrame:
    """Log records of steps: a start each, and an ok or failed exit unless the step is still open.

    ``facts``: pipeline_run_id, pipeline_name, child_index, step, started_at, duration_ms (null while open),
    error_class, error_message, attrs, metrics. Attributes stand on every record, metrics on the ok record only.
    """
    twice = facts.withColumn(
        "_exit", F.explode(F.array_compact(F.array(F.lit(False), F.when(F.col("duration_ms").isNotNull(), True))))
    )
    leaves, failed, step = F.col("_exit"), F.col("error_class").isNotNull(), F.col("step")
    failure = leaves & failed
    finished = F.timestamp_micros(F.unix_micros("started_at") + F.col("duration_ms") * 1000)
    values = {
        "ts": F.when(leaves, finished).otherwise(F.col("started_at")),
        "level": F.when(failure, "ERROR").otherwise("INFO"),
        "logger": F.lit(logger),
        "msg": F.when(~leaves, F.concat(F.lit("step start: "), step))
        .when(failed, F.concat(F.lit("step failed: "), step, F.lit(" ("), F.col("error_class"), F.lit(")")))
        .otherwise(F.concat(F.lit("step ok: "), step, F.lit(" ("), F.col("duration_ms").cast("string"), F.lit("ms)"))),
        "phase": F.when(~leaves, START).when(failed, STEP_FAILED).otherwise(STEP_OK),
        "duration_ms": F.when(leaves, F.col("duration_ms")),
        "error_class": F.when(leaves, F.col("error_class")),
        "error_message": F.when(failure, truncate(F.coalesce("error_message", F.lit("")), MESSAGE_LIMIT)),
        "exc_info": F.lit(None),
        "metrics": F.when(leaves & ~failed, F.col("metrics")),
    }
    return twice.select(
        *[values.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in LOG_RECORDS.fields]
    )


def with_run_id(records: DataFrame, run_id: str | None) -> DataFrame:
    """Stamp the active run id on records that carry none; no active run leaves them as they are."""
    return records.withColumn(RUN_KEY, F.coalesce(RUN_KEY, F.lit(run_id).cast("string")))


def step_spans(records: DataFrame) -> DataFrame:
    """One row per finished step, from its exit record alone."""
    started = F.timestamp_micros(F.unix_micros("ts") - F.col("duration_ms") * 1000)
    return records.where(F.col("phase").isin(*EXITS)).select(
        RUN_KEY,
        "child_index",
        "step",
        "phase",
        started.alias("started_at"),
        F.col("ts").alias("finished_at"),
        "duration_ms",
        "error_class",
    )


def open_steps(records: DataFrame, bits: int = TIME_BITS) -> DataFrame:
    """Starts whose next record of the same (run, step) is not an exit.

    Records carry no step id, so overlapping steps of one name cannot be told apart. At one instant starts come
    before exits, for a step of zero length.
    """
    steps = records.where(F.col("phase").isin(START, *EXITS)).select(
        RUN_KEY, "step", "ts", "phase", (F.col("phase") != START).alias("_exit")
    )
    followed = with_next(steps, [RUN_KEY, "step"], ["ts", "_exit"], "phase", F.unix_micros("ts"), "_next", bits)
    stays_open = (F.col("phase") == START) & ~F.coalesce(F.col("_next").isin(*EXITS), F.lit(False))
    return followed.where(stays_open).select(RUN_KEY, "step", F.col("ts").alias("started_at"))


def latest_metrics(writes: DataFrame, order: list[str]) -> DataFrame:
    """The last value written per (run, step, key) of ``(run, step, key, value, <order columns>)``.

    Long form, so no step's metrics are gathered into one row.
    """
    return writes.groupBy(RUN_KEY, "step", "key").agg(F.max_by("value", F.struct(*order)).alias("value"))
