"""Reports over the run log. The aggregates work on batch and streaming DataFrames alike."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from lakelog.schemas import CHILD_KEY, DAY, RUN_KEY


def _of_pipeline(runlog: DataFrame, pipeline_name: str | None) -> DataFrame:
    return runlog if pipeline_name is None else runlog.where(F.col("pipeline_name") == pipeline_name)


def run_detail(runlog: DataFrame, pipeline_name: str | None = None) -> DataFrame:
    """Children of a pipeline's runs, latest run id first. The sort ranges over (run, child), so a huge run splits."""
    return (
        _of_pipeline(runlog, pipeline_name)
        .select(
            *CHILD_KEY,
            "notebook_path",
            "status",
            (F.col("duration_ms") / 1000).alias("seconds"),
            "error_class",
            "error_message",
        )
        .orderBy(F.desc(RUN_KEY), "child_index")
    )


def _summary() -> list[Column]:
    return [
        F.count("*").alias("children"),
        F.sum(F.when(F.col("status") == "failed", 1).otherwise(0)).alias("failed"),
        F.min("started_at").alias("run_start"),
        F.max("finished_at").alias("run_end"),
    ]


def run_summary(runlog: DataFrame, pipeline_name: str | None = None) -> DataFrame:
    """Children, failed children (timeouts not among them), start and end per run."""
    return _of_pipeline(runlog, pipeline_name).groupBy(RUN_KEY).agg(*_summary())


def merge_summaries(parts: DataFrame) -> DataFrame:
    """The summary of all rows from summaries of some of them each; a run may be in any number of parts."""
    return parts.groupBy(RUN_KEY).agg(
        F.sum("children").alias("children"),
        F.sum("failed").alias("failed"),
        F.min("run_start").alias("run_start"),
        F.max("run_end").alias("run_end"),
    )


def closed_runs(runlog: DataFrame, idle: str, late: str = "0 seconds") -> DataFrame:
    """The summary of every run that is over: no child ended for ``idle`` after its last one.

    On a stream, in append mode, a run is reported once, when the watermark (the newest end seen, less ``late``) has
    passed its last end by ``idle``, and only runs that are still open are kept in the state. Rows that end before the
    watermark are not counted any more: ``late`` is how much later than others a row may come. A run that goes on
    after it was reported is reported again, with its further children. In a batch all runs are over.
    """
    sessions = runlog.withWatermark("finished_at", late).groupBy(RUN_KEY, F.session_window("finished_at", idle))
    return sessions.agg(*_summary()).drop("session_window")


def latest_runs(
    runlog: DataFrame, pipeline_name: str | None = None, runs: int = 20, since: dt.date | None = None
) -> DataFrame:
    """The runs that started last; equal starts are ordered by run id so the cut is the same every time.

    ``since`` leaves out children that started before that day; a table partitioned by day reads the days from it on.
    """
    if since is not None:
        runlog = runlog.where(F.col("started_at") >= F.lit(since).cast("timestamp"))
        runlog = runlog.where(F.col(DAY) >= F.lit(since)) if DAY in runlog.columns else runlog
    return run_summary(runlog, pipeline_name).orderBy(F.desc("run_start"), RUN_KEY).limit(runs)


def with_activity(runlog: DataFrame, activity: DataFrame) -> DataFrame:
    """Run-log rows with the scheduler's record of their run (one record per run id); runs known to both sides."""
    return runlog.join(activity, RUN_KEY)


def _step_totals(spans: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    return spans.groupBy(*keys).agg(
        F.count("*").alias(f"{prefix}_steps"),
        F.sum(F.when(F.col("phase") == "failed", 1).otherwise(0)).alias(f"{prefix}_steps_failed"),
        F.sum("duration_ms").alias(f"{prefix}_step_ms"),
    )


def with_steps(runlog: DataFrame, spans: DataFrame) -> DataFrame:
    """Every run-log row with the totals of its own steps and of its run's steps that name no child.

    AQE splits the rows of a run that is far larger than others. The steps are added up before the join; joining them
    one by one would repeat every run-level step on every child of the run.
    """
    own = _step_totals(spans.where(F.col("child_index").isNotNull()), CHILD_KEY, "child")
    shared = _step_totals(spans.where(F.col("child_index").isNull()), [RUN_KEY], "run")
    joined = runlog.join(own, CHILD_KEY, "left").join(shared, RUN_KEY, "left")
    return joined.fillna(0, [c for c in joined.columns if c.startswith(("child_step", "run_step"))])
