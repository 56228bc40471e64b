"""The run log from planned children and their outcomes, as set operations.

A run is a list of children executed one after another. ``plan`` has a row per planned child, ``outcome`` a row per
attempted child. The sequential rule "after the first child that is not ok, skip the rest" needs no ordered pass:
the first such index per run is an aggregate, and a child is skipped when its index is larger.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from lakelog.functions import text
from lakelog.operators.slices import SLICE_BITS, join_run_slices, spread_over_children
from lakelog.schemas import CHILD_KEY, RUN_KEY, RUNLOG, SKIPPED

DEFAULT_TIMEOUT_SECONDS = 1800
AUDITED_AT = "audited_at"
DISPLAY_NAME = "display_name"


def plan_defaults(plan: DataFrame, default_timeout_seconds: int = DEFAULT_TIMEOUT_SECONDS) -> DataFrame:
    """The plan with its timeout, fail-fast flag and display name filled in."""
    return plan.withColumns(
        {
            "timeout_seconds": F.coalesce("timeout_seconds", F.lit(default_timeout_seconds)),
            "fail_fast": F.coalesce("fail_fast", F.lit(True)),
            "display_name": text.display_name(F.col("name"), F.col("path")),
        }
    )


def with_run_ids(plan: DataFrame, header: list[str], call_id: str | None = None) -> DataFrame:
    """Give every row of a run the same id: the supplied one if not empty, else a fresh version-4 UUID.

    The fresh id is a hash of the header columns and a random id of this call. It needs no shuffle, and a task that
    runs again after a lost executor produces the same id, which a random function would not.
    """
    digest = F.md5(F.concat_ws("\x1f", F.lit(call_id or str(uuid.uuid4())), *[F.col(c).cast("string") for c in header]))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    fresh = F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("4"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )
    return plan.withColumn(RUN_KEY, F.coalesce(F.nullif(F.col(RUN_KEY), F.lit("")), fresh))


def _raised() -> Column:
    return F.col("error_class").isNotNull() | F.col("error_message").isNotNull()


def _halts(plan: DataFrame, outcome: DataFrame) -> DataFrame:
    """Runs that stopped early: first non-ok child, when it ended, and the last child that can be skipped.

    Reads the failed outcomes only, and of those three columns; counts them only for planned children. The
    aggregate combines on the map side, so a run of any size reaches the reducer as one row per map task.
    """
    failures = outcome.where(_raised()).select(*CHILD_KEY, "finished_at", F.lit(True).alias("_failed"))
    children = plan.select(*CHILD_KEY, F.coalesce("fail_fast", F.lit(True)).alias("_stops"))
    failed_index = F.when(F.col("_failed"), F.col("child_index"))
    halts = (
        children.join(failures, CHILD_KEY, "left")
        .groupBy(RUN_KEY)
        .agg(
            F.max(F.when(F.col("_stops"), F.col("child_index"))).alias("_last"),
            F.min(failed_index).alias("_halt"),
            F.min_by("finished_at", failed_index).alias("_halted_at"),
        )
    )
    return halts.where(F.col("_halt") < F.col("_last"))


def build_runlog(
    plan: DataFrame,
    outcome: DataFrame,
    orchestrator_notebook: str = "",
    slice_bits: int = SLICE_BITS,
    display_names: bool = False,
) -> DataFrame:
    """Run-log rows without the write stamp: one row per child that ran or was skipped.

    ``display_names`` adds the column ``display_name``, which console lines show and the log table does not hold.

    A planned child that neither ran nor was skipped (its run crashed) has no row. A skipped child starts and ends
    when the failure that caused the skip ended. The wide outcome rows are shuffled once, by child; the plan is
    shuffled by (run, slice) for the skip rule and by child for the outcome.
    """
    spread = spread_over_children(_halts(plan, outcome), F.col("_halt"), F.col("_last"), slice_bits, plan)
    planned = join_run_slices(plan, spread, "left", slice_bits).select(
        *CHILD_KEY,
        "pipeline_name",
        "path",
        "args",
        *([text.display_name(F.col("name"), F.col("path")).alias(DISPLAY_NAME)] if display_names else []),
        (F.coalesce("fail_fast", F.lit(True)) & (F.col("child_index") > F.coalesce("_halt", "child_index"))).alias(
            "_skipped"
        ),
        "_halted_at",
    )
    rows = planned.join(outcome.withColumn("_ran", F.lit(True)), CHILD_KEY, "left")
    skipped = F.col("_skipped")

    def unless_skipped(value: Column, instead: Column) -> Column:
        return F.when(skipped, instead).otherwise(value)

    empty = F.lit("")
    measured = F.coalesce("duration_ms", F.timestamp_diff("MILLISECOND", F.col("started_at"), F.col("finished_at")))
    ended_well = F.when(~_raised(), F.col("returned"))
    values = {
        "notebook_path": F.col("path"),
        "status": unless_skipped(text.status(F.col("error_class"), F.col("error_message")), F.lit(SKIPPED)),
        "started_at": unless_skipped(F.col("started_at"), F.col("_halted_at")),
        "finished_at": unless_skipped(F.col("finished_at"), F.col("_halted_at")),
        "duration_ms": unless_skipped(measured, F.lit(0).cast("long")),
        "exit_value": unless_skipped(F.coalesce(ended_well, empty), empty),
        "args_json": text.args_json(F.col("args")),
        "error_class": unless_skipped(F.coalesce("error_class", empty), empty),
        "error_message": unless_skipped(
            text.truncate(F.coalesce("error_message", empty), text.MESSAGE_LIMIT), empty
        ),
        "error_traceback": unless_skipped(
            text.truncate(F.coalesce("error_traceback", empty), text.TRACEBACK_LIMIT), empty
        ),
        "orchestrator_notebook": F.lit(orchestrator_notebook),
    }
    return rows.where(skipped | F.col("_ran")).select(
        *[values[name].alias(name) if name in values else F.col(name) for name in RUNLOG.names if name != AUDITED_AT],
        *([DISPLAY_NAME] if display_names else []),
    )


def stage(rows: DataFrame) -> DataFrame:
    """Rows in table order with ISO strings read as timestamps and the write stamp added."""
    kinds = dict(rows.dtypes)
    return rows.select(
        *[
            F.to_timestamp(f.name).alias(f.name)
            if f.dataType.typeName() == "timestamp" and kinds[f.name] == "string"
            else F.col(f.name).cast(f.dataType).alias(f.name)
            for f in RUNLOG.fields
            if f.name != AUDITED_AT
        ],
        F.current_timestamp().alias(AUDITED_AT),
    )


def _null_columns(rows: DataFrame) -> Column:
    names = [F.when(F.col(name).isNull(), F.lit(name)) for name in RUNLOG.names if name in rows.columns]
    return F.array_compact(F.array(*names))


def mark_nulls(rows: DataFrame) -> DataFrame:
    """The rows with the list of columns that break the NOT NULL contract, empty where none does.

    One result, so a caller that writes both kinds can do so from one pass.
    """
    return rows.withColumn("null_columns", _null_columns(rows))


def require_not_null(rows: DataFrame) -> DataFrame:
    """The rows unchanged; the job fails on the first null in a run-log column, naming the columns."""
    missing = F.array_join(_null_columns(rows), ", ")
    checked = F.when(missing != "", F.raise_error(F.concat(F.lit("null in run-log columns: "), missing)).cast("string"))
    return rows.withColumn(RUN_KEY, F.coalesce(checked, F.col(RUN_KEY)))


def not_ok(runlog: DataFrame) -> DataFrame:
    """Children that did not end ok, skipped ones included."""
    return runlog.where(F.col("status") != "ok")


def first_failures(runlog: DataFrame) -> DataFrame:
    """The first failed or timed-out child of each run and the message a stopped run reports.

    One pass over the failing rows; each map task sends on one row per run.
    """
    facts = ["child_index", "notebook_path", "status", "error_class", "error_message"]
    failing = runlog.where(~F.col("status").isin("ok", SKIPPED))
    firsts = failing.groupBy(RUN_KEY).agg(F.min_by(F.struct(*facts), "child_index").alias("f")).select(RUN_KEY, "f.*")
    message = F.format_string("child %d (%s) %s: %s: %s", *facts)  # fixed value: the form of the message
    return firsts.withColumn("message", message)


def plan_violations(plan: DataFrame) -> DataFrame:
    """Broken rules of the plan as ``(run, child_index, reason)``; header rules have a null child_index."""
    headers = plan.select(
        RUN_KEY,
        F.explode(
            F.array_compact(
                F.array(
                    *[
                        F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(f"the run has no {c}"))
                        for c in ("pipeline_name", "log_table")
                    ]
                )
            )
        ).alias("reason"),
    ).distinct()
    paths = plan.where(F.coalesce("path", F.lit("")) == "").select(
        *CHILD_KEY,
        F.format_string("child %d has no path", "child_index").alias("reason"),
    )
    return headers.select(RUN_KEY, F.lit(None).cast("long").alias("child_index"), "reason").unionByName(paths)


def check_plan(plan: DataFrame) -> DataFrame:
    """Return the plan, or raise ValueError with its first violation. Runs a job."""
    first = plan_violations(plan).orderBy(RUN_KEY, F.asc_nulls_first("child_index"), "reason").first()
    if first is not None:
        raise ValueError(f"run {first[RUN_KEY]}: {first['reason']}")
    return plan


def completeness(plan: DataFrame, runlog: DataFrame) -> DataFrame:
    """Per run: children planned, logged, and planned without a row. Combines per map task; no ordered pass."""
    both = plan.select(RUN_KEY, F.lit(1).alias("p"), F.lit(0).alias("l")).unionByName(
        runlog.select(RUN_KEY, F.lit(0).alias("p"), F.lit(1).alias("l"))
    )
    counts = both.groupBy(RUN_KEY).agg(F.sum("p").alias("planned"), F.sum("l").alias("logged"))
    return counts.withColumn("missing", F.col("planned") - F.col("logged"))


def console_lines(runlog: DataFrame, plan: DataFrame | None = None, clock: bool = False) -> DataFrame:
    """One display line per run-log row; with ``clock``, the time the child ended (UTC) stands in front.

    Rows that carry their display name need no plan; for others it is looked up there.
    """
    if DISPLAY_NAME not in runlog.columns:
        if plan is None:
            raise ValueError(f"the rows have no column {DISPLAY_NAME}: give the plan they were built from")
        names = plan.select(*CHILD_KEY, text.display_name(F.col("name"), F.col("path")).alias(DISPLAY_NAME))
        runlog = runlog.join(names, CHILD_KEY)
    line = text.console_line(*[F.col(c) for c in (
        DISPLAY_NAME, "status", "duration_ms", "exit_value", "error_class", "error_message"
    )])
    if clock:
        line = F.concat(F.lit("["), text.clock(F.col("finished_at")), F.lit("] "), line)
    return runlog.select(*CHILD_KEY, line.alias("line"))
