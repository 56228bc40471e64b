"""The run log and its reports, from the runs derived from the given events."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakelog.functions import text
from lakelog.operators import reports, runlog
from lakelog.operators.steps import step_events as events_of, step_spans as spans_of
from lakelog.plans.inputs import activity, given, outcome_of, plan_and_outcome, step_facts, stored_children
from lakelog.plans.registry import query
from lakelog.schemas import CHILD_KEY, RUN_KEY
from lakelog.sinks.storage import fresh_path
from lakelog.sinks.tables import append_rows, ensure_log_table, read_runlog

# The derived inputs and, from ``st`` on, the expected status, in plain SQL.
INPUT_SQL = """with base as (
 select concat('r', user_id, '-', cast(floor((day(ts)-1)/7) as int)) as pipeline_run_id,
  concat('p', user_id % 5) as pipeline_name, event_id, user_id, ts, event_type, epoch_us(ts) as started_us,
  cast(floor(value*1000) as bigint) as duration_ms, cast(regexp_extract(props,'([0-9]+)',1) as int) as k, value
 from events),
idx as (select *, row_number() over (partition by pipeline_run_id order by ts, event_id) - 1 as child_index from base),
plan as (select pipeline_run_id, pipeline_name, child_index, event_id, user_id, k,
  case when k % 10 = 0 then '' else concat('/jobs/', event_type) end as path,
  case when k % 4 = 0 then concat('job ', k) end as name,
  case when k % 2 = 0 then 60 * k end as timeout_seconds, user_id % 2 = 0 as fail_fast from idx),
outcome as (select pipeline_run_id, child_index, started_us, started_us + duration_ms*1000 as finished_us, duration_ms,
  case when event_type <> 'error' then cast(event_id as varchar) end as returned,
  case when event_type = 'error' and k%3=0 then 'RuntimeError' when event_type='error' then 'ValueError' end as error_class,
  case when event_type = 'error' and k%3=0 then 'notebook Timed Out after 1800 seconds'
    when event_type='error' then concat('bad key ', k) end as error_message from idx),
st as (select p.*, o.started_us, o.finished_us, o.duration_ms, o.returned, o.error_class, o.error_message,
  case when o.error_message is null then 'ok'
    when lower(o.error_message) like '%timeout%' or lower(o.error_message) like '%timed out%' then 'timeout'
    else 'failed' end as own
  from plan p left join outcome o on p.pipeline_run_id=o.pipeline_run_id and p.child_index=o.child_index),
rl as (select *, case when fail_fast and coalesce(max(case when own<>'ok' then 1 else 0 end) over
   (partition by pipeline_run_id order by child_index rows between unbounded preceding and 1 preceding),0)=1
   then 'skipped' else own end as status,
   min(case when own<>'ok' then child_index end) over (partition by pipeline_run_id) as halt_index from st),
log as (select rl.pipeline_run_id, pipeline_name, child_index, path as notebook_path, status,
  case when status='skipped' then h.halted_us else started_us end as started_us,
  case when status='skipped' then h.halted_us else finished_us end as finished_us,
  case when status='skipped' then 0 else duration_ms end as duration_ms,
  case when status='ok' then returned else '' end as exit_value,
  concat('{"k": "', k, '", "user": "', user_id, '"}') as args_json,
  case when status in ('failed','timeout') then error_class else '' end as error_class,
  case when status in ('failed','timeout') then error_message else '' end as error_message,
  case when status in ('failed','timeout') then concat('Traceback: ', error_message) else '' end as error_traceback,
  'orchestrator' as orchestrator_notebook, name, k, fail_fast
  from rl left join (select pipeline_run_id as run, finished_us as halted_us from rl where child_index = halt_index) h
    on h.run = rl.pipeline_run_id)
"""

_LOG_COLUMNS = """pipeline_run_id, pipeline_name, child_index, notebook_path, status, started_us, finished_us, duration_ms,
  exit_value, args_json, error_class, error_message, error_traceback, orchestrator_notebook"""


def _micros(rows: DataFrame) -> DataFrame:
    """Timestamps as epoch microseconds, the same in every session zone."""
    return rows.select(
        *[
            F.unix_micros(c).alias(c.replace("_at", "_us")) if kind == "timestamp" else F.col(c)
            for c, kind in rows.dtypes
        ]
    )


def built_log(spark: SparkSession, folder: str) -> DataFrame:
    return runlog.build_runlog(*plan_and_outcome(spark, folder), orchestrator_notebook="orchestrator")


@query(
    INPUT_SQL
    + """select pipeline_run_id as planned_run, cast(1 as bigint) as ids, fail_fast as supplied, not fail_fast as fresh,
    count(*) as children from plan group by pipeline_run_id, fail_fast"""
)
def runlog_run_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Half of the runs bring their id and keep it; each of the others gets one fresh version-4 id."""
    plan, _ = plan_and_outcome(spark, folder)
    asked = plan.withColumn("planned_run", F.col(RUN_KEY)).withColumn(RUN_KEY, F.when(F.col("fail_fast"), F.col(RUN_KEY)))
    stamped = runlog.with_run_ids(asked, ["pipeline_name", "planned_run"])
    uuid4 = "^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
    ids = stamped.groupBy("planned_run", RUN_KEY).agg(F.count("*").alias("n"))
    return ids.groupBy("planned_run").agg(
        F.count("*").alias("ids"),
        F.bool_and(F.col(RUN_KEY) == F.col("planned_run")).alias("supplied"),
        F.bool_and(F.col(RUN_KEY).rlike(uuid4)).alias("fresh"),
        F.sum("n").alias("children"),
    )


@query(INPUT_SQL + "select pipeline_run_id, child_index, own as status from st")
def runlog_status(spark: SparkSession, folder: str) -> DataFrame:
    _, outcome = plan_and_outcome(spark, folder)
    return outcome.select(*CHILD_KEY, text.status(F.col("error_class"), F.col("error_message")).alias("status"))


_CUT = "case when length({c}) <= {n} then {c} else concat(left({c}, {n}), '…[truncated]') end"


@query(
    "select doc_id, "
    + ", ".join(f"{_CUT.format(c='text', n=n)} as cut_{n}" for n in (40, 80, 4096, 16384))
    + " from documents"
)
def text_truncate(spark: SparkSession, folder: str) -> DataFrame:
    documents = given(spark, folder, "documents")
    return documents.select(
        "doc_id", *[text.truncate(F.col("text"), n).alias(f"cut_{n}") for n in (40, 80, 4096, 16384)]
    )


@query(INPUT_SQL + "select pipeline_run_id, child_index, args_json from log")
def args_json(spark: SparkSession, folder: str) -> DataFrame:
    plan, _ = plan_and_outcome(spark, folder)
    return plan.select(*CHILD_KEY, text.args_json(F.col("args")).alias("args_json"))


@query(INPUT_SQL + f"select {_LOG_COLUMNS} from log")
def runlog_build(spark: SparkSession, folder: str) -> DataFrame:
    return _micros(built_log(spark, folder))


@query(
    INPUT_SQL
    + """select pipeline_run_id, child_index, coalesce(timeout_seconds, 1800) as timeout_seconds, fail_fast,
    coalesce(name, nullif(regexp_extract(regexp_replace(path, '/+$', ''), '([^/]*)$', 1), ''), path) as display_name
    from plan"""
)
def plan_defaults(spark: SparkSession, folder: str) -> DataFrame:
    plan, _ = plan_and_outcome(spark, folder)
    return runlog.plan_defaults(plan).select(*CHILD_KEY, "timeout_seconds", "fail_fast", "display_name")


@query(INPUT_SQL + "select pipeline_run_id, child_index, status from rl where fail_fast")
def runlog_skip(spark: SparkSession, folder: str) -> DataFrame:
    plan, outcome = plan_and_outcome(spark, folder)
    return runlog.build_runlog(plan.where("fail_fast"), outcome).select(*CHILD_KEY, "status")


@query(INPUT_SQL + "select pipeline_run_id, child_index, own as status from st")
def runlog_run_all(spark: SparkSession, folder: str) -> DataFrame:
    """Without fail-fast every child keeps its own status."""
    plan, outcome = plan_and_outcome(spark, folder)
    return runlog.build_runlog(plan.withColumn("fail_fast", F.lit(False)), outcome).select(*CHILD_KEY, "status")


@query(
    INPUT_SQL
    + """select pipeline_run_id, child_index, notebook_path, status, error_class, error_message,
    concat('child ', child_index, ' (', notebook_path, ') ', status, ': ', error_class, ': ', error_message) as message
    from log where status in ('failed', 'timeout')
    qualify row_number() over (partition by pipeline_run_id order by child_index) = 1"""
)
def runlog_first_failure(spark: SparkSession, folder: str) -> DataFrame:
    return runlog.first_failures(built_log(spark, folder))


@query(
    INPUT_SQL
    + """select pipeline_run_id, child_index,
    concat('child ', child_index, ' has no path') as reason from plan where path = ''
    union all select distinct pipeline_run_id, cast(null as bigint), 'the run has no pipeline_name' from plan
    where pipeline_name = 'p3'"""
)
def plan_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Empty paths, and a pipeline whose name was lost."""
    plan, _ = plan_and_outcome(spark, folder)
    name = F.when(F.col("pipeline_name") != "p3", F.col("pipeline_name")).otherwise("")
    return runlog.plan_violations(plan.withColumn("pipeline_name", name))


@query(
    INPUT_SQL
    + """select pipeline_run_id, child_index, concat_ws(', ', case when k % 5 = 0 then 'notebook_path' end,
      case when status <> 'skipped' and k % 7 = 0 then 'finished_at' end) as null_columns, k % 5 <> 0 and not (status <> 'skipped' and k % 7 = 0) as valid from log"""
)
def runlog_null_guard(spark: SparkSession, folder: str) -> DataFrame:
    """Rows with lost fields are set aside with the names of those fields."""
    damaged = (
        runlog.build_runlog(*plan_and_outcome(spark, folder))
        .join(stored_children(spark, folder).select(*CHILD_KEY, "k"), CHILD_KEY)
        .withColumn("notebook_path", F.when(F.col("k") % 5 != 0, F.col("notebook_path")))
        .withColumn("finished_at", F.when((F.col("k") % 7 != 0) | (F.col("status") == "skipped"), F.col("finished_at")))
        .drop("k")
    )
    marked = runlog.mark_nulls(damaged)
    broken = F.array_join("null_columns", ", ").alias("null_columns")
    return marked.select(*CHILD_KEY, broken, (F.size("null_columns") == 0).alias("valid"))


_LINES = (
    INPUT_SQL
    + """, shown as (select *, coalesce(name,
      nullif(regexp_extract(regexp_replace(notebook_path, '/+$', ''), '([^/]*)$', 1), ''), notebook_path) as label from log),
    lines as (select pipeline_run_id, child_index, finished_us, concat(
      rpad(concat('[', case status when 'ok' then 'OK' when 'failed' then 'FAIL' when 'timeout' then 'TIME' else 'SKIP' end, ']'), 8, ' '),
      ' ', rpad(label, 18, ' '), ' ',
      case when status = 'skipped' then '       ' else concat(format('{:6.2f}', duration_ms / 1000.0::double), 's') end, '  ',
      case status when 'skipped' then '(fail_fast)' when 'ok' then concat('exit=', exit_value)
        else concat(error_class, ': ', error_message) end) as line from shown)"""
)


@query(_LINES + "select pipeline_run_id, child_index, line from lines")
def runlog_line(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of a log that does not hold the display names: they are looked up in the plan."""
    plan, outcome = plan_and_outcome(spark, folder)
    return runlog.console_lines(runlog.build_runlog(plan, outcome), plan)


@query(
    _LINES
    + """select pipeline_run_id, child_index,
    concat('[', strftime(make_timestamp(finished_us), '%H:%M:%S'), '] ', line) as line from lines"""
)
def runlog_line_clock(spark: SparkSession, folder: str) -> DataFrame:
    """Lines as a console shows them, from rows that carry their display name."""
    rows = runlog.build_runlog(*plan_and_outcome(spark, folder), display_names=True)
    return runlog.console_lines(rows, clock=True)


@query(INPUT_SQL + f"select {_LOG_COLUMNS}, true as stamped from log")
def runlog_stage(spark: SparkSession, folder: str) -> DataFrame:
    """Times arrive as ISO strings with an offset and in any column order."""
    rows = built_log(spark, folder)
    shuffled = rows.select(*sorted(rows.columns))
    texts = shuffled.withColumns({c: text.iso_utc(F.col(c)) for c in ("started_at", "finished_at")})
    staged = runlog.stage(texts)
    return _micros(staged.withColumn("stamped", F.col("audited_at").isNotNull()).drop("audited_at"))


@query(INPUT_SQL + f"select {_LOG_COLUMNS}, true as stamped from log")
def runlog_append(spark: SparkSession, folder: str) -> DataFrame:
    """Append the built log to a fresh table and read the table."""
    path = fresh_path(spark, "runlog")
    table = "runlog_" + path[-32:]
    ensure_log_table(spark, table, path=path)
    append_rows(built_log(spark, folder), table)
    stored = read_runlog(spark, table).withColumn("stamped", F.col("audited_at").isNotNull())
    return _micros(stored.drop("audited_at"))


@query(
    INPUT_SQL
    + """select pipeline_run_id, child_index, notebook_path, status, duration_ms / 1000.0::double as seconds, error_class,
    error_message from log where pipeline_name = 'p1' order by pipeline_run_id desc, child_index"""
)
def runlog_detail(spark: SparkSession, folder: str) -> DataFrame:
    return reports.run_detail(built_log(spark, folder), "p1")


@query(INPUT_SQL + "select pipeline_run_id, child_index, status, error_class from log where status <> 'ok'")
def runlog_not_ok(spark: SparkSession, folder: str) -> DataFrame:
    return runlog.not_ok(built_log(spark, folder)).select(*CHILD_KEY, "status", "error_class")


@query(
    INPUT_SQL
    + """select p.pipeline_run_id, count(*) as planned,
    count(*) filter (where not (p.event_id % 11 = 0) or r.status = 'skipped') as logged,
    count(*) filter (where p.event_id % 11 = 0 and r.status <> 'skipped') as missing
    from plan p join (
      select pipeline_run_id, child_index, case when fail_fast and coalesce(max(case when own<>'ok' and event_id % 11 <> 0 then 1 else 0 end) over
        (partition by pipeline_run_id order by child_index rows between unbounded preceding and 1 preceding),0)=1 then 'skipped' else own end as status
      from st) r on r.pipeline_run_id = p.pipeline_run_id and r.child_index = p.child_index
    group by p.pipeline_run_id"""
)
def runlog_completeness(spark: SparkSession, folder: str) -> DataFrame:
    """Some children crashed without an outcome; they have no row unless they were skipped."""
    plan, _ = plan_and_outcome(spark, folder)
    finished = outcome_of(stored_children(spark, folder).where(F.col("event_id") % 11 != 0))
    return runlog.completeness(plan, runlog.build_runlog(plan, finished))


_SUMMARY = """select pipeline_run_id, count(*) as children,
    cast(sum(case when status = 'failed' then 1 else 0 end) as bigint) as failed, min(started_us) as run_start_us,
    max(finished_us) as run_end_us from log """


def _summary_micros(rows: DataFrame) -> DataFrame:
    return rows.select(
        RUN_KEY,
        "children",
        "failed",
        F.unix_micros("run_start").alias("run_start_us"),
        F.unix_micros("run_end").alias("run_end_us"),
    )


@query(INPUT_SQL + _SUMMARY + "group by pipeline_run_id")
def run_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _summary_micros(reports.run_summary(built_log(spark, folder)))


@query(
    INPUT_SQL
    + _SUMMARY
    + "where pipeline_name = 'p1' group by pipeline_run_id order by run_start_us desc, pipeline_run_id limit 20"
)
def run_summary_top20(spark: SparkSession, folder: str) -> DataFrame:
    """The latest twenty runs; the cut is the report."""
    return _summary_micros(reports.latest_runs(built_log(spark, folder), "p1"))


@query(
    INPUT_SQL
    + _SUMMARY
    + """where started_us >= epoch_us(timestamp '2024-01-20') group by pipeline_run_id
    order by run_start_us desc, pipeline_run_id limit 50"""
)
def run_summary_recent(spark: SparkSession, folder: str) -> DataFrame:
    """The latest fifty runs of a log that is partitioned by day, reading the days since one; the cut is the report."""
    path = fresh_path(spark, "runlog")
    table = "runlog_" + path[-32:]
    ensure_log_table(spark, table, path=path, by_day=True)
    append_rows(built_log(spark, folder), table)
    return _summary_micros(reports.latest_runs(spark.table(table), runs=50, since=dt.date(2024, 1, 20)))


@query(
    INPUT_SQL
    + """, activity as (select concat('r', c_custkey, '-', w) as run, c_mktsegment as trigger_name
      from customer, (values (0), (1), (2), (3)) v(w))
    select l.pipeline_run_id, l.child_index, l.status, a.trigger_name from log l join activity a on a.run = l.pipeline_run_id"""
)
def runlog_join_activity(spark: SparkSession, folder: str) -> DataFrame:
    joined = reports.with_activity(built_log(spark, folder), activity(spark, folder))
    return joined.select(*CHILD_KEY, "status", "trigger_name")


@query(
    INPUT_SQL
    + """, spans as (select pipeline_run_id as run, case when k % 3 <> 0 then child_index end as child,
        duration_ms, case when event_type = 'error' then 1 else 0 end as bad from idx where k <> 0),
    own as (select run, child, count(*) as n, sum(bad) as f, sum(duration_ms) as ms from spans where child is not null group by all),
    shared as (select run, count(*) as n, sum(bad) as f, sum(duration_ms) as ms from spans where child is null group by all)
    select l.pipeline_run_id, l.child_index, l.status, coalesce(o.n, 0) as child_steps,
      cast(coalesce(o.f, 0) as bigint) as child_steps_failed, cast(coalesce(o.ms, 0) as bigint) as child_step_ms, coalesce(s.n, 0) as run_steps,
      cast(coalesce(s.f, 0) as bigint) as run_steps_failed, cast(coalesce(s.ms, 0) as bigint) as run_step_ms
    from log l left join own o on o.run = l.pipeline_run_id and o.child = l.child_index
    left join shared s on s.run = l.pipeline_run_id"""
)
def runlog_join_steps(spark: SparkSession, folder: str) -> DataFrame:
    records = events_of(step_facts(stored_children(spark, folder)))
    joined = reports.with_steps(built_log(spark, folder), spans_of(records))
    steps = [c for c in joined.columns if c.startswith(("child_step", "run_step"))]
    return joined.select(*CHILD_KEY, "status", *steps)
