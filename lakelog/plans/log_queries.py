"""Log lines, step events and their streaming twins, over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lakelog.operators import logs, steps
from lakelog.operators.search import Search
from lakelog.plans.inputs import event_facts, given, step_facts, week_of
from lakelog.plans.registry import query
from lakelog.plans.runlog_queries import _SUMMARY, INPUT_SQL, _summary_micros, built_log
from lakelog.schemas import CHILD_KEY, RUN_KEY, RUN_SUMMARY, RUNLOG
from lakelog.sinks.storage import fresh_path
from lakelog.sinks.tables import ensure_log_table, write_lines
from lakelog.streaming import sinks

_RECORDS = (
    INPUT_SQL
    + """, rec as (
    select started_us as ts_us, 'INFO' as level, concat('step start: ', event_type) as msg, pipeline_run_id, pipeline_name,
      event_type as step, 'start' as phase, cast(null as bigint) as duration_ms, cast(null as varchar) as error_class,
      cast(null as varchar) as error_message, user_id, k from base
    union all select started_us + duration_ms*1000, case when event_type = 'error' then 'ERROR' else 'INFO' end,
      case when event_type = 'error' then concat('step failed: ', event_type, ' (ValueError)')
        else concat('step ok: ', event_type, ' (', duration_ms, 'ms)') end, pipeline_run_id, pipeline_name, event_type,
      case when event_type='error' then 'failed' else 'ok' end, duration_ms,
      case when event_type='error' then 'ValueError' end, case when event_type='error' then concat('bad key ', k) end,
      user_id, k from base where k <> 0)"""
)
_RECORD_COLUMNS = (
    "level, 'lakelog.steps' as logger, msg, pipeline_run_id, pipeline_name, step, phase, duration_ms, error_class, error_message"
)


def _records(spark: SparkSession, folder: str) -> DataFrame:
    return steps.step_events(step_facts(event_facts(spark, folder)))


def _line_columns(records: DataFrame, more: list[Column] = []) -> DataFrame:
    names = "level logger msg pipeline_run_id pipeline_name step phase duration_ms error_class error_message".split()
    return records.select(F.unix_micros("ts").alias("ts_us"), *names, *more)


@query(
    _RECORDS
    + f""" select ts_us, {_RECORD_COLUMNS}, cast(k as varchar) as attr_k,
    case when phase = 'ok' then 'metric' else 'events' end as source, case when phase = 'ok' then cast(user_id as varchar) end as metric_user
    from rec"""
)
def step_events(spark: SparkSession, folder: str) -> DataFrame:
    """Start and exit records; the metric wins over the attribute of the same name on the ok record."""
    records = _records(spark, folder).withColumn("extra", steps.merge_metrics(F.col("attrs"), F.col("metrics")))
    extras = {"attr_k": "k", "source": "source", "metric_user": "user"}
    return _line_columns(records, [F.col("extra")[key].alias(name) for name, key in extras.items()])


@query(_RECORDS + f" select ts_us, {_RECORD_COLUMNS} from rec")
def log_json_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    return _line_columns(logs.from_lines(logs.to_lines(_records(spark, folder))))


@query(
    """select text as corrupt_line, cast(null as varchar) as msg from documents
    union all select props, cast(null as varchar) from events"""
)
def log_corrupt(spark: SparkSession, folder: str) -> DataFrame:
    """Prose and JSON of another kind among log lines: each comes back with its text, none is dropped."""
    prose = given(spark, folder, "documents").select(F.col("text").alias("value"))
    other = given(spark, folder, "events").select(F.col("props").alias("value"))
    lines = logs.to_lines(_records(spark, folder)).unionByName(prose).unionByName(other)
    return logs.from_lines(lines).where(F.col(logs.CORRUPT).isNotNull()).select(logs.CORRUPT, "msg")


@query(
    _RECORDS
    + """ select case when k % 3 = 0 then 'active' else pipeline_run_id end as pipeline_run_id, count(*) as records
    from rec group by 1"""
)
def step_run_id(spark: SparkSession, folder: str) -> DataFrame:
    """Every third step is logged without a run id and takes that of the active run; the others keep theirs."""
    without = F.col("attrs")["k"].cast("int") % 3 == 0
    records = _records(spark, folder).withColumn(RUN_KEY, F.when(~without, F.col(RUN_KEY)))
    return steps.with_run_id(records, "active").groupBy(RUN_KEY).agg(F.count("*").alias("records"))


@query(
    _RECORDS
    + """ select pipeline_run_id, step, phase, ts_us - duration_ms * 1000 as started_us, ts_us as finished_us, duration_ms,
    error_class from rec where phase <> 'start'"""
)
def step_spans(spark: SparkSession, folder: str) -> DataFrame:
    spans = steps.step_spans(_records(spark, folder))
    return spans.select(
        RUN_KEY,
        "step",
        "phase",
        F.unix_micros("started_at").alias("started_us"),
        F.unix_micros("finished_at").alias("finished_us"),
        "duration_ms",
        "error_class",
    )


@query(
    _RECORDS
    + """, nx as (select *, lead(phase) over (partition by pipeline_run_id, step
      order by ts_us, case when phase = 'start' then 0 else 1 end) as nxt from rec)
    select pipeline_run_id, step, ts_us as started_us from nx where phase = 'start' and coalesce(nxt, '') not in ('ok', 'failed')"""
)
def step_open(spark: SparkSession, folder: str) -> DataFrame:
    opened = steps.open_steps(_records(spark, folder))
    return opened.select(RUN_KEY, "step", F.unix_micros("started_at").alias("started_us"))


@query(
    INPUT_SQL
    + """select pipeline_run_id, event_type as step, concat('m', k % 10) as key, value from base
    qualify row_number() over (partition by pipeline_run_id, event_type, k % 10 order by ts desc, event_id desc) = 1"""
)
def step_metrics(spark: SparkSession, folder: str) -> DataFrame:
    writes = event_facts(spark, folder).select(
        RUN_KEY,
        F.col("event_type").alias("step"),
        F.concat(F.lit("m"), (F.col("k") % 10).cast("string")).alias("key"),
        "value",
        "started_at",
        "event_id",
    )
    return steps.latest_metrics(writes, ["started_at", "event_id"])


@query(_RECORDS + f" select ts_us, {_RECORD_COLUMNS} from rec")
def stream_log_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Write the log lines as text, stream them in, parse, append."""
    base = fresh_path(spark, "ingest")
    write_lines(logs.to_lines(_records(spark, folder)), f"{base}/lines")
    stream = sinks.read_lines(spark, f"{base}/lines")
    sinks.ingest_lines(stream, f"{base}/records", f"{base}/checkpoint").awaitTermination()
    return _line_columns(spark.read.parquet(f"{base}/records"))


def _staged_log(spark: SparkSession, folder: str, base: str) -> DataFrame:
    """The built log as a stream of files, a quarter of them per micro-batch."""
    files = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    built_log(spark, folder).repartition(files).write.parquet(f"{base}/rows")
    kept = [f for f in RUNLOG.fields if f.name != "audited_at"]
    schema = type(RUNLOG)([type(f)(f.name, f.dataType, True) for f in kept])
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files // 4).parquet(f"{base}/rows")


@query(INPUT_SQL + "select pipeline_run_id, child_index, status, started_us, finished_us, true as stamped from log")
def stream_runlog_append(spark: SparkSession, folder: str) -> DataFrame:
    """Append a stream to a log table by day; then the whole stream again from the start, which adds nothing."""
    base = fresh_path(spark, "append")
    table = "runlog_" + base[-32:]
    ensure_log_table(spark, table, path=f"{base}/table", by_day=True)
    stream = _staged_log(spark, folder, base)
    for attempt in ("first", "replay"):
        sinks.append_runlog(stream, table, f"{base}/checkpoint-{attempt}").awaitTermination()
    stored = spark.table(table)
    return stored.select(
        *CHILD_KEY,
        "status",
        F.unix_micros("started_at").alias("started_us"),
        F.unix_micros("finished_at").alias("finished_us"),
        F.col("audited_at").isNotNull().alias("stamped"),
    )


@query(INPUT_SQL + _SUMMARY + "group by pipeline_run_id")
def stream_run_summary(spark: SparkSession, folder: str) -> DataFrame:
    base = fresh_path(spark, "summary")
    stream = _staged_log(spark, folder, base)
    sinks.live_summary(stream, f"{base}/summary", f"{base}/checkpoint").awaitTermination()
    return _summary_micros(sinks.read_live_summary(spark, f"{base}/summary"))


#: A run is over when no child has ended for twelve hours; rows may come eight days later than others.
_IDLE_HOURS, _LATE_DAYS = 12, 8


@query(
    INPUT_SQL
    + f""", follows as (select *, max(finished_us) over () as newest, finished_us - lag(finished_us)
      over (partition by pipeline_run_id order by finished_us, child_index) as gap from log),
    parts as (select *, sum(case when gap <= {_IDLE_HOURS} * 3600000000 then 0 else 1 end)
      over (partition by pipeline_run_id order by finished_us, child_index) as part from follows)
    select pipeline_run_id, count(*) as children,
      cast(sum(case when status = 'failed' then 1 else 0 end) as bigint) as failed, min(started_us) as run_start_us,
      max(finished_us) as run_end_us from parts group by pipeline_run_id, part, newest
    having max(finished_us) + {_IDLE_HOURS} * 3600000000 <= newest // 1000 * 1000 - {_LATE_DAYS} * 86400000000"""
)
def stream_closed_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The log arrives week by week; runs are reported when they are over, and only open ones stay in the state."""
    base = fresh_path(spark, "closed")
    built_log(spark, folder).write.parquet(f"{base}/log")
    stored = spark.read.parquet(f"{base}/log")
    for week in range(5):
        stored.where(week_of(F.col("finished_at")) == week).write.mode("append").parquet(f"{base}/rows")
    stream = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/rows")
    idle, late = f"{_IDLE_HOURS} hours", f"{_LATE_DAYS} days"
    sinks.report_closed_runs(stream, f"{base}/closed", f"{base}/checkpoint", idle, late).awaitTermination()
    return _summary_micros(spark.read.schema(RUN_SUMMARY).parquet(f"{base}/closed"))


@query("select event_id, event_type from events where contains(event_type, 'error') and ts < timestamp '2024-01-16'")
def stream_search(spark: SparkSession, folder: str) -> DataFrame:
    """A standing search over the events as they arrive."""
    base = fresh_path(spark, "standing")
    schema = given(spark, folder, "events").schema
    # A pattern, because a stream takes a table that is one file only through a pattern.
    events = spark.readStream.schema(schema).parquet(f"{folder.rstrip('/')}/events.parque[t]")
    search = Search(("error",), ingested_col="ts", date_range=("", "2024-01-15"))
    sinks.append_files(search.matching(events), f"{base}/found", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/found").select("event_id", "event_type")
