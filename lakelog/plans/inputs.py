"""Plans, outcomes, step facts and activity records derived from the given tables.

A user's events of one week make a run; its events in time order are the children.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from lakelog.operators.slices import TIME_BITS, with_position
from lakelog.schemas import OUTCOME, PLAN, RUN_KEY
from lakelog.sinks.storage import fresh_path
from lakelog.sources.files import parquet_table

# The given tables.
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


@lru_cache(maxsize=None)
def _schema(spark: SparkSession, folder: str, table: str) -> StructType:
    return parquet_table(spark, folder, table).schema


def given(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A given table. Its footer is read for the schema once per session, as a metastore would keep it."""
    return parquet_table(spark, folder, table, _schema(spark, folder, table))


def given_lake(spark: SparkSession, folder: str) -> dict[tuple[str, str], DataFrame]:
    return {("lake", table): given(spark, folder, table) for table in TABLES}


def instant(ts: Column) -> Column:
    """A zone-less time read as UTC, whatever the session zone: its fields are counted up, nothing is converted."""
    local = ts.cast("timestamp_ntz")
    minutes = (F.unix_date(local.cast("date")).cast("long") * 24 + F.hour(local)) * 60 + F.minute(local)
    micros = F.date_part(F.lit("SECONDS"), local) * 1_000_000
    return F.timestamp_micros(minutes * 60_000_000 + micros.cast("long"))


def week_of(ts: Column) -> Column:
    return F.floor((F.dayofmonth(ts) - 1) / 7)


def run_id(user: Column, week: Column) -> Column:
    return F.concat(F.lit("r"), user.cast("string"), F.lit("-"), week.cast("string"))


def event_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Events with their run, without their place in it."""
    user, ts = F.col("user_id"), F.col("ts")
    return given(spark, folder, "events").select(
        run_id(user, week_of(ts)).alias(RUN_KEY),
        F.concat(F.lit("p"), (user % 5).cast("string")).alias("pipeline_name"),
        "event_id",
        "user_id",
        "event_type",
        instant(ts).alias("started_at"),
        F.floor(F.col("value") * 1000).cast("long").alias("duration_ms"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"),
        "value",
    )


def children(spark: SparkSession, folder: str, bits: int = TIME_BITS) -> DataFrame:
    """Events with their place in the run, numbered in slices of a second."""
    facts = event_facts(spark, folder)
    return with_position(
        facts, [RUN_KEY], ["started_at", "event_id"], F.unix_micros("started_at"), "child_index", bits
    )


def _shaped(df: DataFrame, schema) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def plan_of(rows: DataFrame) -> DataFrame:
    k, text = F.col("k"), F.col("k").cast("string")
    return _shaped(
        rows.select(
            RUN_KEY,
            "pipeline_name",
            "child_index",
            F.lit("meta.runlog").alias("log_table"),
            F.when(k % 10 == 0, "").otherwise(F.concat(F.lit("/jobs/"), "event_type")).alias("path"),
            F.when(k % 4 == 0, F.concat(F.lit("job "), text)).alias("name"),
            F.when(k % 2 == 0, 60 * k).alias("timeout_seconds"),
            F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("k"), text).alias("args"),
            (F.col("user_id") % 2 == 0).alias("fail_fast"),
            F.lit(None).alias("extras"),
        ),
        PLAN,
    )


def outcome_of(rows: DataFrame) -> DataFrame:
    k, error = F.col("k"), F.col("event_type") == "error"
    late = error & (k % 3 == 0)
    message = F.when(late, "notebook Timed Out after 1800 seconds").when(
        error, F.concat(F.lit("bad key "), k.cast("string"))
    )
    return _shaped(
        rows.select(
            RUN_KEY,
            "child_index",
            "started_at",
            F.timestamp_micros(F.unix_micros("started_at") + F.col("duration_ms") * 1000).alias("finished_at"),
            "duration_ms",
            F.when(~error, F.col("event_id").cast("string")).alias("returned"),
            F.when(late, "RuntimeError").when(error, "ValueError").alias("error_class"),
            message.alias("error_message"),
            F.when(error, F.concat(F.lit("Traceback: "), message)).alias("error_traceback"),
        ),
        OUTCOME,
    )


@lru_cache(maxsize=None)
def _stored(spark: SparkSession, folder: str) -> str:
    """Write children, plan and outcome as tables, once per session: they stand for tables a lake would hold."""
    base = fresh_path(spark, "derived")
    children(spark, folder).write.parquet(f"{base}/children")
    rows = spark.read.parquet(f"{base}/children")
    plan_of(rows).write.parquet(f"{base}/plan")
    outcome_of(rows).write.parquet(f"{base}/outcome")
    return base


def stored_children(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{_stored(spark, folder)}/children")


def plan_and_outcome(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    base = _stored(spark, folder)
    return spark.read.schema(PLAN).parquet(f"{base}/plan"), spark.read.schema(OUTCOME).parquet(f"{base}/outcome")


def step_facts(rows: DataFrame) -> DataFrame:
    """An event as a timed step; k = 0 never ends. Two of three steps name their child, if the rows have one."""
    k, error = F.col("k"), (F.col("event_type") == "error") & (F.col("k") != 0)
    child = F.when(k % 3 != 0, F.col("child_index")) if "child_index" in rows.columns else F.lit(None).cast("long")
    return rows.select(
        RUN_KEY,
        "pipeline_name",
        child.alias("child_index"),
        F.col("event_type").alias("step"),
        "started_at",
        F.when(k != 0, F.col("duration_ms")).alias("duration_ms"),
        F.when(error, "ValueError").alias("error_class"),
        F.when(error, F.concat(F.lit("bad key "), k.cast("string"))).alias("error_message"),
        F.create_map(F.lit("k"), k.cast("string"), F.lit("source"), F.lit("events")).alias("attrs"),
        F.create_map(F.lit("source"), F.lit("metric"), F.lit("user"), F.col("user_id").cast("string")).alias("metrics"),
    )


def activity(spark: SparkSession, folder: str) -> DataFrame:
    """A scheduler's record per customer and week; some runs have none and some records no run."""
    weeks = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("week")
    customers = given(spark, folder, "customer").select("c_custkey", "c_mktsegment", weeks)
    return customers.select(
        run_id(F.col("c_custkey"), F.col("week")).alias(RUN_KEY), F.col("c_mktsegment").alias("trigger_name")
    )
