"""Run-log and audit tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession, functions as F

from lakelog.operators.runlog import require_not_null, stage
from lakelog.schemas import CHILD_KEY, DAY, RUN_KEY, RUNLOG

FORMAT = "parquet"


def day_of(started_at: Column) -> Column:
    """The UTC day of an instant, whatever the session zone."""
    return F.date_from_unix_date(F.floor(F.unix_micros(started_at) / 86_400_000_000).cast("int"))


def ensure_log_table(
    spark: SparkSession,
    table: str,
    fmt: str = FORMAT,
    path: str | None = None,
    by_day: bool = False,
    buckets: int | None = None,
) -> None:
    """Create the run-log table, and its database if the name has one, unless it exists.

    ``by_day`` partitions it by the day children started on, in one more column: appends then look for known children
    on the days of their batch only, and reports of recent runs read recent days. ``buckets`` deals its files by run
    id: reports by run, and joins with anything else dealt by run, then move no row of the log. A run's rows share a
    bucket, so this is for logs in which no single run holds a large share; Delta has no buckets.
    """
    if spark.catalog.tableExists(table):
        return
    database, _, _ = table.rpartition(".")
    if database:
        parts = [f"`{part.strip('`')}`" for part in database.split(".")]
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {'.'.join(parts)}")
    empty = spark.createDataFrame([], RUNLOG)
    if by_day:
        writer = empty.withColumn(DAY, day_of(F.col("started_at"))).write.partitionBy(DAY)
    else:
        writer = empty.write
    writer = _bucketed(writer.format(fmt).mode("ignore"), buckets)
    (writer.option("path", path) if path else writer).saveAsTable(table)


def append_rows(rows: DataFrame, table: str, fmt: str = FORMAT, write: bool = True) -> DataFrame | None:
    """Append a batch in one commit, columns by name; an empty batch commits nothing.

    ISO time strings are read as timestamps, ``audited_at`` is stamped, and a null in any column fails the job
    before the commit. ``write=False`` is the dry run: it returns the rows as they would be written. The rows are
    computed once: a table by day needs no look at whether there are any, as no rows make no partition, and for
    another table they are kept until they are written.
    """
    staged = require_not_null(stage(rows))
    if not write:
        return staged
    spark = rows.sparkSession
    buckets = _buckets(spark, table)
    if _is_by_day(spark, table):
        # Neighbouring tasks' rows of a day meet in one file, and a day of very many rows is split again.
        days = staged.withColumn(DAY, day_of(F.col("started_at")))
        days = days.repartition(buckets, RUN_KEY) if buckets else days.hint("rebalance", F.col(DAY))
        _bucketed(days.write.format(fmt).mode("append").partitionBy(DAY), buckets).saveAsTable(table)
        return None
    staged = staged.persist()
    try:
        if not staged.isEmpty():
            dealt = staged.repartition(buckets, RUN_KEY) if buckets else staged  # a file for each bucket
            _bucketed(dealt.write.format(fmt).mode("append"), buckets).saveAsTable(table)
    finally:
        staged.unpersist()
    return None


def _bucketed(writer: DataFrameWriter, buckets: int | None) -> DataFrameWriter:
    return writer.bucketBy(buckets, RUN_KEY).sortBy(*CHILD_KEY) if buckets else writer


def _is_by_day(spark: SparkSession, table: str) -> bool:
    return DAY in spark.table(table).columns


def _buckets(spark: SparkSession, table: str) -> int | None:
    """In how many files by run id the table is dealt, if it is."""
    facts = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Num Buckets'").first()
    return None if facts is None else int(facts["data_type"])


def append_new_rows(rows: DataFrame, table: str, fmt: str = FORMAT) -> None:
    """Append the rows whose (run, child) the table lacks, so a batch that comes twice is written once.

    The table gives up its key columns only, and keeps those the batch asks for before anything is compared:
    the batch's keys are the small side of that join. In a table by day a child is looked for on the day it started
    on, which a second delivery does not change: only the days of the batch are read.
    """
    spark = rows.sparkSession
    batch = rows.dropDuplicates(CHILD_KEY).persist()
    try:
        known = known_children(batch, spark.table(table))
        append_rows(batch.join(known, CHILD_KEY, "left_anti"), table, fmt)
    finally:
        batch.unpersist()


def known_children(batch: DataFrame, log: DataFrame) -> DataFrame:
    """The (run, child) keys of the batch that the log holds. Runs a job on the batch if the log is by day."""
    keys = batch.select(*CHILD_KEY)
    if DAY in log.columns:
        started = F.to_timestamp("started_at") if dict(batch.dtypes)["started_at"] == "string" else F.col("started_at")
        days = [r[0] for r in batch.select(day_of(started)).distinct().collect()]  # a row per calendar day
        log = log.where(F.col(DAY).isin(days))
    return log.select(*CHILD_KEY).join(keys, CHILD_KEY, "left_semi").distinct()


def read_runlog(spark: SparkSession, table: str) -> DataFrame:
    """The run log, ordered by run and child."""
    return spark.table(table).select(*RUNLOG.names).orderBy(*CHILD_KEY)


def save_dirty_columns(dirty: DataFrame, table: str, fmt: str = FORMAT) -> None:
    """Replace the audit table."""
    dirty.write.format(fmt).mode("overwrite").saveAsTable(table)


def write_lines(lines: DataFrame, path: str) -> None:
    """Append log lines as text files."""
    lines.select(F.col("value")).write.mode("append").text(path)
