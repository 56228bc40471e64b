"""Starting streams: every writer takes a checkpoint folder and survives a restart without repeating rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from lakelog.operators.logs import from_lines
from lakelog.operators.reports import closed_runs
from lakelog.sinks.tables import FORMAT, append_new_rows
from lakelog.streaming.spans import FOLD, read_summary, save_batch


def _writer(stream: DataFrame, checkpoint: str, mode: str, continuous: str | None) -> DataStreamWriter:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=continuous) if continuous else writer.trigger(availableNow=True)


def append_files(stream: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append a stateless stream (a standing search, say) to Parquet files; the file sink logs its own commits."""
    return _writer(stream, checkpoint, "append", every).format("parquet").start(path)


def read_lines(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Log lines as they arrive in a folder."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)


def ingest_lines(lines: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Parse log lines and append the records; unreadable lines keep their text in ``corrupt_line``."""
    return append_files(from_lines(lines), path, checkpoint, every)


def append_runlog(
    rows: DataFrame, table: str, checkpoint: str, fmt: str = FORMAT, every: str | None = None
) -> StreamingQuery:
    """Append run-log rows to an existing table, one commit per micro-batch, each (run, child) once.

    A batch that is replayed after a crash finds its rows in the table and writes nothing.
    """
    return (
        _writer(rows, checkpoint, "append", every)
        .foreachBatch(lambda batch, _: append_new_rows(batch, table, fmt))
        .start()
    )


def live_summary(
    rows: DataFrame, path: str, checkpoint: str, every: str | None = None, fold: int = FOLD
) -> StreamingQuery:
    """Keep the run summary of a run-log stream, exact however late a row comes.

    Summaries of batches add up, so the stream keeps no state: a micro-batch writes the runs it has rows of, and every
    ``fold`` batches their folders become one. ``path`` belongs to one checkpoint.
    """
    return (
        _writer(rows, checkpoint, "append", every)
        .foreachBatch(lambda batch, batch_id: save_batch(batch, batch_id, path, fold))
        .start()
    )


def read_live_summary(spark: SparkSession, path: str) -> DataFrame:
    """The newest state of every run that ``live_summary`` wrote."""
    return read_summary(spark, path)


def report_closed_runs(
    rows: DataFrame, path: str, checkpoint: str, idle: str, late: str, every: str | None = None
) -> StreamingQuery:
    """Append the summary of every run once it is over; see ``closed_runs``."""
    return append_files(closed_runs(rows, idle, late), path, checkpoint, every)
