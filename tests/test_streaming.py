import datetime as dt

import pytest
from pyspark.sql import functions as F

from lakelog.operators import logs, reports
from lakelog.operators.search import Search
from lakelog.schemas import CHILD_KEY, RUNLOG
from lakelog.sinks.tables import ensure_log_table, write_lines
from lakelog.streaming import sinks

NOON = dt.datetime(2026, 5, 21, 12, 0, 0)
ROWS = [f for f in RUNLOG.fields if f.name != "audited_at"]


def log_rows(spark, keys, status="ok"):
    values = [
        (run, "p", i, "/n", status, NOON + dt.timedelta(minutes=i), NOON + dt.timedelta(minutes=i + 1), 60_000, "", "{}", "", "", "", "")
        for run, i in keys
    ]
    return spark.createDataFrame(values, type(RUNLOG)(ROWS))


def stream_of(spark, path):
    schema = type(RUNLOG)([type(f)(f.name, f.dataType, True) for f in ROWS])
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_log_lines_arrive_in_batches_and_a_restart_adds_only_new_ones(spark, tmp_path):
    source, out, checkpoint = (f"{tmp_path}/{name}" for name in ("lines", "records", "checkpoint"))

    def deliver(*lines):
        write_lines(spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1), source)
        sinks.ingest_lines(sinks.read_lines(spark, source, 1), out, checkpoint).awaitTermination()
        return spark.read.parquet(out)

    line = '{"ts": "2026-05-21T14:02:11+00:00", "level": "INFO", "logger": "l", "msg": "%s"}'
    assert deliver(line % "one", "not json").count() == 2
    rows = deliver(line % "two")
    assert sorted(r["msg"] or "" for r in rows.collect()) == ["", "one", "two"]
    assert rows.where(f"{logs.CORRUPT} = 'not json'").count() == 1


def test_runlog_stream_appends_each_child_once(spark, tmp_path):
    source, table = f"{tmp_path}/rows", "streamed.log"
    ensure_log_table(spark, table)
    try:
        log_rows(spark, [("a", 0), ("a", 1)]).coalesce(1).write.parquet(source)
        sinks.append_runlog(stream_of(spark, source), table, f"{tmp_path}/c1").awaitTermination()
        log_rows(spark, [("a", 1), ("b", 0)]).coalesce(1).write.mode("append").parquet(source)
        sinks.append_runlog(stream_of(spark, source), table, f"{tmp_path}/c1").awaitTermination()
        sinks.append_runlog(stream_of(spark, source), table, f"{tmp_path}/replayed").awaitTermination()
        keys = sorted(tuple(r) for r in spark.table(table).select(*CHILD_KEY).collect())
        assert keys == [("a", 0), ("a", 1), ("b", 0)]
        assert spark.table(table).where("audited_at is null").count() == 0
    finally:
        spark.sql("drop database streamed cascade")


def test_live_summary_follows_the_batch_summary(spark, tmp_path):
    source, path, checkpoint = (f"{tmp_path}/{name}" for name in ("rows", "summary", "checkpoint"))
    for step, (keys, status) in enumerate([([("a", 0), ("b", 0)], "ok"), ([("a", 1), ("c", 0)], "failed"), ([("a", 2)], "ok")]):
        log_rows(spark, keys, status).coalesce(1).write.mode("append").parquet(source)
        sinks.live_summary(stream_of(spark, source), path, checkpoint).awaitTermination()
        live = sorted(map(tuple, sinks.read_live_summary(spark, path).collect()))
        batch = sorted(map(tuple, reports.run_summary(spark.read.parquet(source)).collect()))
        assert live == batch
    assert spark.read.parquet(path).count() == 2 + 2 + 1, "a batch writes the runs it changed, no others"


def test_standing_search_is_the_batch_search(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{folder}/events.parquet")
    search = Search(("error", "7"), "AND", ingested_col="ts", date_range=("2024-01-05", ""))
    stream = spark.readStream.schema(events.schema).parquet(f"{folder}/events.parque[t]")
    sinks.append_files(search.matching(stream), f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    found = spark.read.schema(events.schema).parquet(f"{tmp_path}/out")
    assert sorted(r[0] for r in found.collect()) == sorted(r[0] for r in search.matching(events).collect())
    assert found.count() > 0


def test_summary_of_late_data_needs_no_watermark(spark, tmp_path):
    """An old row changes its run however late it comes."""
    source, path, checkpoint = (f"{tmp_path}/{name}" for name in ("rows", "summary", "checkpoint"))
    log_rows(spark, [("a", 500)]).coalesce(1).write.parquet(source)
    sinks.live_summary(stream_of(spark, source), path, checkpoint).awaitTermination()
    log_rows(spark, [("a", 0)]).coalesce(1).write.mode("append").parquet(source)
    sinks.live_summary(stream_of(spark, source), path, checkpoint).awaitTermination()
    row = sinks.read_live_summary(spark, path).first()
    assert (row["children"], row["run_start"]) == (2, NOON)
