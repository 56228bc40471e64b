"""Live summaries that fold, runs that close, and run logs partitioned by day."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from lakelog.operators import reports, runlog, steps
from lakelog.schemas import CHILD_KEY, DAY, RUNLOG
from lakelog.sinks.tables import append_new_rows, append_rows, day_of, ensure_log_table, known_children, read_runlog
from lakelog.streaming import sinks, spans

NOON = dt.datetime(2026, 5, 21, 12, 0, 0)
ROWS = type(RUNLOG)([f for f in RUNLOG.fields if f.name != "audited_at"])


def log_rows(spark, children, status="ok"):
    """``children``: (run, index, start); each takes a minute."""
    values = [
        (run, "p", i, "/n", status, at, at + dt.timedelta(minutes=1), 60_000, "", "{}", "", "", "", "")
        for run, i, at in children
    ]
    return spark.createDataFrame(values, ROWS).coalesce(1)


def folders(path):
    return sorted(name for name in os.listdir(path) if name.startswith("span="))


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# ------------------------------------------------------------------ folding


def test_widest_spans_hold_every_batch_once():
    assert spans.widest([]) == []
    assert spans.widest([(0, 0), (0, 7), (1, 1), (8, 8), (8, 15), (16, 16)]) == [(0, 7), (8, 15), (16, 16)]
    assert spans.widest([(0, 63), (0, 7), (56, 63), (64, 64)]) == [(0, 63), (64, 64)]


def test_two_hundred_batches_leave_few_folders():
    """The folders after every batch: few, and the widest of them hold each batch once."""
    for fold in (2, 4, 8):
        there = []
        for batch in range(200):
            made = spans.folds_after(batch, fold)
            there = sorted({*there, (batch, batch), *made})
            there = [s for s in there if s not in spans.replaced(there, made)] if made else there
            whole = spans.widest(there)
            assert [i for first, last in whole for i in range(first, last + 1)] == list(range(batch + 1))
            assert len(there) <= {2: 24, 4: 30, 8: 44}[fold] and len(whole) <= {2: 8, 4: 13, 8: 22}[fold]


def test_folded_batches_add_up(spark, tmp_path):
    path, children = str(tmp_path / "summary"), []
    for batch in range(10):
        some = [(f"r{batch % 3}", batch, NOON + dt.timedelta(minutes=batch)), ("long", batch, NOON)]
        children += some
        spans.save_batch(log_rows(spark, some), batch, path, fold=3)
        if batch in (0, 3, 8, 9):
            assert rows_of(spans.read_summary(spark, path)) == rows_of(reports.run_summary(log_rows(spark, children)))
    assert spans.widest(spans.committed_spans(spark, path)) == [(0, 8), (9, 9)]
    assert len(folders(path)) == 1 + 3 + 3 + 1  # the whole, its thirds and the last third's batches, the newest


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "summary")
    batches = [log_rows(spark, [("a", i, NOON), (f"b{i}", 0, NOON)]) for i in range(4)]
    for i, batch in enumerate(batches):
        spans.save_batch(batch, i, path, fold=2)
    want, names = rows_of(spans.read_summary(spark, path)), folders(path)
    spans.save_batch(batches[3], 3, path, fold=2)
    assert rows_of(spans.read_summary(spark, path)) == want and folders(path) == names
    assert want[0][:2] == ("a", 4)


def test_a_fold_that_was_cut_off_is_not_read(spark, tmp_path):
    path = str(tmp_path / "summary")
    for i in range(2):
        spans.save_batch(log_rows(spark, [("a", i, NOON)]), i, path, fold=2)
    wide = next(name for name in folders(path) if spans._name((0, 1)) == name)
    os.remove(f"{path}/{wide}/_SUCCESS")
    assert spans.committed_spans(spark, path) == [(0, 0), (1, 1)]
    assert [r["children"] for r in spans.read_summary(spark, path).collect()] == [2]


def test_no_folder_is_an_empty_summary(spark, tmp_path):
    assert sinks.read_live_summary(spark, str(tmp_path / "nothing")).collect() == []


# ------------------------------------------------------------------ closed runs


def test_closed_runs_leave_the_state(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / name) for name in ("rows", "closed", "checkpoint"))
    hour, queries = dt.timedelta(hours=1), []

    def deliver(*children):
        log_rows(spark, children).write.mode("append").parquet(source)
        stream = spark.readStream.schema(ROWS).parquet(source)
        query = sinks.report_closed_runs(stream, out, checkpoint, idle="2 hours", late="1 hour")
        query.awaitTermination()
        queries.append(query)
        found = spark.read.parquet(out) if os.path.exists(out) else spark.createDataFrame([], "pipeline_run_id string")
        state = query.lastProgress["stateOperators"][0]["numRowsTotal"] if query.lastProgress else 0
        return sorted((r["pipeline_run_id"], r["children"]) for r in found.collect()), state

    assert deliver(*[(f"r{i}", 0, NOON) for i in range(50)], ("long", 0, NOON)) == ([], 51)
    # Three hours on, the fifty are over and leave the state; the long run goes on.
    closed, state = deliver(("long", 1, NOON + 1.5 * hour), ("late", 0, NOON + 4 * hour))
    assert closed == sorted((f"r{i}", 1) for i in range(50)) and state <= 2
    closed, state = deliver(("r0", 1, NOON + 30 * hour))
    assert ("long", 2) in closed and ("late", 1) in closed and state == 1
    closed, _ = deliver(("r1", 1, NOON + 60 * hour))
    assert closed.count(("r0", 1)) == 2  # it went on after it was reported: its further children are reported


def test_in_a_batch_all_runs_are_over(spark):
    rows = log_rows(spark, [("a", 0, NOON), ("a", 1, NOON + dt.timedelta(hours=1)), ("a", 2, NOON + dt.timedelta(hours=9)), ("b", 0, NOON)])
    found = reports.closed_runs(rows, "2 hours")
    assert sorted((r[0], r[1]) for r in found.collect()) == [("a", 1), ("a", 2), ("b", 1)]
    assert found.columns == reports.run_summary(rows).columns


# ------------------------------------------------------------------ days


@pytest.fixture
def log(spark):
    ensure_log_table(spark, "daily.log", by_day=True)
    yield "daily.log"
    spark.sql("drop database daily cascade")


def week(spark, runs=("a",)):
    return log_rows(spark, [(run, i, NOON + dt.timedelta(days=i)) for run in runs for i in range(7)])


def test_a_log_by_day_holds_the_fifteen_columns_and_the_day(spark, log):
    append_rows(week(spark), log)
    assert spark.table(log).columns == [*RUNLOG.names, DAY]
    assert read_runlog(spark, log).columns == RUNLOG.names and read_runlog(spark, log).count() == 7
    assert spark.table(log).select(DAY).distinct().count() == 7
    files = len(spark.table(log).inputFiles())
    append_rows(week(spark).limit(0), log)
    assert len(spark.table(log).inputFiles()) == files, "an empty batch writes nothing"


def test_the_day_is_that_of_utc_in_any_session_zone(spark):
    instants = [dt.datetime(1969, 12, 31, 23, 59, tzinfo=dt.UTC), dt.datetime(2024, 2, 29, 23, 30, tzinfo=dt.UTC)]
    frame = spark.createDataFrame([(i,) for i in instants], "t timestamp")
    for zone in ("Asia/Tokyo", "America/Los_Angeles", "UTC"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert [str(r[0]) for r in frame.select(day_of(F.col("t"))).collect()] == ["1969-12-31", "2024-02-29"]
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_known_children_are_looked_for_on_the_days_of_the_batch(spark, log):
    append_rows(week(spark, ("a", "b")), log)
    batch = log_rows(spark, [("a", 2, NOON + dt.timedelta(days=2)), ("c", 0, NOON + dt.timedelta(days=2))])
    known = known_children(batch, spark.table(log))
    assert rows_of(known) == [("a", 2)]
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [{DAY}" in plan.replace("isnotnull(", "").replace("[(", "[") or "PartitionFilters: [isnotnull" in plan
    scanned = spark.table(log).where(F.col(DAY) == dt.date(2026, 5, 23)).inputFiles()
    assert len(scanned) < len(spark.table(log).inputFiles())
    append_new_rows(batch, log)
    append_new_rows(batch, log)
    assert spark.table(log).where("pipeline_run_id = 'c'").count() == 1 and spark.table(log).count() == 15
    assert spark.table(log).where("audited_at is null").count() == 0


def test_recent_runs_read_recent_days(spark, log):
    append_rows(week(spark, ("a", "b")), log)
    since = (NOON + dt.timedelta(days=5)).date()
    recent = reports.latest_runs(spark.table(log), since=since)
    assert sorted((r[0], r["children"]) for r in recent.collect()) == [("a", 2), ("b", 2)]
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert DAY in plan.split("PartitionFilters: [")[1].split("]")[0]
    plain = reports.latest_runs(week(spark, ("a", "b")), since=since)
    assert rows_of(plain) == rows_of(recent)


def test_the_rows_of_an_append_are_computed_once(spark, tmp_path):
    """Counted where they are made: a look at whether there are any must not start them a second time."""
    ensure_log_table(spark, "once.log")
    try:
        for table, by_day in (("once.log", False), ("once.days", True)):
            ensure_log_table(spark, table, by_day=by_day)
            seen = spark.sparkContext.accumulator(0)

            def note(batches, seen=seen):
                for batch in batches:
                    seen.add(batch.num_rows)
                    yield batch

            append_rows(week(spark).mapInArrow(note, ROWS), table)
            assert seen.value == 7, table
    finally:
        spark.sql("drop database once cascade")


def _exchanges(df):
    """What the executed plan moves between tasks, after adaptive planning."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [line for line in plan.splitlines() if "Exchange" in line and "Reused" not in line]


@pytest.mark.parametrize("by_day", [False, True])
def test_reports_on_a_log_dealt_by_run_move_none_of_its_rows(spark, by_day):
    ensure_log_table(spark, "dealt.log", by_day=by_day, buckets=4)
    try:
        append_rows(week(spark, ("a", "b", "c")), "dealt.log")
        append_rows(week(spark, ("d",)), "dealt.log")
        append_rows(week(spark).limit(0), "dealt.log")
        log = spark.table("dealt.log")
        assert log.count() == 28
        assert _exchanges(reports.run_summary(log)) == []
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            activity = spark.createDataFrame([("a", "x"), ("d", "y")], "pipeline_run_id string, trigger_name string")
            moved = _exchanges(reports.with_activity(log, activity))
            assert len(moved) == 1 and reports.with_activity(log, activity).count() == 14
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert rows_of(reports.run_summary(log)) == rows_of(reports.run_summary(week(spark, ("a", "b", "c", "d"))))
    finally:
        spark.sql("drop database dealt cascade")


def test_open_steps_shuffle_their_rows_once(spark):
    records = spark.createDataFrame(
        [("r", "s", NOON + dt.timedelta(minutes=i), "start" if i % 3 else "ok") for i in range(200)],
        "pipeline_run_id string, step string, ts timestamp, phase string",
    )
    opened = steps.open_steps(records)
    assert opened.count() == 67
    opened.collect()
    plan = opened._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan


# ------------------------------------------------------------------ the run log itself


def test_indices_may_lie_far_apart(spark):
    far = 1 << 55
    indices = [0, 1, 70_000, far, far + 1]
    plan = spark.createDataFrame(
        [("r", "p", "t", i, f"/n{i}", None, None, {}, True, {}) for i in indices],
        "pipeline_run_id string, pipeline_name string, log_table string, child_index long, path string, name string, "
        "timeout_seconds int, args map<string,string>, fail_fast boolean, extras map<string,string>",
    )
    values = [("r", i, NOON, NOON, 5, "x", "E" if i == 1 else None, "bad" if i == 1 else None, None) for i in indices]
    outcome = spark.createDataFrame(
        values,
        "pipeline_run_id string, child_index long, started_at timestamp, finished_at timestamp, duration_ms long, "
        "returned string, error_class string, error_message string, error_traceback string",
    )
    for bits in (16, 3, 0):
        rows = runlog.build_runlog(plan, outcome, slice_bits=bits)
        got = {r["child_index"]: r["status"] for r in rows.collect()}
        assert got == {0: "ok", 1: "failed", 70_000: "skipped", far: "skipped", far + 1: "skipped"}
        assert "sequence(" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_lines_from_rows_that_carry_their_names(spark):
    plan = spark.createDataFrame(
        [("r", "p", "t", i, "/jobs/load/", name, None, {}, True, {}) for i, name in enumerate(["first", None, ""])],
        "pipeline_run_id string, pipeline_name string, log_table string, child_index long, path string, name string, "
        "timeout_seconds int, args map<string,string>, fail_fast boolean, extras map<string,string>",
    )
    outcome = spark.createDataFrame(
        [("r", i, NOON, NOON + dt.timedelta(seconds=61), 61_000, "ok", None, None, None) for i in range(3)],
        "pipeline_run_id string, child_index long, started_at timestamp, finished_at timestamp, duration_ms long, "
        "returned string, error_class string, error_message string, error_traceback string",
    )
    looked_up = runlog.console_lines(runlog.build_runlog(plan, outcome), plan)
    carried = runlog.console_lines(runlog.build_runlog(plan, outcome, display_names=True))
    assert rows_of(looked_up) == rows_of(carried)
    clocked = runlog.console_lines(runlog.build_runlog(plan, outcome, display_names=True), clock=True)
    assert [r["line"] for r in clocked.orderBy(*CHILD_KEY).collect()] == [f"[12:01:01] {r['line']}" for r in carried.orderBy(*CHILD_KEY).collect()]
    with pytest.raises(ValueError, match="display_name"):
        runlog.console_lines(runlog.build_runlog(plan, outcome))
