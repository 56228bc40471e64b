import datetime as dt
import json
import random
import re
import uuid

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lakelog.functions import text
from lakelog.operators import reports, runlog
from lakelog.schemas import CHILD_KEY, OUTCOME, PLAN, RUNLOG
from lakelog.sinks.tables import append_new_rows, append_rows, ensure_log_table, read_runlog

NOON = dt.datetime(2026, 5, 21, 12, 0, 0)


def plan_rows(spark, rows):
    """Rows of (run, index, overrides)."""
    base = dict(pipeline_name="p", log_table="meta.log", path="/n/x", name=None, timeout_seconds=None, args=None,
                fail_fast=None, extras=None)
    made = [{**base, "pipeline_run_id": run, "child_index": i, **more} for run, i, more in rows]
    return spark.createDataFrame([tuple(m[c] for c in PLAN.names) for m in made], PLAN)


def outcome_rows(spark, rows):
    made = []
    for run, i, more in rows:
        start = NOON + dt.timedelta(minutes=i)
        base = dict(started_at=start, finished_at=start + dt.timedelta(seconds=5), duration_ms=5000, returned=None,
                    error_class=None, error_message=None, error_traceback=None)
        made.append({**base, "pipeline_run_id": run, "child_index": i, **more})
    return spark.createDataFrame([tuple(m[c] for c in OUTCOME.names) for m in made], OUTCOME)


BAD = dict(error_class="ValueError", error_message="bad data", error_traceback="Traceback ... ValueError: bad data")
SLOW = dict(error_class="RuntimeError", error_message="notebook timed out after 1800 seconds", error_traceback="tb")


def built(spark, outcomes, **plan):
    p = plan_rows(spark, [("r", i, plan) for i in range(len(outcomes))])
    o = outcome_rows(spark, [("r", i, more) for i, more in enumerate(outcomes) if more is not None])
    return runlog.build_runlog(p, o, "orch").orderBy("child_index").collect()


def test_all_pass(spark):
    rows = built(spark, [dict(returned="10rows"), dict(returned="10rows"), dict(returned="ok")])
    assert [r["status"] for r in rows] == ["ok"] * 3
    assert [r["exit_value"] for r in rows] == ["10rows", "10rows", "ok"]
    assert rows[0].asDict().keys() == {n for n in RUNLOG.names if n != "audited_at"}
    assert rows[0]["orchestrator_notebook"] == "orch" and rows[0]["args_json"] == "{}"
    assert {rows[0][c] for c in ("error_class", "error_message", "error_traceback")} == {""}


def test_rest_is_skipped_after_a_failure(spark):
    rows = built(spark, [{}, BAD, dict(returned="never ran")], args={"k": "v"})
    assert [r["status"] for r in rows] == ["ok", "failed", "skipped"]
    skipped = rows[2]
    assert skipped["started_at"] == skipped["finished_at"] == rows[1]["finished_at"]
    assert (skipped["duration_ms"], skipped["exit_value"], skipped["error_class"]) == (0, "", "")
    assert skipped["args_json"] == '{"k": "v"}' and skipped["notebook_path"] == "/n/x"
    assert "ValueError" in rows[1]["error_traceback"] and rows[1]["exit_value"] == ""


def test_timeout_also_stops_the_run(spark):
    assert [r["status"] for r in built(spark, [SLOW, {}])] == ["timeout", "skipped"]


def test_run_all_keeps_going(spark):
    assert [r["status"] for r in built(spark, [{}, BAD, {}], fail_fast=False)] == ["ok", "failed", "ok"]


def test_crashed_child_has_no_row_but_skipped_ones_do(spark):
    assert [(r["child_index"], r["status"]) for r in built(spark, [{}, None, {}])] == [(0, "ok"), (2, "ok")]
    rows = built(spark, [BAD, None, None])
    assert [(r["child_index"], r["status"]) for r in rows] == [(0, "failed"), (1, "skipped"), (2, "skipped")]


def test_outcome_of_an_unplanned_child_changes_nothing(spark):
    plan = plan_rows(spark, [("r", 1, {}), ("r", 2, {})])
    outcome = outcome_rows(spark, [("r", 0, BAD), ("r", 1, {}), ("r", 2, {}), ("s", 0, BAD)])
    rows = runlog.build_runlog(plan, outcome).collect()
    assert {(r["child_index"], r["status"]) for r in rows} == {(1, "ok"), (2, "ok")}


def test_duration_is_measured_only_when_missing(spark):
    rows = built(spark, [dict(duration_ms=4999), dict(duration_ms=None)])
    assert [r["duration_ms"] for r in rows] == [4999, 5000]


def test_error_without_message_is_a_failure(spark):
    row = built(spark, [dict(error_class="KeyboardInterrupt")])[0]
    assert (row["status"], row["error_message"]) == ("failed", "")


def test_giant_message_is_cut(spark):
    row = built(spark, [dict(error_class="E", error_message="x" * 50_000, error_traceback="y" * 50_000)])[0]
    assert row["error_message"] == "x" * 4096 + "…[truncated]"
    assert row["error_traceback"] == "y" * 16384 + "…[truncated]"


def one_by_one(plan, outcome):
    """The rule executed child by child."""
    status = {}
    for run in {r["pipeline_run_id"] for r in plan}:
        failed = False
        for child in sorted((p for p in plan if p["pipeline_run_id"] == run), key=lambda p: p["child_index"]):
            key = (run, child["child_index"])
            if failed and child["fail_fast"]:
                status[key] = "skipped"
                continue
            if key not in outcome:
                continue
            message = outcome[key]
            status[key] = "ok" if message is None else "timeout" if "timed out" in message.lower() else "failed"
            failed = failed or message is not None
    return status


@pytest.mark.parametrize("slice_bits", [0, 1, 3, 16])
def test_against_running_child_by_child(spark, slice_bits):
    rng = random.Random(7)
    plan, outcome = [], []
    for run in range(40):
        fail_fast = rng.random() < 0.7
        for i in range(rng.choice([1, 2, 5, 30])):
            plan.append((f"r{run}", i, dict(fail_fast=fail_fast)))
            if rng.random() < 0.95:
                outcome.append((f"r{run}", i, rng.choice([{}] * 8 + [BAD, SLOW])))
    p, o = plan_rows(spark, plan), outcome_rows(spark, outcome)
    expected = one_by_one(
        [dict(pipeline_run_id=r, child_index=i, **m) for r, i, m in plan],
        {(r, i): m.get("error_message") for r, i, m in outcome},
    )
    rows = runlog.build_runlog(p, o, slice_bits=slice_bits).collect()
    assert {(r["pipeline_run_id"], r["child_index"]): r["status"] for r in rows} == expected
    assert len(rows) == len(expected)


def test_truncate(spark):
    df = spark.createDataFrame([("hello",), ("",), ("x" * 50,), ("é😀" * 10,)], "t string")
    cut = [r[0] for r in df.select(text.truncate(F.col("t"), 3)).collect()]
    assert cut == ["hel…[truncated]", "", "xxx…[truncated]", "é😀é…[truncated]"]


def test_args_json_is_byte_for_byte_the_same(spark):
    cases = [None, {}, {"b": "2", "a": "1"}, {"k": 'q"\\/\n\t\x01\x1f\x7f'}, {"é": "😀 ü\\u00e9 \\", "Z": " "}, {"n": None},
             {'q","value":"x': '},{"key":"z"}]', "]": "]]", "\\": "\\\\u00EF \\é\\", "ÀÉABCDEF": "\x0bÜ\x0e￮𐏿"}]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, m map<string,string>")
    got = [r[0] for r in df.orderBy("i").select(text.args_json(F.col("m"))).collect()]
    assert got == [json.dumps(c or {}, sort_keys=True) for c in cases]


def test_display_names(spark):
    cases = [(None, "/a/b", "b"), ("", "/a/b//", "b"), ("n", "/a", "n"), (None, "x", "x"), (None, "///", "///"), (None, "", "")]
    df = spark.createDataFrame(cases, "name string, path string, expected string")
    assert df.where(text.display_name(F.col("name"), F.col("path")) != F.col("expected")).count() == 0


def test_seconds_round_as_python_prints_them(spark):
    values = [0, 5, 125, 375, 1005, 1015, 2675, 420, 1830, 999_995, 1_800_000, 123_456_785]
    df = spark.createDataFrame([(v,) for v in values], "ms long")
    got = [r[0] for r in df.select(text.seconds_text(F.col("ms"))).collect()]
    assert got == [f"{v / 1000:>6.2f}s" for v in values]


def test_console_lines(spark):
    rows = [
        ("extract", "ok", 1830, "42rows", "", "", "[OK]     extract              1.83s  exit=42rows"),
        ("e" * 30, "ok", 0, "", "", "", f"[OK]     {'e' * 18}   0.00s  "),
        ("t", "failed", 420, "", "ValueError", "missing", f"[FAIL]   {'t':18}   0.42s  ValueError: missing"),
        ("t", "failed", 420, "", "KeyError", "", f"[FAIL]   {'t':18}   0.42s  KeyError"),
        ("x", "timeout", 1_800_000, "", "RuntimeError", "timed out", f"[TIME]   {'x':18} 1800.00s  RuntimeError: timed out"),
        ("load", "skipped", 0, "", "", "", f"[SKIP]   {'load':18}          (fail_fast)"),
        ("o", "ok", 10, "y" * 41, "", "", f"[OK]     {'o':18}   0.01s  exit={'y' * 40}…[truncated]"),
        ("o", "failed", 10, "", "E", "m" * 81, f"[FAIL]   {'o':18}   0.01s  E: {'m' * 80}…[truncated]"),
        ("o", "odd", 10, "", "E", "m", f"[ODD]    {'o':18}   0.01s  E: m"),
    ]
    df = spark.createDataFrame(rows, "n string, s string, d long, x string, c string, m string, expected string")
    line = text.console_line(*[F.col(c) for c in "nsdxcm"])
    for row in df.select(line.alias("line"), "expected").collect():
        assert row["line"] == row["expected"]


def test_plan_defaults(spark):
    plan = plan_rows(spark, [("r", 0, {}), ("r", 1, dict(timeout_seconds=600, fail_fast=False, name="n"))])
    rows = runlog.plan_defaults(plan, 900).orderBy("child_index").collect()
    assert [(r["timeout_seconds"], r["fail_fast"], r["display_name"]) for r in rows] == [(900, True, "x"), (600, False, "n")]


def test_run_ids(spark):
    plan = plan_rows(spark, [("given", 0, {}), ("", 1, {}), (None, 2, {}), ("", 3, dict(pipeline_name="q"))])
    made = runlog.with_run_ids(plan, ["pipeline_name"])
    rows = {r["child_index"]: r["pipeline_run_id"] for r in made.collect()}
    assert rows == {r["child_index"]: r["pipeline_run_id"] for r in made.collect()}, "a second run gives the same ids"
    assert rows[0] == "given" and rows[1] == rows[2] != rows[3]
    for i in (1, 3):
        assert uuid.UUID(rows[i]).version == 4 and uuid.UUID(rows[i]).variant == uuid.RFC_4122
    again = runlog.with_run_ids(plan, ["pipeline_name"]).where("child_index = 1").first()[0]
    assert again != rows[1], "another call gives other ids"


def test_violations_and_strict_mode(spark):
    good = plan_rows(spark, [("a", 0, {}), ("a", 1, {})])
    assert runlog.check_plan(good) is good
    bad = plan_rows(spark, [("b", 0, dict(log_table="")), ("b", 1, dict(log_table="", path=None)), ("c", 0, dict(pipeline_name=None))])
    found = {tuple(r) for r in runlog.plan_violations(good.unionByName(bad)).collect()}
    assert found == {
        ("b", None, "the run has no log_table"),
        ("b", 1, "child 1 has no path"),
        ("c", None, "the run has no pipeline_name"),
    }
    with pytest.raises(ValueError, match="run b: the run has no log_table"):
        runlog.check_plan(bad)


def test_first_failures(spark):
    p = plan_rows(spark, [(r, i, dict(fail_fast=r != "all")) for r in ("ff", "all", "fine") for i in range(4)])
    o = outcome_rows(spark, [(r, i, (BAD, SLOW)[i % 2] if i and r != "fine" else {}) for r in ("ff", "all", "fine") for i in range(4)])
    rows = {r["pipeline_run_id"]: r["message"] for r in runlog.first_failures(runlog.build_runlog(p, o)).collect()}
    expected = "child 1 (/n/x) timeout: RuntimeError: notebook timed out after 1800 seconds"
    assert rows == {"ff": expected, "all": expected}


def test_completeness(spark):
    p = plan_rows(spark, [("r", i, {}) for i in range(4)] + [("s", 0, {})])
    o = outcome_rows(spark, [("r", 0, {}), ("r", 2, BAD)])
    rows = {tuple(r) for r in runlog.completeness(p, runlog.build_runlog(p, o)).collect()}
    assert rows == {("r", 4, 3, 1), ("s", 1, 0, 1)}


RESULT = dict(pipeline_run_id="r1", pipeline_name="p", child_index=0, notebook_path="/n/x", status="ok",
              started_at="2026-05-21T12:00:00+00:00", finished_at="2026-05-21T12:00:01.830000+00:00", duration_ms=1830,
              exit_value="v", args_json="{}", error_class="", error_message="", error_traceback="", orchestrator_notebook="")


def staged(spark, *rows):
    schema = ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in sorted(RESULT.items()))
    made = [{**RESULT, **r} for r in rows]
    return spark.createDataFrame([tuple(v for _, v in sorted(m.items())) for m in made], schema)


@pytest.fixture
def table(spark, request):
    name = "logs." + re.sub(r"\W", "_", request.node.name)
    yield name
    spark.sql(f"drop table if exists {name}")


def test_table_is_created_once_with_its_database(spark, table):
    ensure_log_table(spark, table)
    ensure_log_table(spark, table)
    assert spark.catalog.databaseExists("logs")
    assert spark.table(table).columns == RUNLOG.names
    assert [f.dataType for f in spark.table(table).schema] == [f.dataType for f in RUNLOG.fields]
    ensure_log_table(spark, "bare_log")
    assert spark.catalog.tableExists("bare_log")
    spark.sql("drop table bare_log")


def test_append_by_name_with_stamp(spark, table):
    ensure_log_table(spark, table)
    append_rows(staged(spark, dict(child_index=1), {}), table)
    rows = read_runlog(spark, table).collect()
    assert [r["child_index"] for r in rows] == [0, 1]
    assert rows[0]["notebook_path"] == "/n/x" and rows[0]["finished_at"] == dt.datetime(2026, 5, 21, 12, 0, 1, 830000)
    assert all(r["audited_at"] is not None for r in rows)
    files = spark.table(table).inputFiles()
    append_rows(staged(spark, {}).limit(0), table)
    spark.catalog.refreshTable(table)
    assert sorted(spark.table(table).inputFiles()) == sorted(files) and spark.table(table).count() == 2


def test_dry_run_writes_nothing(spark, table):
    ensure_log_table(spark, table)
    assert append_rows(staged(spark, {}), table, write=False).count() == 1
    assert spark.table(table).count() == 0


def test_null_fails_before_the_commit_or_is_set_aside(spark, table):
    ensure_log_table(spark, table)
    rows = staged(spark, {}, dict(child_index=1, exit_value=None, status=None))
    with pytest.raises(Exception, match="status, exit_value"):
        append_rows(rows, table)
    assert spark.table(table).count() == 0
    marked = runlog.mark_nulls(runlog.stage(rows)).orderBy("child_index").collect()
    assert [(r["child_index"], r["null_columns"]) for r in marked] == [(0, []), (1, ["status", "exit_value"])]


def test_a_batch_that_comes_twice_is_written_once(spark, table):
    ensure_log_table(spark, table)
    append_new_rows(staged(spark, {}, {}, dict(child_index=1)), table)
    append_new_rows(staged(spark, dict(child_index=1), dict(child_index=2), dict(pipeline_run_id="r2")), table)
    keys = [tuple(r) for r in read_runlog(spark, table).select(*CHILD_KEY).collect()]
    assert keys == [("r1", 0), ("r1", 1), ("r1", 2), ("r2", 0)]


def sample(spark):
    p = plan_rows(spark, [(r, i, dict(fail_fast=False, pipeline_name=n)) for r, n in (("a", "p"), ("b", "p"), ("c", "q")) for i in range(6)])
    o = outcome_rows(spark, [(r, i, BAD if i == 1 else SLOW if i == 2 else {}) for r in "abc" for i in range(6)])
    return runlog.build_runlog(p, o)


def test_detail_and_summary(spark):
    detail = reports.run_detail(sample(spark), "p").collect()
    assert [(r["pipeline_run_id"], r["child_index"]) for r in detail] == [(r, i) for r in "ba" for i in range(6)]
    assert detail[0]["seconds"] == 5.0
    latest = reports.latest_runs(sample(spark), runs=2).collect()
    assert [r["pipeline_run_id"] for r in latest] == ["a", "b"], "equal starts go by run id"
    assert (latest[0]["children"], latest[0]["failed"]) == (6, 1), "a timeout is not among the failed"
    assert latest[0]["run_start"] == NOON and latest[0]["run_end"] == NOON + dt.timedelta(minutes=5, seconds=5)


def test_join_with_activity(spark):
    activity = spark.createDataFrame([("a", "nightly"), ("c", "manual"), ("zz", "other")], "pipeline_run_id string, trigger string")
    joined = reports.with_activity(sample(spark), activity)
    rows = {(r["pipeline_run_id"], r["child_index"]): r["trigger"] for r in joined.collect()}
    assert rows == {(r, i): t for r, t in (("a", "nightly"), ("c", "manual")) for i in range(6)}


def test_join_with_steps(spark):
    spans = spark.createDataFrame(
        [("a", 0, "ok", 10), ("a", 0, "failed", 5), ("a", None, "ok", 7), ("a", None, "ok", 1), ("z", 0, "ok", 9)],
        "pipeline_run_id string, child_index long, phase string, duration_ms long",
    )
    joined = reports.with_steps(sample(spark), spans)
    rows = {(r["pipeline_run_id"], r["child_index"]): (r["child_steps"], r["child_steps_failed"], r["child_step_ms"],
                                                       r["run_steps"], r["run_step_ms"]) for r in joined.collect()}
    assert len(rows) == 18
    assert rows["a", 0] == (2, 1, 15, 2, 8) and rows["a", 5] == (0, 0, 0, 2, 8) and rows["b", 0] == (0, 0, 0, 0, 0)


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_window_and_no_wide_scan_for_the_skip_rule(spark, tmp_path):
    plan_rows(spark, [("r", 0, {})]).write.parquet(f"{tmp_path}/plan")
    outcome_rows(spark, [("r", 0, {})]).write.parquet(f"{tmp_path}/outcome")
    log = runlog.build_runlog(
        spark.read.schema(PLAN).parquet(f"{tmp_path}/plan"), spark.read.schema(OUTCOME).parquet(f"{tmp_path}/outcome")
    )
    text_ = plan_text(log)
    assert "Window" not in text_
    assert text_.count("error_traceback:string") == 1, "the wide columns are read once"
    assert "Or(IsNotNull(error_class),IsNotNull(error_message))" in text_


def test_summary_combines_before_the_shuffle_and_top_k_keeps_k(spark):
    text_ = plan_text(reports.latest_runs(sample(spark)))
    assert "TakeOrderedAndProject" in text_ and "partial_min" in text_
