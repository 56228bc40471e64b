import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from lakelog.functions.text import iso_utc
from lakelog.operators import logs, steps
from lakelog.operators.slices import TIME_BITS, with_next, with_position
from lakelog.plans.inputs import instant
from lakelog.schemas import LOG_LINE_KEYS, LOG_RECORDS

NOON = dt.datetime(2026, 5, 21, 12, 0, 0)
FACTS = (
    "pipeline_run_id string, pipeline_name string, child_index long, step string, started_at timestamp, duration_ms long,"
    " error_class string, error_message string, attrs map<string,string>, metrics map<string,string>"
)


def facts(spark, *rows):
    base = dict(pipeline_run_id="r", pipeline_name="p", child_index=None, step="extract", started_at=NOON, duration_ms=1230,
                error_class=None, error_message=None, attrs={"source": "lab.raw"}, metrics={"rows_in": "100"})
    return spark.createDataFrame([tuple({**base, **r}.values()) for r in rows], FACTS)


def test_ok_step_has_start_and_exit(spark):
    start, done = steps.step_events(facts(spark, {})).orderBy("ts").collect()
    assert start.__fields__ == LOG_RECORDS.names
    assert (start["phase"], start["level"], start["msg"], start["duration_ms"]) == ("start", "INFO", "step start: extract", None)
    assert (done["phase"], done["msg"], done["duration_ms"]) == ("ok", "step ok: extract (1230ms)", 1230)
    assert done["ts"] == NOON + dt.timedelta(milliseconds=1230)
    assert start["attrs"] == done["attrs"] == {"source": "lab.raw"}
    assert start["metrics"] is None and done["metrics"] == {"rows_in": "100"}


def test_failed_step(spark):
    done = steps.step_events(facts(spark, dict(error_class="ValueError", error_message="b" * 5000))).where("phase <> 'start'").first()
    assert (done["level"], done["phase"], done["msg"]) == ("ERROR", "failed", "step failed: extract (ValueError)")
    assert done["error_message"] == "b" * 4096 + "…[truncated]" and done["metrics"] is None


def test_open_step_has_only_its_start(spark):
    assert [r["phase"] for r in steps.step_events(facts(spark, dict(duration_ms=None))).collect()] == ["start"]


def test_metrics_win_over_attributes(spark):
    df = spark.sql("select map('a', '1', 'b', '2') as attrs, map('b', null, 'c', '3') as metrics")
    assert df.select(steps.merge_metrics(F.col("attrs"), F.col("metrics"))).first()[0] == {"a": "1", "b": None, "c": "3"}
    none = df.select(steps.merge_metrics(F.lit(None).cast("map<string,string>"), F.col("metrics"))).first()[0]
    assert none == {"b": None, "c": "3"}


def test_active_run_id_is_stamped_where_missing(spark):
    records = steps.step_events(facts(spark, dict(pipeline_run_id=None), {}))
    assert {r[0] for r in steps.with_run_id(records, "active").select("pipeline_run_id").collect()} == {"active", "r"}
    assert steps.with_run_id(records, None).where("pipeline_run_id is null").count() == 2


def test_spans_come_from_exits(spark):
    rows = facts(spark, {}, dict(step="load", error_class="E", duration_ms=10), dict(step="open", duration_ms=None))
    spans = {r["step"]: r for r in steps.step_spans(steps.step_events(rows)).collect()}
    assert set(spans) == {"extract", "load"}
    assert spans["extract"]["started_at"] == NOON and spans["load"]["phase"] == "failed"


def test_latest_metric_wins(spark):
    writes = spark.createDataFrame(
        [("r", "s", "rows", 1.0, 1), ("r", "s", "rows", 3.0, 2), ("r", "s", "size", 9.0, 0), ("r", "t", "rows", 5.0, 0)],
        "pipeline_run_id string, step string, key string, value double, seq int",
    )
    rows = {tuple(r)[1:] for r in steps.latest_metrics(writes, ["seq"]).collect()}
    assert rows == {("s", "rows", 3.0), ("s", "size", 9.0), ("t", "rows", 5.0)}


@pytest.mark.parametrize("bits", [12, 26, 62])
def test_open_steps_in_groups_of_any_size(spark, bits):
    rng, rows = random.Random(3), []
    for run in ("big", "small"):
        for i in range(200 if run == "big" else 3):
            at = NOON + dt.timedelta(seconds=40 * i)
            rows.append((run, "s", at, "start"))
            if rng.random() < 0.8:
                rows.append((run, "s", at + dt.timedelta(seconds=rng.choice([0, 1, 39, 130])), rng.choice(["ok", "failed"])))
    ordered = sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3] != "start"))
    expected = sorted(
        (r[0], r[2]) for r, nxt in zip(ordered, ordered[1:] + [("", "", None, "")])
        if r[3] == "start" and not (nxt[0] == r[0] and nxt[3] != "start")
    )
    records = spark.createDataFrame(rows, "pipeline_run_id string, step string, ts timestamp, phase string")
    got = sorted((r[0], r[2]) for r in steps.open_steps(records, bits).collect())
    assert got == expected and expected


@pytest.mark.parametrize("bits", [0, 3, 20])
def test_positions_and_followers_in_slices(spark, bits):
    rng = random.Random(11)
    rows = [(rng.choice(["a", "a", "b", None]), rng.randrange(300), i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, t int, id int")
    args = (["g"], ["t", "id"])
    position = {r["id"]: r["p"] for r in with_position(df, *args, F.col("t"), "p", bits).collect()}
    follower = {r["id"]: r["n"] for r in with_next(df, *args, "id", F.col("t"), "n", bits).collect()}
    for group in ("a", "b", None):
        ids = [r[2] for r in sorted((r for r in rows if r[0] == group), key=lambda r: r[1:])]
        assert [position[i] for i in ids] == list(range(len(ids)))
        assert [follower[i] for i in ids] == ids[1:] + [None]
    assert len(position) == len(follower) == 400


def test_hot_path_sorts_slices_not_groups(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("g"), "id")
    plan = with_position(df, ["g"], ["id"], F.col("id"), "p", 5)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_key" in plan and "_slice" in plan


def test_a_burst_is_spread_and_read_once(spark, tmp_path):
    at = F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 1000)
    burst = spark.range(20_000).select(
        F.lit("r").alias("pipeline_run_id"), F.lit("s").alias("step"), at.alias("ts"), F.lit("start").alias("phase")
    )
    burst.write.parquet(str(tmp_path / "burst"))
    opened = steps.open_steps(spark.read.parquet(str(tmp_path / "burst")))
    assert opened.count() == 20_000
    slices = burst.groupBy(F.shiftright(F.unix_micros("ts"), TIME_BITS)).count().collect()
    assert len(slices) >= 19 and max(r["count"] for r in slices) <= 1049
    opened.collect()
    plan = opened._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan") == 1 and "Broadcast" not in plan


RECORD = dict(ts=dt.datetime(2026, 5, 21, 14, 2, 11), level="INFO", logger="lakelog.run", msg='say "hi"\nthere', pipeline_run_id="r-1",
              pipeline_name="", child_index=0, step="extract", phase=None, duration_ms=1230, error_class=None, error_message=None,
              exc_info=None, attrs={"a": "b"}, metrics=None)


def records(spark, *rows):
    return spark.createDataFrame([tuple({**RECORD, **r}.values()) for r in rows], LOG_RECORDS)


def test_line_has_fixed_order_and_no_nulls(spark):
    line = logs.to_lines(records(spark, {})).first()[0]
    assert "\n" not in line
    assert list(json.loads(line)) == ["ts", "level", "logger", "msg", "pipeline_run_id", "pipeline_name", "child_index", "step", "duration_ms"]
    assert json.loads(line)["ts"] == "2026-05-21T14:02:11+00:00"
    assert json.loads(line)["child_index"] == 0 and json.loads(line)["pipeline_name"] == ""


CLOCK_CHANGES = [1, 1704110400000000, 1710037800500000, 1710055800000000, 1730611800000000, 1730615400000000]


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata", "UTC"])
def test_time_is_utc_in_every_session_zone(spark, zone):
    df = spark.createDataFrame([(m,) for m in CLOCK_CHANGES], "m long").select("m", F.timestamp_micros("m").alias("t"))
    local = F.timestamp_add("MICROSECOND", F.col("m"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        rows = df.select("m", iso_utc(F.col("t")).alias("iso"), F.unix_micros(instant(local)).alias("back")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    epoch = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
    assert len(rows) == len(CLOCK_CHANGES)
    for row in rows:
        assert row["iso"] == (epoch + dt.timedelta(microseconds=row["m"])).isoformat()
        assert row["back"] == row["m"]


def test_round_trip_and_corrupt_lines(spark):
    good = records(spark, {}, dict(ts=dt.datetime(2026, 1, 1, 0, 0, 0, 5), exc_info="Traceback\n  x", child_index=None))
    junk = ["", "plain text", '{"ts": "2026', "[1, 2]", '{"k": 1}', '{"ts": "soon", "level": "I", "logger": "l", "msg": "m"}', "null"]
    lines = logs.to_lines(good).unionByName(spark.createDataFrame([(j,) for j in junk], "value string"))
    parsed = logs.from_lines(lines)
    assert sorted(r[0] for r in parsed.where("corrupt_line is not null").select("corrupt_line").collect()) == sorted(junk)
    back = parsed.where("corrupt_line is null").select(*LOG_LINE_KEYS)
    assert sorted(back.collect(), key=repr) == sorted(good.select(*LOG_LINE_KEYS).collect(), key=repr)


def test_unknown_keys_are_ignored(spark):
    line = '{"ts": "2026-05-21T14:02:11Z", "level": "INFO", "logger": "l", "msg": "m", "rows_in": 100}'
    row = logs.from_lines(spark.createDataFrame([(line,)], "value string")).first()
    assert row["corrupt_line"] is None and row["msg"] == "m"
