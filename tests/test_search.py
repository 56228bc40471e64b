import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lakelog.operators.search import (
    Search,
    batches,
    matched_columns,
    search_lake,
    search_one_table,
    search_summary,
    skipped_tables,
)
from lakelog.sinks.results import write_search
from lakelog.sources.files import parquet_lake

FOLDER = "/root/testdata/sf0.001"
WHEN = dt.datetime(2024, 5, 6, 7, 8, 9)


@pytest.fixture(scope="module")
def lake(spark):
    people = spark.sql(
        "select * from values (1, 'ann', timestamp'2024-01-01 10:00:00'), (2, 'bob', timestamp'2024-01-05 00:00:00'),"
        " (3, 'annabel', timestamp'2024-02-01 00:00:00') as t(id, name, ingested_at)"
    )
    numbers = spark.range(100).select("id", (F.col("id") % 5).alias("n"))
    lists = spark.sql("select array(1, 2) as a")
    return {("hr", "people"): people, ("hr", "numbers"): numbers, ("raw", "lists"): lists}


def test_one_table_keeps_its_columns(lake):
    found = search_one_table(lake["hr", "people"], Search(("ANN",)))
    assert found.columns == ["id", "name", "ingested_at"] and found.count() == 2
    assert search_one_table(lake["raw", "lists"], Search(("1",))) is None


def test_projection_keeps_matched_and_ingestion_columns(lake):
    found = search_one_table(lake["hr", "people"], Search(("ann",), project_matched_only=True))
    assert found.columns == ["name", "ingested_at"]


def test_window_applies_where_the_column_exists(spark, lake):
    search = Search(("ann", "3"), date_range=("2024-01-01", "2024-01-31"))
    counts = {r["table"]: r["count"] for r in search_summary(spark, lake, search).collect()}
    assert counts == {"people": 1, "numbers": 1 + 19 + 1 - 1}


def test_lake_rows_are_json_with_nulls_kept(spark):
    lake = {("d", "t"): spark.sql("select 'hit' as a, cast(null as int) as b")}
    row = search_lake(spark, lake, Search(("hit",))).first()
    assert (row["database"], row["table"], json.loads(row["row_json"])) == ("d", "t", {"a": "hit", "b": None})


def test_summary_counts_and_message(spark, lake):
    rows = {r["table"]: r for r in search_summary(spark, lake, Search(("ann", "3"), cap=10)).collect()}
    assert set(rows) == {"people", "numbers"}
    assert rows["people"]["message"] == "2 rows matched OR ['ann', '3'] in ['id', 'name']"
    assert rows["people"]["matched_columns"] == "id, name"
    many = rows["numbers"]
    assert (many["count"], many["kept"], many["truncated"]) == (20, 10, True)
    assert many["message"] == "20 rows matched OR ['ann', '3'] in ['id', 'n'] (truncated)"


def test_cap_at_the_exact_count_is_no_truncation(spark, lake):
    row = search_summary(spark, {("hr", "numbers"): lake["hr", "numbers"]}, Search(("3",), cap=20)).first()
    assert (row["count"], row["truncated"]) == (20, False)


def test_ordered_cap_is_deterministic(lake):
    found = search_one_table(lake["hr", "numbers"], Search(("3",), cap=4, order_by=("id",)))
    assert [r["id"] for r in found.orderBy("id").collect()] == [3, 8, 13, 18]


def test_schema_level_answers(spark, lake):
    search = Search(("ann",))
    assert {(r["table"], tuple(r["matched_columns"])) for r in matched_columns(spark, lake, search).collect()} == {
        ("people", ("name",)),
        ("numbers", ()),
        ("lists", ()),
    }
    assert {r["table"] for r in skipped_tables(spark, lake, search).collect()} == {"numbers", "lists"}


def test_nothing_searchable_gives_empty_results(spark, lake):
    only = {("raw", "lists"): lake["raw", "lists"]}
    assert search_lake(spark, only, Search(("1",))).count() == 0
    assert search_summary(spark, only, Search(("1",))).count() == 0


def test_batches_cover_the_lake_once(lake):
    parts = list(batches(lake, 2))
    assert [len(p) for p in parts] == [2, 1] and [n for p in parts for n in p] == list(lake)


def written(spark, dest):
    schema = "row_json string, database string, table string"
    rows = spark.read.schema(schema).parquet(f"{dest}/matches").groupBy("table").count().collect()
    summary = {r["table"]: (r["count"], r["truncated"]) for r in spark.read.parquet(f"{dest}/summary").collect()}
    return {r["table"]: r["count"] for r in rows}, summary


@pytest.mark.parametrize("cap, numbers", [(None, 20), (100, 20), (20, 20), (19, 19), (1, 1)])
def test_written_rows_agree_with_the_summary(spark, lake, tmp_path, cap, numbers):
    dest = write_search(spark, lake, Search(("3", "zed"), cap=cap), f"{tmp_path}/", WHEN, jobs=2)
    assert dest.startswith(f"{tmp_path}/search_20240506_070809_")
    rows, summary = written(spark, dest)
    expected = {"people": 1, "numbers": numbers}
    assert rows == expected
    assert summary == {t: (n, t == "numbers" and numbers < 20) for t, n in expected.items()}
    assert [r["table"] for r in spark.read.parquet(f"{dest}/skipped").collect()] == ["lists"]


@pytest.mark.parametrize("tasks", [1, 7])
def test_hits_crowded_into_one_task_are_found(spark, tmp_path, tasks):
    crowded = spark.range(0, 10_000, 1, tasks).select("id", F.when(F.col("id") < 900, "hit").otherwise("no").alias("s"))
    for cap, expected in ((1000, (900, False)), (640, (640, True))):
        dest = write_search(spark, {("d", "t"): crowded}, Search(("hit",), cap=cap), f"{tmp_path}/{cap}", WHEN)
        rows, summary = written(spark, dest)
        assert rows == {"t": expected[0]} and summary == {"t": expected}


def test_ordered_cap_writes_the_first_rows(spark, lake, tmp_path):
    part = {("hr", "numbers"): lake["hr", "numbers"]}
    dest = write_search(spark, part, Search(("3",), cap=2, order_by=("id",)), str(tmp_path), WHEN)
    rows = [json.loads(r["row_json"])["id"] for r in spark.read.parquet(f"{dest}/matches").collect()]
    assert sorted(rows) == [3, 8]


def test_more_than_a_million_hits_are_all_written(spark, tmp_path):
    many = spark.range(1_000_100).select("id", F.lit("hit").alias("s"))
    rows, summary = written(spark, write_search(spark, {("d", "t"): many}, Search(("hit",)), str(tmp_path), WHEN))
    assert rows == {"t": 1_000_100} and summary == {"t": (1_000_100, False)}


def test_two_searches_in_one_second_stay_apart(spark, lake, tmp_path):
    folders = {write_search(spark, lake, Search(("3",)), str(tmp_path), WHEN) for _ in range(2)}
    assert len(folders) == 2
    assert all(written(spark, f)[0] == {"people": 1, "numbers": 20} for f in folders)


def test_broken_tables_are_listed_even_if_nothing_matched(spark, lake, tmp_path):
    bad = spark.range(3).select(F.raise_error(F.lit("gone")).cast("string").alias("s"))
    dest = write_search(spark, {("d", "bad"): bad}, Search(("x",)), str(tmp_path), WHEN)
    assert [r["table"] for r in spark.read.parquet(f"{dest}/skipped").collect()] == ["bad"]
    dest = write_search(spark, {**lake, ("d", "bad"): bad}, Search(("3",)), str(tmp_path), WHEN)
    assert written(spark, dest)[0] == {"people": 1, "numbers": 20}
    assert {r["table"] for r in spark.read.parquet(f"{dest}/skipped").collect()} == {"bad", "lists"}


def test_no_match_writes_nothing(spark, lake, tmp_path):
    assert write_search(spark, lake, Search(("nowhere",)), str(tmp_path), WHEN) is None


def test_a_broken_table_does_not_stop_the_others(spark, lake, tmp_path):
    bad = spark.range(5).select("id", F.raise_error(F.lit("broken file")).cast("string").alias("s"))
    dest = write_search(spark, {**lake, ("raw", "bad"): bad}, Search(("ann",)), str(tmp_path), WHEN)
    assert written(spark, dest)[0] == {"people": 2}
    reasons = {r["table"]: r["reason"] for r in spark.read.parquet(f"{dest}/skipped").collect()}
    assert "bad" in reasons and set(reasons) == {"numbers", "lists", "bad"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_predicates_reach_the_scan(spark):
    lake = parquet_lake(spark, FOLDER, ["events", "lineitem"])
    dated = plan_of(search_one_table(lake["lake", "events"].select("event_id", "ts"), Search(("2024-01-15",), cap=None)))
    assert "GreaterThanOrEqual(ts" in dated and "LessThan(ts" in dated
    exact = plan_of(search_one_table(lake["lake", "lineitem"].select("l_orderkey", "l_quantity"), Search(("42",), cap=None)))
    assert "Or(EqualTo(l_orderkey,42),EqualTo(l_quantity,42.0))" in exact


def test_window_reaches_the_scan_and_columns_are_pruned(spark):
    events = parquet_lake(spark, FOLDER, ["events"])["lake", "events"]
    search = Search(("error",), ingested_col="ts", date_range=("2024-01-10", "2024-01-15"), project_matched_only=True)
    plan = plan_of(search.matching(events))
    assert "GreaterThanOrEqual(ts,2024-01-10T00:00" in plan and "LessThan(ts,2024-01-16T00:00" in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,props:string>" in plan


def test_summary_moves_one_number_per_table(spark):
    plan = plan_of(search_summary(spark, parquet_lake(spark, FOLDER, ["events", "part"]), Search(("ring",))))
    assert "partial_count" in plan and "Limit" not in plan
