"""Caps without a single task, lakes of many tables, and listing them."""

import threading

import pytest
from pyspark.sql import functions as F

from lakelog.operators import search as searching
from lakelog.operators.quota import capped
from lakelog.operators.search import Search, in_batches, search_lake, search_large_lake, search_summary
from lakelog.sources import catalog


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ------------------------------------------------------------------ caps


@pytest.mark.parametrize("tasks", [1, 5, 16])
@pytest.mark.parametrize("cap", [0, 1, 99, 400, 401, 5000])
def test_a_cap_keeps_exactly_as_many(spark, tasks, cap):
    rows = spark.range(0, 4000, 1, tasks).where("id % 10 = 3")
    kept, more = capped(rows, cap)
    assert kept.count() == min(cap, 400) and more == (cap < 400)
    assert kept.distinct().count() == kept.count() and kept.columns == ["id"]
    assert "SinglePartition" not in plan_of(kept)


def test_rows_crowded_into_one_task_count_like_others(spark):
    rows = spark.range(0, 1000, 1, 8).where("id < 100")
    assert [capped(rows, cap)[0].count() for cap in (99, 100, 101)] == [99, 100, 100]
    assert [capped(rows, cap)[1] for cap in (99, 100, 101)] == [True, False, False]


def test_an_ordered_cap_keeps_the_first_of_all_tasks(spark):
    rows = spark.range(0, 1000, 1, 8).select((F.col("id") * 7 % 1000).alias("n"), F.lit(None).cast("string").alias("x.y"))
    kept, more = capped(rows, 37, [F.desc("n")])
    assert sorted(r["n"] for r in kept.collect()) == list(range(963, 1000)) and more
    assert kept.columns == ["n", "x.y"]
    only, _ = capped(rows, 3, [F.col("n")], [(F.col("n") + 1).alias("m")])
    assert only.columns == ["m"] and sorted(r[0] for r in only.collect()) == [1, 2, 3]


def test_no_rows_are_within_any_cap(spark):
    kept, more = capped(spark.range(0), 5)
    assert kept.count() == 0 and not more


# ------------------------------------------------------------------ many tables


@pytest.fixture(scope="module")
def many(spark):
    base = spark.range(0, 40, 1, 1)
    return {("d", f"t{i:03d}"): base.select("id", F.concat(F.lit(f"w{i % 3} "), F.col("id").cast("string")).alias("s")) for i in range(150)}


def test_a_large_lake_is_searched_in_plans_of_bounded_size(spark, many, monkeypatch):
    sizes = []
    union = searching.union_all
    monkeypatch.setattr(searching, "union_all", lambda s, parts, c: sizes.append(len(parts)) or union(s, parts, c))
    monkeypatch.setattr(searching, "BRANCHES", 16)
    found = search_lake(spark, many, Search(("w1",)))
    assert found.count() == 50 * 40 and max(sizes) <= 64 and len(sizes) >= 3
    sizes.clear()
    summary = search_summary(spark, many, Search(("w1", "39"), "AND"))
    assert {r["table"]: r["count"] for r in summary.collect()} == {f"t{i:03d}": 1 for i in range(150) if i % 3 == 1}
    assert max(sizes) <= 64


def test_small_and_large_lakes_give_the_same(spark, many):
    some = dict(list(many.items())[:20])
    search = Search(("w2", "7"))
    lazy = search_lake(spark, some, search)
    stored, failed = search_large_lake(spark, some, search, jobs=3)
    assert sorted(map(tuple, lazy.collect())) == sorted(map(tuple, stored.collect())) and failed.count() == 0


def test_a_failing_table_is_listed_and_the_others_are_searched(spark, many):
    some = dict(list(many.items())[:9])
    broken = spark.range(3).select(F.raise_error(F.lit("gone")).cast("string").alias("s"))
    lake = {**some, ("d", "broken"): broken}
    matches, failed = search_large_lake(spark, lake, Search(("w0",)))
    assert matches.count() == 3 * 40
    assert [(r["database"], r["table"]) for r in failed.collect()] == [("d", "broken")]
    capped_matches, failed = search_large_lake(spark, lake, Search(("w0",), cap=5))
    assert capped_matches.groupBy("table").count().where("count <> 5").count() == 0 and capped_matches.count() == 15
    with pytest.raises(RuntimeError, match="d.broken"):
        search_lake(spark, lake, Search(("w0",), cap=5))


def test_only_the_tables_at_fault_are_missing(many):
    tried = []

    def work(part):
        tried.append(len(part))
        if ("d", "t004") in part:
            raise searching.FAILURES[0]("no such file\nat line 2")
        return len(part)

    done, failed = in_batches(dict(list(many.items())[:10]), work, size=4, jobs=2)
    assert sorted(done) == [1, 1, 1, 2, 4] and failed == [("d", "t004", failed[0][2])] and "\n" not in failed[0][2]


def test_nothing_searchable(spark):
    lake = {("d", "lists"): spark.range(2).select(F.array("id").alias("a"))}
    matches, failed = search_large_lake(spark, lake, Search(("x",)))
    assert matches.count() == failed.count() == 0 and matches.columns == ["database", "table", "row_json"]


# ------------------------------------------------------------------ listing


def test_many_tables_are_listed_side_by_side(spark, monkeypatch):
    threads = set()
    quoted = catalog.quoted_name
    monkeypatch.setattr(catalog, "quoted_name", lambda name: threads.add(threading.get_ident()) or quoted(name))
    spark.sql("create database if not exists crowded")
    try:
        for i in range(60):
            spark.sql(f"create view crowded.v{i:02d} as select {i} as n")
        spark.sql("create view crowded.over as select * from crowded.v00")
        spark.sql("drop view crowded.v00")
        lake, skipped = catalog.catalog_lake(spark, include=["crowded", "absent"])
        assert list(lake) == [("crowded", f"v{i:02d}") for i in range(1, 60)]
        assert {(r["database"], r["table"]) for r in skipped.collect()} == {("crowded", "over"), ("absent", "")}
        assert len(threads) > 2
    finally:
        spark.sql("drop database crowded cascade")
