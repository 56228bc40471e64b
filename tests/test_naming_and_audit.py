import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from lakelog.functions.text import bad_characters
from lakelog.operators.audit import dirty_columns, dirty_report
from lakelog.operators.naming import safe_names
from lakelog.sinks.tables import save_dirty_columns
from lakelog.sources import catalog


def served_in_order(names):
    """The rule itself, one name after the other."""
    taken, chosen = {"summary"}, []
    for name in names:
        base = re.sub(r"[\[\]:*?/\\]", "_", name)[:31] or "sheet"
        pick, n = base, 0
        while pick in taken:
            n += 1
            pick = base[: 31 - len(f"_{n}")] + f"_{n}"
        taken.add(pick)
        chosen.append(pick)
    return chosen


def check(spark, names, **options):
    frame = spark.createDataFrame(list(enumerate(names)), "ordinal long, name string")
    got = {r["ordinal"]: r["safe_name"] for r in safe_names(frame, **options).collect()}
    assert [got[i] for i in range(len(names))] == served_in_order(names)


def test_simple_names(spark):
    check(spark, ["a.b", "a:b", "a/b", "", "", "summary", "x" * 40, "x" * 41, "[q]*?\\"])


def test_choices_of_one_group_are_names_of_another(spark):
    check(spark, ["a_1", "a", "a", "a_2", "a", "a_1", "a_1_1", "a", "a_3", "a_1"])
    check(spark, ["a"] * 5 + [f"a_{i}" for i in range(6)] + ["a"] * 3)
    check(spark, [f"a_{i}" for i in range(1, 100)] + ["a"] * 4)


def test_cut_names_compete_for_the_same_choices(spark):
    stem = "p" * 29
    check(spark, [stem + tail for tail in ("aa", "ab", "aa", "ab", "ac", "ac", "aa", "_1", "_1")])
    check(spark, [f"http://www.example.com/some/path/{i % 70}/x" for i in range(300)])


def test_large_group_is_numbered_in_slices(spark):
    check(spark, ["same"] * 50 + ["other", "same_3"] * 3, bits=3)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(names=st.lists(st.sampled_from(["a", "a_1", "a_2", "a_1_1", "b", "summary", "summary_1", ""]), max_size=14))
def test_any_order_of_competing_names(spark, names):
    check(spark, names)


AUDIT = [
    ("lake", "customer", "c name", " "),
    ("lake", "customer", "c_name", ""),
    ("lake", "orders", "total.price$", "$."),
    ("lake", "orders", "o-date", ""),
    ("lake", "part", "größe (cm)", " ()ßö"),
    ("raw", "events", "user id", " "),
    ("raw", "events", "ts", ""),
]


def test_bad_characters_and_report(spark):
    columns = spark.createDataFrame([row[:3] for row in AUDIT], "database string, table string, column string")
    dirty = dirty_columns(columns)
    assert {tuple(r) for r in dirty.collect()} == {row for row in AUDIT if row[3]}
    assert tuple(dirty_report(dirty).first()) == (4, 4)
    clean = dirty_report(dirty_columns(columns.where("column = 'ts'"))).first()
    assert tuple(clean) == (0, 0)


def test_own_pattern_with_groups(spark):
    one = spark.sql("select 'aXbYX' as c")
    assert one.select(bad_characters(F.col("c"), "(X)|(Y)")).first()[0] == "XY"


@pytest.fixture(scope="module")
def two_databases(spark):
    spark.sql("create database if not exists shop")
    spark.sql("create database if not exists `odd_name`")
    spark.sql("create table shop.items using parquet as select 1 as `item id`, 'x' as name")
    spark.sql("create table `odd_name`.`t` using parquet as select 1 as ok")
    spark.range(1).createOrReplaceTempView("floating")
    spark.sql("create table shop.gone using parquet as select 1 as a")
    spark.sql("create view shop.orphan as select a from shop.gone")
    spark.sql("drop table shop.gone")
    yield
    spark.catalog.dropTempView("floating")
    spark.sql("drop database shop cascade")
    spark.sql("drop database `odd_name` cascade")


def test_databases_by_include_and_skip(spark, two_databases):
    every, missing = catalog.databases(spark)
    assert {"default", "shop", "odd_name"} <= set(every) and missing == []
    assert catalog.databases(spark, include=["shop", "nope"]) == (["shop"], ["nope"])
    assert "default" not in catalog.databases(spark, skip=catalog.SKIP_DATABASES)[0]


def test_temporary_views_belong_to_no_database(spark, two_databases):
    pairs, failed = catalog.table_names(spark, ["shop", "nope"])
    assert set(pairs) == {("shop", "items"), ("shop", "orphan")}
    assert [(f[0], f[1]) for f in failed] == [("nope", "")]


def test_unreadable_tables_are_listed_not_raised(spark, two_databases):
    lake, skipped = catalog.catalog_lake(spark, include=["shop", "odd_name", "nope"])
    assert set(lake) == {("shop", "items"), ("odd_name", "t")}
    assert {(r["database"], r["table"]) for r in skipped.collect()} == {("shop", "orphan"), ("nope", "")}


def test_columns_of_a_catalog_lake_are_audited(spark, two_databases):
    lake, _ = catalog.catalog_lake(spark, skip=catalog.SKIP_DATABASES)
    columns = catalog.lake_columns(spark, lake)
    assert ("shop", "items", "name", "string", 1) in {tuple(r) for r in columns.collect()}
    dirty = dirty_columns(columns)
    assert [tuple(r) for r in dirty.collect()] == [("shop", "items", "item id", " ")]
    save_dirty_columns(dirty, "shop.dirty")
    save_dirty_columns(dirty, "shop.dirty")
    assert spark.table("shop.dirty").count() == 1
    spark.sql("drop table shop.dirty")
