"""Every registered query against its SQL, and the contract of the entry module."""

import pytest

import __spark_entry__ as driver
import oracle

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_query_gives_what_its_sql_gives(spark, con, name):
    columns, rows = oracle.spark_rows(driver.queries()[name](spark, FOLDER))
    assert (columns, rows) == oracle.sql_rows(con, driver.oracle_sql()[name])


def test_entry(spark):
    result = driver.entry(spark)
    assert result.columns == ["database", "table", "matched_columns", "count", "kept", "truncated", "message"]
    assert result.count() > 0


def test_known_numbers(spark):
    """Counts at a hundredth, from independent probes of the same tables."""
    folder = "/root/testdata/sf0.01"
    queries = driver.queries()
    status = {(r["status"]): r["count"] for r in queries["runlog_build"](spark, folder).groupBy("status").count().collect()}
    assert status == {"ok": 5394, "failed": 902, "timeout": 440, "skipped": 3264}
    counts = {"search_substring_ci": 248, "search_numeric": 1844, "search_date": 317, "search_and": 68, "window_closed": 2008,
              "runlog_first_failure": 657, "step_spans": 9907, "step_open": 98, "run_summary": 749}
    assert {name: queries[name](spark, folder).count() for name in counts} == counts
