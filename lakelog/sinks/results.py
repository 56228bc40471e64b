"""Search results as files: one folder per search, rows partitioned by table, and a summary."""

from __future__ import annotations

import datetime as dt
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakelog.operators.search import FAILURES, TABLE_NO, Lake, Search, skipped_tables, table_columns, with_messages
from lakelog.schemas import SKIPPED_TABLES

_MATCHES = "row_json string, database string, table string"


def _write_table(name: tuple[str, str], df: DataFrame, search: Search, path: str) -> bool:
    """Write the matches of one table, read once; whether a cap cut them."""
    rows = search.matching(df)
    if rows is None:
        return False
    kept, cut = search.limited(rows, table_columns(name, rows))
    kept.write.mode("overwrite").partitionBy("database", "table").parquet(path)
    return cut


def write_search(
    spark: SparkSession, lake: Lake, search: Search, folder: str, run_ts: dt.datetime, jobs: int = 8
) -> str | None:
    """Search the lake and write ``matches``, ``summary`` and ``skipped`` to a new folder of its own.

    Every table is read and written by one job, ``jobs`` of them side by side. ``skipped`` lists tables no term can
    match and tables that could not be read. Returns the folder, or None if nothing matched and nothing failed.
    """
    dest = f"{folder.rstrip('/')}/search_{run_ts:%Y%m%d_%H%M%S}_{uuid.uuid4().hex[:8]}"

    def one(number: int, name: tuple[str, str]) -> tuple[bool, str | None]:
        try:
            return _write_table(name, lake[name], search, f"{dest}/matches/{TABLE_NO}={number}"), None
        except FAILURES as error:
            return False, str(error).splitlines()[0]

    with ThreadPoolExecutor(jobs) as pool:
        outcomes = list(pool.map(one, range(len(lake)), lake))
    broken = [(*name, error) for name, (_, error) in zip(lake, outcomes, strict=True) if error is not None]
    tried = enumerate(zip(lake.values(), outcomes, strict=True))
    fine = [number for number, (df, (_, error)) in tried if error is None and search.predicate(df) is not None]
    counts = {}
    if fine:
        paths = [f"{dest}/matches/{TABLE_NO}={number}" for number in fine]
        schema = f"{_MATCHES}, {TABLE_NO} int"
        stored = spark.read.schema(schema).option("basePath", f"{dest}/matches").parquet(*paths)
        counts = {r[TABLE_NO]: r["n"] for r in stored.groupBy(TABLE_NO).agg(F.count("*").alias("n")).collect()}
    if not counts and not broken:
        return None
    facts = [(number, n, n, outcomes[number][0], outcomes[number][0]) for number, n in counts.items()]
    counted = spark.createDataFrame(facts, f"{TABLE_NO} int, count long, kept long, truncated boolean, more boolean")
    with_messages(spark, lake, search, counted).coalesce(1).write.parquet(f"{dest}/summary")
    skipped = skipped_tables(spark, lake, search).unionByName(spark.createDataFrame(broken, SKIPPED_TABLES))
    skipped.coalesce(1).write.parquet(f"{dest}/skipped")
    return dest
