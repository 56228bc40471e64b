"""The given tables as two databases of the session catalog: listing, search, counts and column audit through it.

The tables are registered where they lie, so nothing is copied. Two views turn values of given tables into column
names, some of which hold characters that a name may not hold.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakelog.operators.audit import dirty_columns, dirty_report
from lakelog.operators.scan import table_counts
from lakelog.operators.search import Search, search_lake, skipped_tables
from lakelog.plans.inputs import TABLES, given
from lakelog.plans.registry import query
from lakelog.plans.search_queries import row_key, sql_hits
from lakelog.sinks.storage import fresh_path
from lakelog.sinks.tables import save_dirty_columns
from lakelog.sources.catalog import catalog_lake, databases, lake_columns, quoted_name

TRADE, TEXTS, ABSENT = "lakelog_trade", "lakelog_texts", "lakelog_absent"
_TRADE_TABLES = TABLES[:7]
#: View, the table it counts, and the column whose values become column names.
_VIEWS = (("priorities", "orders", "o_orderpriority"), ("brands", "part", "p_brand"))


def _database_of(table: str) -> str:
    return TRADE if table in _TRADE_TABLES else TEXTS


def _register(spark: SparkSession, folder: str) -> None:
    """List the given tables, and the views over them, in the catalog. An earlier listing of another folder goes."""
    for database in (TRADE, TEXTS):
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{fresh_path(spark, database)}'")
    for view, _, _ in _VIEWS:
        spark.sql(f"DROP VIEW IF EXISTS {TRADE}.{view}")
    for table in TABLES:
        name = f"{_database_of(table)}.{table}"
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        path = f"{folder.rstrip('/')}/{table}.parquet"
        spark.catalog.createTable(name, path=path, source="parquet", schema=given(spark, folder, table).schema)
    for view, table, column in _VIEWS:
        values = given(spark, folder, table).select(column).distinct().where(F.col(column).isNotNull())
        counts = [
            "count_if({} = '{}') AS {}".format(column, v.replace("\\", "\\\\").replace("'", "\\'"), quoted_name(v))
            for v in sorted(row[0] for row in values.collect())
        ]
        counts = ", ".join(counts) or "count(*) AS none"
        spark.sql(f"CREATE VIEW {TRADE}.{view} AS SELECT {counts} FROM {TRADE}.{table}")


_DATABASE = f"case when \"table\" in ({', '.join(repr(t) for t in _TRADE_TABLES)}) then '{TRADE}' else '{TEXTS}' end"


@query(
    f"""select {_DATABASE} as database, "table", row_key, false as skipped from ({sql_hits(['ring'])})
    union all values ('{TEXTS}', 'embeddings', null, true), ('{TEXTS}', 'labels', null, true),
      ('{TRADE}', 'priorities', null, true), ('{TRADE}', 'brands', null, true), ('{ABSENT}', '', null, true)"""
)
def catalog_search(spark: SparkSession, folder: str) -> DataFrame:
    """Wanted databases, one of which the catalog lacks: the rows found, and what was skipped."""
    _register(spark, folder)
    lake, unread = catalog_lake(spark, include=[TRADE, TEXTS, ABSENT])
    search, name = Search(("ring",)), ["database", "table"]
    found = search_lake(spark, lake, search).select(*name, row_key("row_json").alias("row_key"), F.lit(False).alias("skipped"))
    skipped = skipped_tables(spark, lake, search).select(*name).unionByName(unread.select(*name))
    return found.unionByName(skipped.select(*name, F.lit(None).cast("long").alias("row_key"), F.lit(True).alias("skipped")))


_TRADE_COUNTS = " union all ".join(f"select '{t}' as \"table\", count(*) as rows from {t}" for t in _TRADE_TABLES)


@query(
    f"""select '{TRADE}' as database, * from ({_TRADE_COUNTS}
    union all values ('priorities', 1), ('brands', 1))"""
)
def catalog_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows per table and view, read through the catalog, of all databases but those to be skipped."""
    _register(spark, folder)
    listed, _ = databases(spark)
    lake, _ = catalog_lake(spark, skip=[name for name in listed if name != TRADE])
    return table_counts(spark, lake)


_VIEW_COLUMNS = " union all ".join(
    f"select distinct '{TRADE}', '{view}', {column} from {table} where {column} is not null" for view, table, column in _VIEWS
)
_NAMES = rf"""with l as (
    select {_DATABASE.replace('"table"', 'table_name')} as database, table_name as "table", column_name as "column"
    from information_schema.columns where table_name in ({", ".join(repr(t) for t in TABLES)})
    union all {_VIEW_COLUMNS}),
  d as (select *, array_to_string(list_sort(list_distinct(regexp_extract_all("column", '[^a-zA-Z0-9_\-]'))), '')
    as bad_chars from l)"""


def _dirty_names(spark: SparkSession, folder: str) -> DataFrame:
    _register(spark, folder)
    lake, _ = catalog_lake(spark, include=[TRADE, TEXTS])
    return dirty_columns(lake_columns(spark, lake))


@query(_NAMES + " select * from d where bad_chars <> ''")
def catalog_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Column names that block publishing, saved as the audit table and read back."""
    dirty = _dirty_names(spark, folder)
    database = f"lakelog_audit_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{fresh_path(spark, 'audit')}'")
    for _ in range(2):  # the second saving replaces the first
        save_dirty_columns(dirty, f"{database}.dirty_columns")
    return spark.table(f"{database}.dirty_columns")


@query(
    _NAMES
    + """ select count(*) as dirty_columns, count(distinct (database, "table")) as dirty_tables
    from d where bad_chars <> ''"""
)
def catalog_audit_report(spark: SparkSession, folder: str) -> DataFrame:
    return dirty_report(_dirty_names(spark, folder))
