"""The lake as the catalog lists it.

Listing is a conversation between the driver and the metastore about names and schemas; no table data is read. Most of
it is waiting, so ``jobs`` databases or tables are asked for at a time; results keep the order of the names.
"""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from lakelog.schemas import LAKE_COLUMNS, SKIPPED_TABLES

# Databases an audit leaves out unless told otherwise.
SKIP_DATABASES = ("default", "information_schema")

# Fixed value: how many questions to the metastore run side by side.
JOBS = 16

Name = tuple[str, str]


def quoted_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def databases(
    spark: SparkSession, include: Iterable[str] = (), skip: Iterable[str] = ()
) -> tuple[list[str], list[str]]:
    """Databases in catalog order, and the wanted names the catalog lacks. An empty include list means all."""
    listed = [row[0] for row in spark.sql("SHOW DATABASES").collect()]
    wanted, unwanted = list(include), set(skip)
    kept = [name for name in listed if (not wanted or name in wanted) and name not in unwanted]
    return kept, [name for name in wanted if name not in listed]


def table_names(
    spark: SparkSession, names: Iterable[str], jobs: int = JOBS
) -> tuple[list[Name], list[tuple[str, str, str]]]:
    """``(database, table)`` pairs, and ``(database, "", reason)`` for databases that cannot be listed.

    Temporary views show up in every database's listing and belong to none; they are left out.
    """

    def listed(database: str) -> tuple[list[Name], list[tuple[str, str, str]]]:
        try:
            rows = spark.sql(f"SHOW TABLES IN {quoted_name(database)}").where("NOT isTemporary").collect()
        except PySparkException as error:
            return [], [(database, "", str(error).splitlines()[0])]
        return [(database, row["tableName"]) for row in rows], []

    with ThreadPoolExecutor(jobs) as pool:
        found = list(pool.map(listed, names))
    return [pair for pairs, _ in found for pair in pairs], [f for _, failed in found for f in failed]


def read_lake(
    spark: SparkSession, pairs: Iterable[Name], jobs: int = JOBS
) -> tuple[dict[Name, DataFrame], DataFrame]:
    """Tables and views through the catalog, schema from the metastore, and a DataFrame of those that fail."""

    def resolved(name: Name) -> DataFrame | str:
        try:
            df = spark.table(f"{quoted_name(name[0])}.{quoted_name(name[1])}")
            df.schema  # resolves a view over something that is gone
            return df
        except PySparkException as error:
            return str(error).splitlines()[0]

    pairs = list(pairs)
    with ThreadPoolExecutor(jobs) as pool:
        found = dict(zip(pairs, pool.map(resolved, pairs), strict=True))
    lake = {name: df for name, df in found.items() if isinstance(df, DataFrame)}
    failed = [(*name, reason) for name, reason in found.items() if not isinstance(reason, DataFrame)]
    return lake, spark.createDataFrame(failed, SKIPPED_TABLES)


def catalog_lake(
    spark: SparkSession, include: Iterable[str] = (), skip: Iterable[str] = ()
) -> tuple[dict[Name, DataFrame], DataFrame]:
    """Every readable table of the wanted databases, and what had to be skipped with the reason."""
    names, missing = databases(spark, include, skip)
    pairs, unlisted = table_names(spark, names)
    lake, unread = read_lake(spark, pairs)
    notes = [(name, "", "no such database") for name in missing] + unlisted
    return lake, unread.unionByName(spark.createDataFrame(notes, SKIPPED_TABLES))


def lake_columns(spark: SparkSession, lake: dict[Name, DataFrame]) -> DataFrame:
    """``(database, table, column, data_type, ordinal)`` of every top-level column."""
    rows = [
        (database, table, field.name, field.dataType.simpleString(), ordinal)
        for (database, table), df in lake.items()
        for ordinal, field in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(rows, LAKE_COLUMNS)
