"""A folder of Parquet tables as a lake."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def parquet_table(spark: SparkSession, folder: str, table: str, schema: StructType | None = None) -> DataFrame:
    """One table; without a schema Spark starts a job to read a footer."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def parquet_lake(
    spark: SparkSession, folder: str, tables: Iterable[str], database: str = "lake"
) -> dict[tuple[str, str], DataFrame]:
    return {(database, table): parquet_table(spark, folder, table) for table in tables}
