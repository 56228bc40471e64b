"""Whole-lake scans that are not searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakelog.operators.search import Lake, union_all


def table_counts(spark: SparkSession, lake: Lake) -> DataFrame:
    """Rows per readable table. Each table adds up on its own, so an empty table still has its row."""
    parts = [
        df.agg(F.count("*").alias("rows")).select(F.lit(db).alias("database"), F.lit(table).alias("table"), "rows")
        for (db, table), df in lake.items()
    ]
    return union_all(spark, parts, "database string, table string, rows long")
