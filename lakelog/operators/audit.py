"""Audit of column names that hold characters a publishable name may not hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lakelog.functions.text import BAD_CHARACTER, bad_characters


def dirty_columns(columns: DataFrame, pattern: str = BAD_CHARACTER) -> DataFrame:
    """Names with at least one bad character, from a ``(database, table, column, ...)`` listing.

    The test stops at the first bad character; a filter on the collected characters would collect them twice.
    """
    dirty = columns.where(F.col("column").rlike(pattern))
    return dirty.select("database", "table", "column", bad_characters(F.col("column"), pattern).alias("bad_chars"))


def dirty_report(dirty: DataFrame) -> DataFrame:
    """How many dirty columns in how many tables, as one row."""
    return dirty.agg(
        F.count("*").alias("dirty_columns"), F.count_distinct("database", "table").alias("dirty_tables")
    )
