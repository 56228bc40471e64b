"""The first rows of a result, without bringing its rows together in one task.

Every task keeps its own first ``cap + 1`` rows, numbers them, and writes them. How many rows each task kept, one number
a task, says in which task the cap falls and after which of its rows; a filter on the numbers does the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lakelog.sinks.storage import fresh_path

# The upper bits of monotonically_increasing_id are the task's, the lower ones count its rows.
_BITS = 33
_ROWS = (1 << _BITS) - 1
_NUMBER = "row_no"


def capped(
    rows: DataFrame, cap: int, order_by: Sequence[Column] = (), columns: Sequence[Column] = ()
) -> tuple[DataFrame, bool]:
    """At most ``cap`` of the rows, and whether there are more. Runs jobs that read the rows once.

    With ``order_by`` they are the first rows of that order, which is sorted by ranges; without it, which rows are kept
    is arbitrary. ``columns`` are the columns to keep, all of them if none are named. What is stored, in the shared
    folder, is never more than ``cap + 1`` rows a task.
    """
    spark = rows.sparkSession
    ordered = rows.orderBy(*order_by) if order_by else rows
    kept = F.struct(*(columns or [F.col("*")])).alias("row")
    numbered = ordered.select(kept, F.monotonically_increasing_id().alias(_NUMBER))
    path = fresh_path(spark, "capped")
    numbered.where(F.col(_NUMBER).bitwiseAND(F.lit(_ROWS)) <= cap).write.parquet(path)
    stored = spark.read.schema(numbered.schema).parquet(path)
    per_task = stored.groupBy(F.shiftright(_NUMBER, _BITS).alias("task")).agg(F.count("*").alias("n"))
    end, left = 0, cap
    counts = sorted((r["task"], r["n"]) for r in per_task.collect())  # a row a task
    for task, n in counts:
        if left <= 0:
            break
        end = (task << _BITS) + min(n, left)
        left -= n
    within = stored.where(F.col(_NUMBER) < end).select("row.*")
    return within, sum(n for _, n in counts) > cap
