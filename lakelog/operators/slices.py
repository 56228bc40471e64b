"""Ordered work inside groups of any size.

A window over a group puts the whole group into one task. When one group holds a third of a hundred terabytes that
task never ends, so every group is cut into slices along its order, whatever its size, the window runs per slice, and
one small row per slice carries the result across the borders. Slices are cut by a whole number ``at`` that grows with
the order (microseconds, an ordinal): 2**bits of its values make a slice, 2**bits slices a block. A window therefore
sees at most 2**bits values of ``at``, slices or blocks at a time, and the plan is the same for all data.

Keys are compared as one struct, in which nulls equal each other, so null keys form a group like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lakelog.schemas import RUN_KEY

SLICE_BITS = 16
TIME_BITS = 20  # of microseconds: slices of a second, blocks of twelve days
_SLICE, _BLOCK, _KEY, _AT = "_slice", "_block", "_key", "_at"


def _sliced(df: DataFrame, keys: Sequence[str], at: Column, bits: int) -> DataFrame:
    return df.withColumns({_KEY: F.struct(*keys), _SLICE: F.shiftright(at.cast("long"), bits)})


def _carried(
    rows: DataFrame,
    total: Column,
    merge: Callable[[str], Column],
    combine: Callable[[Column, Column], Column],
    bits: int,
) -> DataFrame:
    """Per (key, slice): what all earlier slices of the group add up to, as ``_before``; null where there is nothing."""
    cells = rows.groupBy(_KEY, _SLICE).agg(total.alias("_t")).withColumn(_BLOCK, F.shiftright(_SLICE, bits))

    def earlier(order: str, *group: str) -> Window:
        return Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    blocks = cells.groupBy(_KEY, _BLOCK).agg(merge("_t").alias("_t"))
    blocks = blocks.select(_KEY, _BLOCK, merge("_t").over(earlier(_BLOCK, _KEY)).alias("_outer"))
    inner = cells.withColumn("_inner", merge("_t").over(earlier(_SLICE, _KEY, _BLOCK)))
    return inner.join(blocks, [_KEY, _BLOCK]).select(
        _KEY, _SLICE, combine(F.col("_inner"), F.col("_outer")).alias("_before")
    )


def with_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], at: Column, out: str, bits: int = SLICE_BITS
) -> DataFrame:
    """Number the rows of each group from 0 in the given order, exactly.

    ``at`` must not decrease along the order. Both the window and the join need the rows hashed by (key, slice), so
    one shuffle serves them; the counts of slices combine before theirs.
    """
    rows = _sliced(df, keys, at, bits)
    before = _carried(
        rows, F.count("*"), F.sum, lambda inner, outer: F.coalesce(inner, F.lit(0)) + F.coalesce(outer, F.lit(0)), bits
    )
    inside = F.row_number().over(Window.partitionBy(_KEY, _SLICE).orderBy(*order)) - 1
    numbered = rows.withColumn(out, inside.cast("long")).join(before, [_KEY, _SLICE], "left")
    return numbered.withColumn(out, F.col(out) + F.col("_before")).drop(_KEY, _SLICE, "_before")


def with_next(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, at: Column, out: str, bits: int = SLICE_BITS
) -> DataFrame:
    """The value of the row that follows in the group's order; null for the last row. Values must not be null.

    The rows are shuffled once, to their slices, where all but the last of a slice find their follower. What goes on to
    the blocks, and from there to the whole groups, is the first and the last row of each slice and block. Both parts
    of a step read the same shuffle, as both need all columns of their rows.
    """
    at_slice = F.shiftright(_AT, bits)
    groups = [[_KEY, at_slice], [_KEY, F.shiftright(at_slice, bits)], [_KEY]]
    none = F.lit(None).cast(df.schema[value].dataType)
    rows = df.withColumns({_KEY: F.struct(*keys), _AT: at.cast("long"), out: none, "_open": F.lit(True)})
    found = []
    for group in groups:
        window = Window.partitionBy(*group).orderBy(_AT, *order)
        rows = rows.withColumns(
            {out: F.coalesce(out, F.lead(value).over(window)), "_first": F.row_number().over(window) == 1}
        )
        last = group == groups[-1]
        found.append(rows.where(F.col("_open") if last else F.col("_open") & F.col(out).isNotNull()))
        rows = rows.where(F.col(out).isNull() | F.col("_first"))
        rows = rows.withColumn("_open", F.col("_open") & F.col(out).isNull()).drop("_first")
    found = [part.drop(_KEY, _AT, "_open", "_first") for part in found]
    return found[0].unionByName(found[1]).unionByName(found[2])


def with_running_max(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, at: Column, out: str, bits: int = SLICE_BITS
) -> DataFrame:
    """The largest value from the start of the group to the row itself, in the group's order."""
    rows = _sliced(df, keys, at, bits)
    before = _carried(rows, F.max(value), F.max, F.greatest, bits)
    inside = F.max(value).over(Window.partitionBy(_KEY, _SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    joined = rows.withColumn(out, inside).join(before, [_KEY, _SLICE], "left")
    return joined.withColumn(out, F.greatest(out, "_before")).drop(_KEY, _SLICE, "_before")


def child_slice(child_index: Column, bits: int) -> Column:
    """The slice of a child inside its run: 2**bits neighbours share one."""
    return F.shiftright(child_index, bits)


def spread_over_children(facts: DataFrame, first: Column, last: Column, bits: int, children: DataFrame) -> DataFrame:
    """Copy a per-run row to each slice between two children of its run that holds children (one unless the run is huge).

    The slices are those the children are in, not all numbers between the first and the last, so indices may be as far
    apart as they like. Each task sends a (run, slice) once.
    """
    held = children.select(RUN_KEY, child_slice(F.col("child_index"), bits).alias(_SLICE)).distinct()
    between = F.col(_SLICE).between(child_slice(first, bits), child_slice(last, bits))
    return held.join(facts, RUN_KEY).where(between)


def join_run_slices(children: DataFrame, spread: DataFrame, how: str, bits: int) -> DataFrame:
    """Join children to spread per-run rows on (run, slice), so no task gets more than 2**bits children per key."""
    sliced = children.withColumn(_SLICE, child_slice(F.col("child_index"), bits))
    return sliced.join(spread, [RUN_KEY, _SLICE], how).drop(_SLICE)
