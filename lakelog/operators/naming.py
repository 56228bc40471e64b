"""Safe, unique output names for tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lakelog.operators.slices import SLICE_BITS, with_position, with_running_max
from lakelog.sinks.storage import checkpointed

# Characters a sheet name may not hold, its length, its fallback and the names taken beforehand.
FORBIDDEN = "[]:*?/\\"
MAX_LENGTH = 31
FALLBACK = "sheet"
RESERVED = ("summary",)

_LOOKAHEAD = 64


def cleaned_name(name: Column) -> Column:
    """Forbidden characters replaced, cut to the length limit, never empty."""
    cut = F.substring(F.translate(name, FORBIDDEN, "_" * len(FORBIDDEN)), 1, MAX_LENGTH)
    return F.when(cut == "", F.lit(FALLBACK)).otherwise(cut)


def _choice(cleaned: Column, place: Column) -> Column:
    """The name a table asks for at a place in its list: itself, then ``_1``, ``_2`` ... inside the limit."""
    tail = F.concat(F.lit("_"), place.cast("string"))
    shortened = F.substring(cleaned, F.lit(1), F.lit(MAX_LENGTH) - F.length(tail))
    return F.when(place == 0, cleaned).otherwise(F.concat(shortened, tail))


def _spread_out(placed: DataFrame, bits: int) -> DataFrame:
    """Push names that share a list apart, in order, by no more than the list demands.

    Suffixes of one length cut the name to one length, so all names with that beginning share those choices. Of two
    such names the later one always ends behind the earlier: its place is at least one more.
    """
    digits = F.length(F.col("place").cast("string"))
    shared = F.concat_ws("/", digits, F.substring(F.col("cleaned"), F.lit(1), F.lit(MAX_LENGTH - 1) - digits))
    keys, at = ["list"], F.col("ordinal")
    listed = placed.where(F.col("place") > 0).withColumn("list", shared)
    ranked = checkpointed(with_position(listed, keys, ["ordinal"], at, "rank", bits))
    gaps = ranked.withColumn("gap", F.col("place") - F.col("rank"))
    pushed = with_running_max(gaps, keys, ["ordinal"], "gap", at, "push", bits)
    moved = pushed.select("ordinal", "name", "cleaned", (F.col("rank") + F.col("push")).alias("place"))
    return placed.where(F.col("place") == 0).select("ordinal", "name", "cleaned", "place").unionByName(moved)


def safe_names(names: DataFrame, bits: int = SLICE_BITS) -> DataFrame:
    """``(ordinal, name)`` to ``(ordinal, name, safe_name)``: what serving the names in order would give.

    ``ordinal`` is unique and not negative. A name's position among equal cleaned names is where its search can start.
    From there rounds settle the rest: names sharing a list are pushed apart, each choice goes to the lowest ordinal
    that asks for it, and the others move on to their next choice not held by a lower ordinal. A choice only ever
    passes to a lower ordinal, so nobody skips a choice still open to them, and the rounds end with the names that
    serving in order gives. Runs a few jobs per round; names without clashes need one round.
    """
    cleaned = names.select("ordinal", "name", cleaned_name(F.col("name")).alias("cleaned"))
    spark = names.sparkSession
    taken = spark.createDataFrame([(-1 - i, None, r) for i, r in enumerate(RESERVED)], cleaned.schema)
    placed = with_position(cleaned.unionByName(taken), ["cleaned"], ["ordinal"], F.col("ordinal"), "place", bits)
    while True:
        asked = _spread_out(checkpointed(placed), bits).withColumn("safe_name", _choice(F.col("cleaned"), F.col("place")))
        placed = checkpointed(asked)
        held = placed.groupBy("safe_name").agg(F.min("ordinal").alias("holder"), F.count("*").alias("n"))
        losers = checkpointed(
            placed.join(held.where(F.col("n") > 1), "safe_name")
            .where(F.col("ordinal") != F.col("holder"))
            .select("ordinal", "name", "cleaned", "place")
        )
        if losers.isEmpty():
            return placed.where(F.col("ordinal") >= 0).select("ordinal", "name", "safe_name")
        following = losers.withColumn(
            "next", F.explode(F.sequence(F.col("place") + 1, F.col("place") + _LOOKAHEAD))
        ).withColumn("safe_name", _choice(F.col("cleaned"), F.col("next")))
        open_to_them = F.coalesce(F.col("holder") > F.col("ordinal"), F.lit(True))
        moved = (
            following.join(held, "safe_name", "left")
            .groupBy("ordinal", "name", "cleaned", "place")
            .agg(F.min(F.when(open_to_them, F.col("next"))).alias("next"))
            .select("ordinal", "name", "cleaned", F.coalesce("next", F.col("place") + _LOOKAHEAD + 1).alias("place"))
        )
        settled = placed.drop("safe_name").join(losers.select("ordinal"), "ordinal", "left_anti")
        placed = settled.unionByName(moved)
