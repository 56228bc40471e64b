"""Connected components of a table of links, by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lakelog.sinks.storage import checkpointed


def components(links: DataFrame) -> DataFrame:
    """``node, component``: for each node of ``links`` (columns ``a, b``) the smallest node it can reach.

    Each round hooks every node to the least of itself and its neighbours, follows these pointers to their ends, and
    goes on with the links between different ends. Hooks are a combined aggregate and pointers are joined, so a node
    with very many links is never one task's work. Every round is checkpointed; null nodes and self-links are dropped,
    repeated links count once, and no links give no rows.
    """
    links = links.select("a", "b").filter("a <> b")
    live = checkpointed(links.union(links.select("b", "a")).distinct())
    result = None
    while not live.isEmpty():
        hooks = live.groupBy("a").agg(F.least("a", F.min("b")).alias("p"))
        roots = _ends(hooks.select(F.col("a").alias("node"), "p"))
        if result is None:
            result = roots
        else:
            up = roots.select(F.col("node").alias("p"), F.col("p").alias("_up"))
            result = result.join(up, "p", "left").select("node", F.coalesce("_up", "p").alias("p"))
        ends = roots.select(F.col("node").alias("a"), F.col("p").alias("_a"))
        other = roots.select(F.col("node").alias("b"), F.col("p").alias("_b"))
        live = live.join(ends, "a").join(other, "b").filter("_a <> _b")
        live = checkpointed(live.select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct())
    if result is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return checkpointed(result.select("node", F.col("p").alias("component")))


def _ends(pointers: DataFrame) -> DataFrame:
    """``node, p`` with every pointer moved to the end of its chain, whose length halves in each step."""
    pointers = checkpointed(pointers)
    while True:
        up = pointers.select(F.col("node").alias("p"), F.col("p").alias("_up"))
        moved = checkpointed(pointers.join(up, "p").select("node", F.col("_up").alias("p"), (F.col("_up") != F.col("p")).alias("_moved")))
        done = moved.filter("_moved").isEmpty()
        pointers = moved.drop("_moved")
        if done:
            return pointers
