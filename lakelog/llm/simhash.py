"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints within ``distance`` bits of each other are found exactly. The 64 bits are grouped into partitions, bits
that go together in one partition, so that the partitions tell different things. If thresholds ``t`` of the partitions
add up to ``distance + 1 - partitions`` (-1: not probed), two fingerprints that are close agree up to ``t`` bits in at
least one partition. Each fingerprint gets the thresholds that cost it least, by dynamic programming over probes and
estimated candidates: where many others share its bits it probes little, and elsewhere more. It probes the index of
partition values with all values in the chosen balls; what it meets is verified on all 64 bits in the join itself.

What is collected does not grow with the data: one 64 x 64 matrix and one histogram of ``2 ** PROJECTED`` cells for
each partition, both summed over all distinct fingerprints.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lakelog.llm.components import components
from lakelog.llm.rows import map_texts, texts_of
from lakelog.sinks.storage import checkpointed

SHINGLE = 3
DISTANCE = 3
PARTITIONS = 3
#: Low bits of a partition's value that the histograms tell apart.
PROJECTED = 14
#: What a probe costs, in candidates.
PROBE_COST = 2.0
#: Shingles whose bits are counted at once.
_COUNTED = 1 << 16


# ------------------------------------------------------------------ fingerprints


def word_spans(text: str) -> tuple[bytes, list[int], list[int]]:
    """The words of a text (A-Z lower-cased, ASCII white space apart) joined by spaces, with their starts and ends."""
    words = text.encode().lower().split()
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    return b" ".join(words), (ends - lengths).tolist(), ends.tolist()


def shingle_hashes(text: str, size: int, seed: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words, or of all words if there are fewer; empty without words."""
    from xxhash import xxh64_intdigest

    joined, starts, ends = word_spans(text)
    if not starts:
        return np.empty(0, np.uint64)
    ends = ends[size - 1 :] or ends[-1:]
    return np.array([xxh64_intdigest(joined[s:e], seed) for s, e in zip(starts, ends)], np.uint64)  # noqa: B905


def simhash(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; no hashes give 0. Signed, as Spark's long."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _COUNTED):
        part = hashes[i : i + _COUNTED].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = 42) -> DataFrame:
    """``doc_id, text_hash, fp``: the fingerprint of every whole text, and a hash that tells rows of one id apart."""

    def make():
        def run(part: pa.RecordBatch) -> dict:
            return {
                "doc_id": part.column("doc_id"),
                "text_hash": part.column("text_hash"),
                "fp": [simhash(shingle_hashes(t, shingle, seed)) for t in texts_of(part)],
            }

        return run

    rows = docs.select(docs["doc_id"].cast("long"), F.xxhash64(docs["text"]).alias("text_hash"), docs["text"])
    return map_texts(rows, "text", make, "doc_id long, text_hash long, fp long")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# ------------------------------------------------------------------ partitions and thresholds


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _summed(fps: DataFrame, cells: int, count: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """A vector of ``cells`` sums over all fingerprints; only these sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in batches:
            total += count(batch.column(0).to_numpy(zero_copy_only=False))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["cell", "n"])

    sums = fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(cells, np.int64)
    for row in sums.collect():
        out[row["cell"]] = row["n"]
    return out


def group_bits(together: np.ndarray, n: int, partitions: int) -> list[list[int]]:
    """Bits dealt to ``partitions`` of nearly equal width, correlated bits together.

    ``together[i, j]`` counts the fingerprints with both bits set. A partition begins with the bit that is most
    correlated with those left and takes the bit closest to its members until it is full.
    """
    share = together / max(n, 1)
    one = np.diag(share)
    spread = np.sqrt(np.maximum(one * (1 - one), 1e-12))
    correlation = np.abs((share - np.outer(one, one)) / np.outer(spread, spread))
    left, groups = list(range(64)), []
    for p in range(partitions):
        width = 64 // partitions + (p < 64 % partitions)
        first = max(left, key=lambda i: (correlation[i, left].sum(), -i))
        group = [first]
        left.remove(first)
        while len(group) < width:
            nearest = max(left, key=lambda i: (correlation[i, group].sum(), -i))
            group.append(nearest)
            left.remove(nearest)
        groups.append(sorted(group))
    return groups


def values_of(fps: np.ndarray, group: list[int]) -> np.ndarray:
    """The bits of a group as one number, its first bit lowest."""
    fps, out = fps.astype(np.int64).view(np.uint64), np.zeros(len(fps), np.int64)
    for at, bit in enumerate(group):
        out |= ((fps >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << at
    return out


def masks(width: int, radius: int) -> np.ndarray:
    """Numbers of ``width`` bits with exactly ``radius`` set."""
    return np.array([sum(1 << b for b in bits) for bits in combinations(range(width), radius)], np.int64)


def ball_costs(histogram: np.ndarray, n: int, width: int, distance: int) -> np.ndarray:
    """``[threshold + 1, projected value]``: probes and estimated candidates of a ball around a value.

    Others in the same ball of the projection beyond what chance puts there share the whole partition; chance ones are
    thinned out by the bits the projection leaves out.
    """
    projected = int(np.log2(len(histogram)))
    cells = np.arange(len(histogram))
    costs, near, ball = [np.zeros(len(histogram))], np.zeros(len(histogram)), 0
    for t in range(distance + 1):
        for mask in masks(projected, t).tolist():
            near += histogram[cells ^ mask]
        chance = n * sum(comb(projected, d) for d in range(t + 1)) / len(histogram)
        ball += comb(width, t)
        costs.append(PROBE_COST * ball + np.maximum(0, near - chance) + n * ball / 2.0**width)
    return np.array(costs)


def allocate(costs: list[np.ndarray], budget: int) -> np.ndarray:
    """Per row, the threshold of each partition so that the cost is least and ``t + 1`` adds up to ``budget``.

    ``costs[p][row, t + 1]``. Dynamic programming over partitions and budget spent, for all rows at once.
    """
    rows = len(costs[0])
    best = np.full((rows, budget + 1), np.inf)
    best[:, 0] = 0
    picks = []
    for cost in costs:
        options = np.full((rows, budget + 1, budget + 1), np.inf)  # row, spent so far, spent here
        for spent in range(budget + 1):
            options[:, spent:, spent] = best[:, : budget + 1 - spent] + cost[:, spent : spent + 1]
        picks.append(options.argmin(2))
        best = options.min(2)
    out, spent = np.empty((rows, len(costs)), np.int64), np.full(rows, budget)
    for p in range(len(costs) - 1, -1, -1):
        here = picks[p][np.arange(rows), spent]
        out[:, p], spent = here - 1, spent - here
    return out


# ------------------------------------------------------------------ links and groups


def near_pairs(fps: DataFrame, distance: int = DISTANCE, partitions: int = PARTITIONS) -> DataFrame:
    """``a, b``: the pairs of different ``fp`` values within ``distance`` bits, some of them more than once.

    ``fps`` has distinct ``fp`` (long) and is read several times. Runs two small jobs for the sums.
    """
    n = fps.count()
    projected = PROJECTED

    def pairs_of_bits(values: np.ndarray) -> np.ndarray:
        bits = _bits(values).astype(np.float32)
        return (bits.T @ bits).astype(np.int64).ravel()

    groups = group_bits(_summed(fps, 64 * 64, pairs_of_bits).reshape(64, 64), n, partitions)
    size = 1 << projected

    def projections(values: np.ndarray) -> np.ndarray:
        parts = [np.bincount(values_of(values, g) & (size - 1), minlength=size) for g in groups]
        return np.concatenate(parts)

    histograms = _summed(fps, partitions * size, projections).reshape(partitions, size)
    costs = [ball_costs(h, n, len(g), distance).astype(np.float32) for h, g in zip(histograms, groups, strict=True)]
    shells = [[masks(len(g), t) for t in range(distance + 1)] for g in groups]
    schema = "key long, fp long"

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            keys = [values_of(fp, g) | p << 40 for p, g in enumerate(groups)]
            columns = [pa.array(np.concatenate(keys)), pa.array(np.tile(fp, len(groups)))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "fp"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            values = [values_of(fp, g) for g in groups]
            chosen = allocate([c[:, v & (size - 1)].T for c, v in zip(costs, values, strict=True)], distance + 1)
            for p, value in enumerate(values):
                for t in range(distance + 1):
                    asked = chosen[:, p] >= t
                    if asked.any():
                        around = value[asked][:, None] ^ shells[p][t][None, :]
                        columns = [
                            pa.array(around.ravel() | p << 40),
                            pa.array(np.repeat(fp[asked], around.shape[1])),
                        ]
                        yield pa.RecordBatch.from_arrays(columns, names=["key", "fp"])

    left = fps.select("fp").mapInArrow(probe, schema).select("key", F.col("fp").alias("a"))
    right = fps.select("fp").mapInArrow(index, schema).select("key", F.col("fp").alias("b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    return left.join(right, "key").filter((F.col("a") < F.col("b")) & close).select("a", "b")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """Group documents whose fingerprints are linked, directly or through others.

    Needs ``doc_id`` and ``text``; other columns are ignored. Returns ``doc_id, text_hash, fp, component_key,
    component_id``: ``component_id`` is the smallest ``doc_id`` of the group (null if all its ids are null),
    ``component_key`` the smallest fingerprint, which tells groups apart also then. Null and empty texts have
    fingerprint 0 and are linked like any other; repeated rows are kept, a row each; no rows give no rows.
    Equal fingerprints are one class from the start, so copies are never paired. Runs jobs (checkpoints).
    """
    prints = checkpointed(fingerprints(docs, shingle))
    classes = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = components(near_pairs(classes, distance))
    labelled = classes.join(linked.withColumnRenamed("node", "fp"), "fp")
    least = labelled.groupBy("component").agg(F.min("least").alias("_least"))
    groups = linked.join(least, "component").select(F.col("node").alias("fp"), "component", "_least")
    found = classes.join(groups, "fp", "left").select(
        "fp",
        F.coalesce("component", "fp").alias("component_key"),
        F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("_least")).alias("component_id"),
    )
    return prints.join(found, "fp").select("doc_id", "text_hash", "fp", "component_key", "component_id")


def one_of_each(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: that with the smallest id, nulls first if alone."""
    return least_of_each(docs, near_duplicates(docs, distance, shingle))


def least_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """``docs`` with the row of each group whose id is the group's ``component_id``.

    Of rows that are equal in id and text, one stays, whatever their other columns hold.
    """
    kept = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).dropDuplicates(["component_key"])
    kept = kept.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    name = "_text"
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    rows = docs.withColumn(name, F.xxhash64("text"))
    same = rows["doc_id"].cast("long").eqNullSafe(kept["_id"]) & (rows[name] == kept["_hash"])
    return rows.join(kept, same, "left_semi").dropDuplicates(["doc_id", name]).drop(name)
