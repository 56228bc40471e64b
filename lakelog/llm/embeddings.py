"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation of the principal axes is learned so that the signs of the rotated coordinates are balanced bits that change
little between close vectors (ITQ). The bits of one or more such rotations are cut into ``TABLES`` substrings, each the
key of a table. A vector asks every table for its own substring and for those one bit off; what it meets there is
sifted by the Hamming distance of the whole codes inside the join and then compared by the cosine of the vectors.

A substring has about log2(rows) bits, so the vectors of a table entry do not grow with the table. The rotations are
fitted on a bounded sample (``SAMPLE``), which is all that reaches the driver; every vector is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import acos, ceil, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lakelog.llm.components import components
from lakelog.llm.rows import written

COSINE = 0.95
TABLES = 8
SAMPLE = 20_000
ROUNDS = 40
#: Standard deviations that the Hamming distance of a pair at the threshold may lie above its mean.
SLACK = 3.5

SCHEMA = "vec_id long, n_links long, component_id long, kept boolean"


def learn_rotation(vectors: np.ndarray, seed: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (dimension x bits) of ITQ: principal axes, then alternate between signs and the rotation
    that brings the coordinates closest to them."""
    mean = vectors.mean(0)
    centred = vectors - mean
    values, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, np.argsort(-values)][:, :64]
    flat = centred @ axes
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(axes.shape[1],) * 2))[0]
    for _ in range(rounds):
        signs = np.where(flat @ rotation >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(flat.T @ signs)
        rotation = left @ right
    return mean, axes @ rotation


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def substrings(vectors: np.ndarray, model: list[tuple[np.ndarray, np.ndarray]], width: int) -> np.ndarray:
    """``[row, table]``: the code of each unit vector in ``TABLES`` numbers of ``width`` bits."""
    bits = np.concatenate([(vectors - mean) @ axes >= 0 for mean, axes in model], axis=1)[:, : TABLES * width]
    weights = (1 << np.arange(width, dtype=np.int64))[None, None, :]
    return (bits.reshape(len(vectors), TABLES, width) * weights).sum(2)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _pairs(classes: DataFrame, size: int, cosine: float) -> DataFrame:
    """``a, b, size_a, size_b`` of classes (vectors of one length) that reach the cosine, each pair once."""
    sample = classes.select("embedding").orderBy(F.xxhash64("node"), "node").limit(SAMPLE).toPandas()["embedding"]
    vectors = unit(np.stack(sample.to_numpy()).astype(np.float64))
    width = min(30, max(8, ceil(log2(classes.count() + 1))))
    model = [learn_rotation(vectors, seed) for seed in range(ceil(TABLES * width / min(64, size)))]
    angle = acos(cosine) / pi
    most = int(TABLES * width * angle + SLACK * sqrt(TABLES * width * angle * (1 - angle))) + 1
    names = ["key", "node", *(f"c{i}" for i in range(TABLES // 2))]
    schema = ", ".join(f"{n} long" for n in names)

    def keys(probe: bool):
        around = np.r_[0, 1 << np.arange(width)] if probe else np.zeros(1, np.int64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, 1024):
                    part = batch.slice(i, 1024)
                    node = part.column(0).to_numpy(zero_copy_only=False)
                    codes = substrings(unit(_matrix(part.column(1), size)), model, width)
                    asked = codes[:, :, None] ^ around[None, None, :] | (np.arange(TABLES) << 32)[None, :, None]
                    each = TABLES * len(around)
                    packed = codes[:, ::2] | codes[:, 1::2] << 32
                    columns = [asked.ravel(), np.repeat(node, each), *(np.repeat(p, each) for p in packed.T)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

        return classes.select("node", "embedding").mapInArrow(run, schema)

    def differing(i: int) -> Column:
        return F.col(f"x.c{i}").bitwiseXOR(F.col(f"y.c{i}"))

    # A pair can meet in several tables; only the first of these counts it.
    first = F.lit(TABLES)
    for t in range(TABLES - 1, -1, -1):
        half = F.shiftrightunsigned(differing(t // 2), 32) if t % 2 else differing(t // 2).bitwiseAND(F.lit(0xFFFFFFFF))
        first = F.when(F.bit_count(half) <= 1, t).otherwise(first)
    distance = reduce(lambda a, b: a + b, [F.bit_count(differing(i)) for i in range(TABLES // 2)])
    met = keys(True).alias("x").join(
        keys(False).alias("y"),
        (F.col("x.key") == F.col("y.key"))
        & (F.col("x.node") < F.col("y.node"))
        & (distance <= most)
        & (first == F.shiftright("x.key", 32)),
    )
    vector = classes.select("node", "embedding", "size")
    a = vector.toDF("a", "embedding_a", "size_a")
    b = vector.toDF("b", "embedding_b", "size_b")
    both = met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).join(a, "a").join(b, "b")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _matrix(batch.column(4), size), _matrix(batch.column(5), size)
            dots = np.einsum("ij,ij->i", x, y)
            close = dots >= cosine * np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)
            yield pa.RecordBatch.from_arrays(batch.columns[:4], names=batch.schema.names[:4]).filter(pa.array(close))

    columns = ["a", "b", "size_a", "size_b", "embedding_a", "embedding_b"]
    return both.select(*columns).mapInArrow(rerank, "a long, b long, size_a long, size_b long")


def near_duplicates(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Link vectors whose cosine reaches ``cosine`` and group them by links.

    Needs ``vec_id`` and ``embedding``; other columns are ignored. Returns a row for each row: ``n_links`` other rows
    linked directly, ``component_id`` the smallest ``vec_id`` reachable, ``kept`` if that is its own. Vectors that are
    null, empty, zero or hold null or non-finite components, and rows without ``vec_id``, link with nothing (their
    component is their own id). Only vectors of equal length are compared. Equal vectors are one class from the start:
    they count as links of each other and are never paired. No rows give no rows. Runs jobs.
    """
    vector = rows["embedding"].cast("array<double>")
    numbers = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = rows["vec_id"].isNotNull() & F.coalesce(numbers & F.exists(vector, lambda x: x != 0), F.lit(False))
    rows = rows.select(rows["vec_id"].cast("long"), rows["embedding"], usable.alias("usable"))
    valid = rows.filter("usable")
    classes = written(
        valid.groupBy("embedding")
        .agg(F.min("vec_id").alias("least"), F.count("*").alias("size"))
        .withColumn("node", F.monotonically_increasing_id()),
        "vectors",
    )
    sizes = [r[0] for r in classes.select(F.size("embedding")).distinct().orderBy(F.size("embedding")).collect()]
    pairs = [_pairs(classes.filter(F.size("embedding") == s), s, cosine) for s in sizes]
    alone = rows.filter("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if not pairs:
        return _with_kept(alone)
    links = written(reduce(DataFrame.union, pairs), "links")
    counted = links.selectExpr("a as node", "size_b as n").union(links.selectExpr("b as node", "size_a as n"))
    counted = counted.groupBy("node").agg(F.sum("n").alias("others"))
    grouped = components(links)
    least = grouped.join(classes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("first"))
    facts = (
        classes.join(counted, "node", "left")
        .join(grouped.join(least, "component").select("node", "first"), "node", "left")
        .select(
            "embedding",
            (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
            F.coalesce("first", "least").alias("component_id"),
        )
    )
    return _with_kept(valid.join(facts, "embedding").select("vec_id", "n_links", "component_id").union(alone))


def _with_kept(rows: DataFrame) -> DataFrame:
    return rows.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
