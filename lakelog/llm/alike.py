"""Near-duplicate texts by the exact Jaccard similarity of their sets of word shingles.

Candidates come from MinHash bands: a set's ``ROWS * BANDS`` one-permutation bins are cut into bands of ``ROWS``, and two
sets meet if a band agrees. At similarity s they miss each other with probability ``(1 - s ** ROWS) ** BANDS``, 5 in
100,000 at 0.8, whatever the size of the table, and sets that share only a passage hardly ever meet. Every candidate
pair is then compared by all its shingles, so no wrong link is made.

Large groups are not paired: in the first ``STARS`` rounds each band value compares its sets with one of them, drawn
anew each round, and what is linked is one component. Then all sets that met and are still in different components are
compared with each other, so that no link between components is left out. Sets that share a band value are dealt to
blocks for that, and two blocks meet in one task, which looks at the pairs whose first common band this is. So a task
gets at most two blocks, and a band value that k sets share moves k * k / ``BLOCK`` small rows, not k * k sets. Pairs
whose bins miss the similarity by ``SURE`` standard deviations end there; the others are compared by their shingles.

A comparison moves one set per pair: pairs are dealt by their first set, which is sent ahead of the second ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lakelog.llm.components import components
from lakelog.llm.minhash import bins_of
from lakelog.llm.rows import map_texts, slices, texts_of, written
from lakelog.llm.simhash import least_of_each, shingle_hashes

SHINGLE = 5
SIMILARITY = 0.8
ROWS = 5
BANDS = 25
STARS = 2
_BINS = 128
#: Sets of a block of the last round; parts that the pairs of one set are dealt to.
BLOCK = 256
SALTS = 8
#: Standard deviations by which bins must miss the similarity; observations that the bins of large sets count for.
SURE, OBSERVED = 5, 100


def shingle_set(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The different shingle hashes of a text in order."""
    return np.unique(shingle_hashes(text, shingle, 0))


def band_keys(hashes: np.ndarray) -> list[int]:
    """One signed 64-bit key per band; none without shingles."""
    bins = bins_of(hashes, _BINS)
    return [] if bins is None else _keys(bins)


def _keys(bins: np.ndarray) -> list[int]:
    from xxhash import xxh64_intdigest

    raw, step = bins.astype("<u8").tobytes(), 8 * ROWS
    return [_signed(xxh64_intdigest(raw[b * step : (b + 1) * step], b)) for b in range(BANDS)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, text_hash, node, n, keys, bins``: rows with the same ``node`` have the same set, of ``n`` shingles.

    ``bins`` is a byte of each bin.
    """

    def make():
        from xxhash import xxh64_intdigest

        def run(part: pa.RecordBatch) -> dict:
            sets = [shingle_set(t, shingle) for t in texts_of(part)]
            bins = [bins_of(s, _BINS) for s in sets]
            return {
                "doc_id": part.column("doc_id"),
                "text_hash": part.column("text_hash"),
                "node": [_signed(xxh64_intdigest(s.tobytes(), 0)) for s in sets],
                "n": list(map(len, sets)),
                "keys": [[] if b is None else _keys(b) for b in bins],
                "bins": [b"" if b is None else b.astype(np.uint8).tobytes() for b in bins],
            }

        return run

    schema = "doc_id long, text_hash long, node long, n long, keys array<long>, bins binary"
    return map_texts(_rows(docs), "text", make, schema)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long"), F.xxhash64(docs["text"]).alias("text_hash"), docs["text"])


def _size_allows(similarity: float) -> Column:
    return F.least("n_a", "n_b") / F.greatest("n_a", "n_b") >= similarity


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The pairs ``a, b`` of nodes whose sets reach the similarity, written.

    Each set is made once, as its sorted hashes. The pairs of ``a`` are dealt to ``SALTS`` parts, so that a set with
    very many partners is no single task's work.
    """
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(classes, "node")
    needed = needed.select("node", F.col("row.doc_id").alias("_id"), F.col("row.text_hash").alias("_hash"))
    rows = _rows(docs)
    same = (rows["text_hash"] == needed["_hash"]) & rows["doc_id"].eqNullSafe(needed["_id"])

    def make():
        def run(part: pa.RecordBatch) -> dict:
            return {"node": part.column("node"), "hashes": [shingle_set(t, shingle).tobytes() for t in texts_of(part)]}

        return run

    texts = rows.join(needed, same).select("node", "text").dropDuplicates(["node"])
    sets = written(map_texts(texts, "text", make, "node long, hashes binary"), "candidates")
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int").alias("salt"))
    first = dealt.select("a", "salt").distinct().join(sets.toDF("a", "hashes"), "a")
    second = dealt.join(sets.toDF("b", "hashes"), "b")
    both = first.select("a", "salt", F.lit(None).cast("long").alias("b"), "hashes", F.lit(0).alias("turn")).union(
        second.select("a", "salt", "b", "hashes", F.lit(1))
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = both.repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", "turn").drop("salt")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.empty(0, np.uint64)
        for batch in batches:
            for part in slices(batch, "hashes"):
                close = []
                columns = (part.column(c) for c in ("a", "b", "hashes", "turn"))
                for a, b, hashes, turn in zip(*(c.to_pylist() for c in columns), strict=True):
                    other = np.frombuffer(hashes, np.uint64)
                    if turn == 0:
                        own = other
                    elif _jaccard(own, other) >= similarity:
                        close.append((a, b))
                if close:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*close)], names=["a", "b"])

    return written(ordered.mapInArrow(compare, "a long, b long"), "links")


def _jaccard(first: np.ndarray, second: np.ndarray) -> float:
    """The similarity of two sets of sorted hashes."""
    if len(first) > len(second):
        first, second = second, first
    at = np.searchsorted(second, first)
    shared = int(np.count_nonzero(second[np.minimum(at, len(second) - 1)] == first)) if len(second) else 0
    return shared / max(1, len(first) + len(second) - shared)


def _met_in_blocks(met: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: sets of different components that share a band value, once each, if they can be similar enough.

    ``met``: node, n, keys, bins, component, band, key. Every set goes to one block of its band value, and each two
    blocks of a value meet in a task of their own.
    """
    sizes = met.groupBy("key").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    rows = met.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"low": F.least("block", "with"), "high": F.greatest("block", "with")})
    rows = rows.select("key", "low", "high", "block", "band", "node", "n", "component", "keys", "bins")
    spread = SURE * (similarity * (1 - similarity)) ** 0.5

    def pairs(table: pa.Table) -> pa.Table:
        band = table.column("band")[0].as_py()
        block, node, n, component = (table.column(c).to_numpy() for c in ("block", "node", "n", "component"))
        keys = np.array(table.column("keys").to_pylist(), np.int64).reshape(len(node), -1)
        bins = np.frombuffer(b"".join(table.column("bins").to_pylist()), np.uint8).reshape(len(node), -1)
        left = np.flatnonzero(block == block.min())
        right = left if block.min() == block.max() else np.flatnonzero(block == block.max())
        found = []
        for i in left.tolist():
            others = right[right > i] if right is left else right
            smaller = np.minimum(n[others], n[i])
            others = others[(component[others] != component[i]) & (smaller >= similarity * np.maximum(n[others], n[i]))]
            others = others[~(keys[others, :band] == keys[i, :band]).any(axis=1)]
            least = similarity - spread / np.sqrt(np.minimum(np.minimum(n[others], n[i]), OBSERVED))
            others = others[(bins[others] == bins[i]).mean(axis=1) >= least]
            found.append((np.full(len(others), node[i]), node[others]))
        a, b = (np.concatenate(x) for x in zip(*found))
        return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.groupBy("key", "low", "high").applyInArrow(pairs, "a long, b long")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """Group documents whose shingle sets reach ``similarity``, directly or through others.

    Needs ``doc_id`` and ``text``; other columns are ignored. Returns ``doc_id, text_hash, component_key,
    component_id``: ``component_id`` is the smallest ``doc_id`` of the group (null if all its ids are null),
    ``component_key`` tells groups apart also then. A text with fewer words than a shingle is one shingle. Null texts
    and texts without words have the same empty set and are one group; repeated rows are kept, a row each; no rows give
    no rows. Equal sets are one class from the start and never paired. Runs jobs (tables in the shared folder).
    """
    sets = written(_sets(docs, shingle), "sets")
    classes = written(
        sets.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("row"), F.min("doc_id").alias("least")),
        "classes",
    )
    met = sets.select("node", "n", F.posexplode("keys").alias("band", "key")).distinct()
    shared = met.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    met = met.join(shared.select("key"), "key", "left_semi").withColumn("component", F.col("node"))
    met = written(met, "met")
    links, linked = None, None
    for turn in range(STARS + 1):
        if met.isEmpty():
            break
        if turn < STARS:
            order = F.xxhash64("node", F.lit(turn))
            middle = F.min_by(F.struct("node", "n", "component"), order).alias("m")
            pairs = met.join(met.groupBy("key").agg(middle), "key").filter("component <> m.component")
            pairs = pairs.select(F.col("m.node").alias("a"), F.col("node").alias("b"), F.col("m.n").alias("n_a"), F.col("n").alias("n_b"))
            pairs = pairs.filter(_size_allows(similarity)).select("a", "b").distinct()
        else:
            marks = sets.select("node", "keys", "bins").join(met.select("node").distinct(), "node", "left_semi")
            pairs = _met_in_blocks(met.join(marks.dropDuplicates(["node"]), "node"), similarity)
        found = _verified(written(pairs, "pairs"), docs, classes, similarity, shingle)
        links = found if links is None else links.union(found)
        linked = components(links)
        if turn < STARS:
            now = met.drop("component").join(linked.withColumnRenamed("component", "_c"), "node", "left")
            now = now.withColumn("component", F.coalesce("_c", "node")).drop("_c")
            mixed = now.groupBy("key").agg((F.min("component") < F.max("component")).alias("mixed")).filter("mixed")
            met = written(now.join(mixed.select("key"), "key", "left_semi"), "met")
    if linked is None:
        linked = classes.select("node", F.col("node").alias("component")).limit(0)
    labelled = classes.join(linked, "node", "left").withColumn("component_key", F.coalesce("component", "node"))
    least = labelled.groupBy("component_key").agg(F.min("least").alias("component_id"))
    found = labelled.select("node", "component_key").join(least, "component_key")
    return sets.select("doc_id", "text_hash", "node").join(found, "node").select(
        "doc_id", "text_hash", "component_key", "component_id"
    )


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: that with the smallest id, nulls first if alone."""
    return least_of_each(docs, near_duplicates(docs, similarity, shingle))
