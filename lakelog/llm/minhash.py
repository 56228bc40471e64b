"""Document fingerprints by one-permutation MinHash.

Every shingle is hashed once; the top bits of the hash name a bin, and a bin keeps its smallest hash. Empty bins borrow
from bins that a fixed random function of (bin, attempt) names, the same for all documents (optimal densification).
The fingerprint is the low ``BITS`` bits of each bin, packed, in hex. Two bins agree by chance with probability
``2 ** -BITS``; the likeness takes that off.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lakelog.llm.rows import slices, texts_of
from lakelog.llm.simhash import shingle_hashes

SHINGLE = 5
BINS = 512  # a power of two, at most 65536
BITS = 4
#: Ranges of ids for each shuffle partition; a range is the least that one task reads in order.
RANGES = 4

SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
_FIRST = -(1 << 63)
_ATTEMPTS = 16


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: a fixed random function of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = x * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bins_of(hashes: np.ndarray, bins: int = BINS) -> np.ndarray | None:
    """The smallest hash of each bin, empty ones filled by optimal densification; None without hashes."""
    if not len(hashes):
        return None
    ordered = np.sort(hashes)
    names = (ordered >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
    out, full = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    out[names[first]], full[names[first]] = ordered[first], True
    empty, block = np.flatnonzero(~full), 0
    while len(empty):
        asked = _asked(bins, block)[:, empty]
        hit = full[asked]
        first_hit, found = hit.argmax(0), hit.any(0)
        out[empty[found]] = out[asked[first_hit[found], np.flatnonzero(found)]]
        empty, block = empty[~found], block + 1
    return out


@lru_cache(maxsize=256)
def _asked(bins: int, block: int) -> np.ndarray:
    """``[attempt, bin]``: the bins that empty bins ask in the attempts of a block."""
    attempts = np.arange(block * _ATTEMPTS + 1, (block + 1) * _ATTEMPTS + 1, dtype=np.uint64)[:, None]
    return (_mixed(np.arange(bins, dtype=np.uint64) + attempts * np.uint64(bins)) % np.uint64(bins)).astype(np.int64)


def packed(values: np.ndarray | None, bits: int = BITS) -> str:
    """The low bits of each bin as hex, bin 0 first; the empty string without words."""
    if values is None:
        return ""
    low = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, -bits:]
    return np.packbits(low.ravel()).tobytes().hex()


def unpacked(fingerprint: str, bits: int = BITS) -> np.ndarray:
    raw = np.unpackbits(np.frombuffer(bytes.fromhex(fingerprint), np.uint8)).reshape(-1, bits)
    return raw @ (1 << np.arange(bits - 1, -1, -1))


def likeness(a: str, b: str, bits: int = BITS) -> float:
    """Estimated Jaccard similarity of the shingle sets, corrected for chance. Without words only the same is alike."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    agree, chance = float((unpacked(a, bits) == unpacked(b, bits)).mean()), 2.0**-bits
    return min(1.0, max(0.0, (agree - chance) / (1 - chance)))


def fingerprint(text: str) -> str:
    return packed(bins_of(shingle_hashes(text, SHINGLE, 0)))


def edited(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by the first as many characters of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _hashed(words: list[bytes]) -> np.ndarray:
    """Hashes of the shingles of a list of words, or of all words if they are fewer than a shingle."""
    from xxhash import xxh64_intdigest

    size = max(1, min(SHINGLE, len(words)))
    ends = range(size, len(words) + 1)
    return np.array([xxh64_intdigest(b" ".join(words[e - size : e]), 0) for e in ends], np.uint64)


def edited_hashes(text: str, own: np.ndarray, following: str, others: np.ndarray) -> np.ndarray:
    """Shingle hashes of the edited text, from those of the two texts.

    Only shingles around the seam and the last one, whose word may be cut, are hashed anew.
    """
    half = len(text) // 2
    kept, taken = text[: len(text) - half].encode().lower(), following[:half].encode().lower()
    before, after = kept.split(), taken.split()
    whole, rest = max(0, len(before) - 1), len(after)  # of the kept words all but the last are surely uncut
    seam = [*before, *after]
    if before and after and kept[-1:].split() and taken[:1].split():
        seam = [*before[:-1], before[-1] + after[0], *after[1:]]
    if whole < SHINGLE and rest < SHINGLE + 2:
        return _hashed(seam)
    first = max(0, whole - SHINGLE + 1)  # the first shingle that is not one of the own
    if rest < SHINGLE + 2:
        return np.concatenate([own[:first], _hashed(seam[first:])])
    at = len(seam) - rest  # the place of the first word taken
    middle = _hashed(seam[first : at + SHINGLE])
    return np.concatenate([own[:first], middle, others[1 : rest - SHINGLE], _hashed(after[-SHINGLE:])])


def _ranges(docs: DataFrame) -> tuple[np.ndarray, dict[int, list[int]]]:
    """Bounds that cut the ids into ranges, and per id that leads a range the ranges that need it as their successor.

    Ranges are counted in descending order. Both have at most as many entries as there are ranges.
    """
    wanted = RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(_FIRST)).alias("key"))
    cuts = ids.filter(F.col("key") > _FIRST).approxQuantile("key", [i / wanted for i in range(1, wanted)], 0.25 / wanted)
    bounds = np.unique(np.array(cuts, dtype=np.float64)).astype(np.int64)
    place = _place(bounds)
    heads = ids.groupBy(place("key").alias("place")).agg(F.max("key").alias("head")).orderBy("place").collect()
    leads: dict[int, list[int]] = {}
    for i, row in enumerate(heads):
        leads.setdefault(row["head"], []).append(heads[i - 1]["place"])  # the first leads after the last
    return bounds, leads


def _place(bounds: np.ndarray):
    @F.pandas_udf("int")
    def place(key: pd.Series) -> pd.Series:
        return pd.Series(len(bounds) - np.searchsorted(bounds, key.to_numpy(), side="left"), dtype="int32")

    return place


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprint every whole text and its edited text, and compare with the edited and with the next document.

    The next document follows in descending ``doc_id`` (equal ids: descending text); the first follows the last, so a
    lone document follows itself. Needs ``doc_id`` and ``text``; other columns are ignored. A null text is empty; a
    null ``doc_id`` comes last; repeated rows are kept, a row each; no rows give no rows. Texts without words have an
    empty fingerprint, which is like itself only. Runs two small jobs over the ids.

    Texts are shuffled once, to ranges of ids; the document that leads a range also goes to the range before it.
    """
    if docs.select("doc_id").isEmpty():
        return docs.sparkSession.createDataFrame([], SCHEMA)
    bounds, leads = _ranges(docs)

    @F.pandas_udf("array<struct<place:int,borrowed:int>>")
    def places(key: pd.Series) -> pd.Series:
        own = len(bounds) - np.searchsorted(bounds, key.to_numpy(), side="left")
        return pd.Series(
            [
                [{"place": int(p), "borrowed": 0}, *({"place": q, "borrowed": 1} for q in leads.get(k, ()))]
                for p, k in zip(own, key.tolist(), strict=True)
            ]
        )

    key = F.coalesce(docs["doc_id"].cast("long"), F.lit(_FIRST))
    rows = docs.select(docs["doc_id"].cast("long"), F.coalesce(docs["text"], F.lit("")).alias("text"), key.alias("key"))
    dealt = rows.select("*", F.inline(places("key")))
    ordered = dealt.repartition("place").sortWithinPartitions("place", "borrowed", F.desc("key"), F.desc("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        before = None  # place, doc_id, text, hashes and fingerprint of a row that still waits for the next
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                borrowed, place = part.column("borrowed").to_pylist(), part.column("place").to_pylist()
                for i, (doc_id, text) in enumerate(zip(part.column("doc_id").to_pylist(), texts_of(part), strict=True)):
                    if borrowed[i] and (before is None or before[0] != place[i]):
                        continue  # the row that needed it has it already
                    hashes = shingle_hashes(text, SHINGLE, 0)
                    prints = packed(bins_of(hashes))
                    if before is not None and before[0] == place[i]:
                        _, waiting, old, own, print_ = before
                        changed = hashlib.sha256(edited(old, text).encode()).hexdigest()
                        other = packed(bins_of(edited_hashes(old, own, text, hashes)))
                        near = likeness(print_, other), likeness(print_, prints)
                        out.append((waiting, len(old), changed, print_, other, *near))
                    before = None if borrowed[i] else (place[i], doc_id, text, hashes, prints)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], names=names)  # noqa: B905

    return ordered.select("doc_id", "text", "place", "borrowed").mapInArrow(run, SCHEMA)


_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
