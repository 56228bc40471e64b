"""Packing documents into sequences of a fixed number of tokens by bin completion.

How to fill the sequences depends only on how many pieces there are of each length, and there are at most ``capacity``
lengths. So the plan is made from that histogram, and it says "this filling, so many times"; Spark numbers the pieces
of each length and looks up which copy of which filling a number belongs to.

The plan starts from best-fit decreasing (the incumbent) and is improved by branch and bound: the largest length left
must go somewhere, so the branches are the fillings of the room beside it, without those another filling dominates
(Martello and Toth, Korf), each taken as often as the counts allow. A branch ends when its waste, or the bound on what
must still be wasted, cannot beat the incumbent. ``nodes`` bounds the search; the incumbent stands when it runs out.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lakelog.llm.pieces import LONGEST, Memory, cut
from lakelog.llm.rows import map_texts
from lakelog.sinks.storage import checkpointed

CAPACITY = 2048
NODES = 4000
#: Pieces of one length that are numbered in one task.
NUMBERED = 4096

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"

Filling = tuple[tuple[int, int], ...]  # (length, times), longest first
Plan = list[tuple[Filling, int]]  # each filling and the number of sequences that have it


# ------------------------------------------------------------------ the plan


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: Martello and Toth's second bound over all thresholds.

    Pieces longer than ``capacity - k`` sit alone among those of at least ``k``; pieces over half the capacity sit
    apart from each other, and what the rest exceeds their room by needs more.
    """
    lengths = np.array(sorted(counts), dtype=np.int64)
    numbers = np.array([counts[x] for x in lengths.tolist()], dtype=object)
    best = 0
    for k in [0, *[x for x in lengths.tolist() if 2 * x <= capacity]]:
        alone = int(numbers[lengths > capacity - k].sum() or 0) if k else 0
        half = (lengths <= capacity - k if k else lengths <= capacity) & (2 * lengths > capacity)
        rest = (lengths >= k) & (2 * lengths <= capacity)
        n_half = int(numbers[half].sum() or 0)
        room = n_half * capacity - int((numbers[half] * lengths[half]).sum() or 0)
        need = int((numbers[rest] * lengths[rest]).sum() or 0) - room
        best = max(best, alone + n_half + max(0, -(-need // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing, for all pieces of a length at once; equal sequences stay together as one entry."""
    groups: dict[int, list[tuple[Filling, int]]] = {}  # by room left
    rooms: list[int] = []

    def add(room: int, filling: Filling, times: int) -> None:
        if times:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((filling, times))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                room, filling, times = capacity, (), left
            else:
                room = rooms[at]
                filling, times = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            each = room // length
            used = min(times, left // each)
            add(room - each * length, (*filling, (length, each)), used)
            left -= used * each
            over = min(left, each - 1) if used < times and left < each else 0
            if over:
                add(room - over * length, (*filling, (length, over)), 1)
                left = 0
            if filling:
                add(room, filling, times - used - bool(over))
    return [entry for entries in groups.values() for entry in entries]


def _dominates(big: list[int], small: list[int]) -> bool:
    """Whether the pieces of ``small`` fit into the pieces of ``big``, each used as a bin."""
    if not small:
        return True
    for i, room in enumerate(big):
        if room >= small[0] and (i == 0 or big[i - 1] != room):
            if _dominates(sorted([*big[:i], room - small[0], *big[i + 1 :]], reverse=True), small[1:]):
                return True
    return False


def fillings(counts: dict[int, int], lengths: list[int], room: int, most: int = 6, steps: int = 600) -> list[Filling]:
    """Undominated ways to fill ``room`` from the counted lengths (ascending), least waste first, at most ``most``."""
    found: list[tuple[int, Filling]] = []
    budget = [steps]

    def search(upto: int, room: int, taken: Filling) -> None:
        budget[0] -= 1
        at = min(upto, bisect_left(lengths, room + 1))
        while at > 0 and not counts.get(lengths[at - 1]):
            at -= 1
        if at == 0 or budget[0] < 0:
            found.append((room, taken))
            return
        i = at - 1
        while i >= 0 and budget[0] >= 0 and sum(1 for waste, _ in found if waste == 0) < most:
            length = lengths[i]
            if have := counts.get(length, 0):
                each = min(have, room // length)
                search(i, room - each * length, (*taken, (length, each)))
            i -= 1

    search(len(lengths), room, ())
    kept: list[tuple[int, Filling, list[int]]] = []
    for waste, filling in sorted(found, key=lambda x: (x[0], -max([0, *(p for p, _ in x[1])]), x[1])):
        flat = [p for p, times in filling for _ in range(times)]
        if len(flat) <= 6 and any(len(k[2]) <= 6 and _dominates(k[2], flat) for k in kept):
            continue
        kept.append((waste, filling, flat))
        if len(kept) == most:
            break
    return [filling for _, filling, _ in kept]


def complete(counts: dict[int, int], capacity: int, nodes: int = NODES) -> Plan:
    """Bin completion over the histogram; see the module's docstring."""
    incumbent = best_fit(counts, capacity)
    total = sum(length * n for length, n in counts.items())
    best = [sum(times for _, times in incumbent), incumbent]
    least, budget = lower_bound(counts, capacity), [nodes]

    def branch(left: dict[int, int], plan: Plan, used: int, waste: int) -> None:
        if not left:
            if used < best[0]:
                best[:] = [used, list(plan)]
            return
        budget[0] -= 1
        lengths = sorted(left)
        largest = lengths[-1]
        beside = dict(left)
        beside[largest] -= 1
        for filling in fillings(beside, lengths, capacity - largest):
            whole: dict[int, int] = {largest: 1}
            for length, times in filling:
                whole[length] = whole.get(length, 0) + times
            copies = min(left[length] // times for length, times in whole.items())
            wasted = waste + copies * (capacity - sum(length * times for length, times in whole.items()))
            if budget[0] < 0 or best[0] <= least or wasted > (best[0] - 1) * capacity - total:
                return  # fillings come by waste, so the later ones waste no less
            rest = {x: n - copies * whole.get(x, 0) for x, n in left.items()}
            rest = {x: n for x, n in rest.items() if n}
            if used + copies + lower_bound_quick(rest, capacity) < best[0]:
                plan.append((tuple(sorted(whole.items(), reverse=True)), copies))
                branch(rest, plan, used + copies, wasted)
                plan.pop()

    if best[0] > least:
        import sys

        depth = sys.getrecursionlimit()
        sys.setrecursionlimit(max(depth, 20 * (len(counts) + 100)))
        try:
            branch(dict(counts), [], 0, 0)
        finally:
            sys.setrecursionlimit(depth)
    return best[1]


def lower_bound_quick(counts: dict[int, int], capacity: int) -> int:
    return -(-sum(length * n for length, n in counts.items()) // capacity)


# ------------------------------------------------------------------ the pieces


class _Encoder:
    """Texts to little-endian ids with an end token, remembering what pieces of text encode to."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.memory = Memory(lambda piece: self._alone([" " + piece])[0])
        # Bytes of each token: a byte-level vocabulary writes a byte as one character.
        vocabulary = self.model.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, number in vocabulary.items():
            self.sizes[number] = len(token)

    def _alone(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: set[str]) -> None:
        """Encode pieces in one text, which is cut again by the bytes of its tokens.

        A piece that does not end in white space is a place no token crosses; the others are encoded when met.
        """
        solid = [p for p in pieces if p and not p[-1].isspace() and len(p) <= LONGEST]
        if not solid:
            return
        ids = np.frombuffer(self._alone([" " + " ".join(solid)])[0], "<u4")
        reach = np.cumsum(self.sizes[ids])
        ends = np.cumsum([len(p.encode()) + 1 for p in solid])
        cuts = np.searchsorted(reach, ends) + 1
        raw, begin = ids.tobytes(), 0
        for piece, end in zip(solid, (4 * cuts).tolist(), strict=True):
            self.memory.keep(piece, raw[begin:end])
            begin = end

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        cuts = [cut(t) for t in texts]
        self._learn(self.memory.lacking(chain.from_iterable(pieces[1:] for pieces in cuts)))
        for pieces, first in zip(cuts, self._alone([pieces[0] for pieces in cuts]), strict=True):
            yield b"".join([first, *map(self.memory.__getitem__, pieces[1:]), b"\0\0\0\0"])


@lru_cache(maxsize=1)
def _encoder(path: str) -> _Encoder:
    """One for a worker process, whose tasks share its memory."""
    return _Encoder(path)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Every document's ids with id 0 behind them, cut into pieces of ``capacity`` of which the first may be shorter."""

    def make():
        encoder = _encoder(tokenizer)

        def run(part: pa.RecordBatch) -> dict:
            out = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            texts = [t or "" for t in part.column("text").to_pylist()]
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                n, start, piece = len(ids) // 4, 0, 0
                while start < n:
                    length = (n - start) % capacity or capacity if start == 0 else capacity
                    out["doc_id"].append(doc_id)
                    out["piece"].append(piece)
                    out["start"].append(start)
                    out["length"].append(length)
                    out["ids_crc32"].append(zlib.crc32(ids[4 * start : 4 * (start + length)]))
                    start, piece = start + length, piece + 1
            return out

        return run

    return map_texts(docs.select(docs["doc_id"].cast("long"), docs["text"]), "text", make, PIECES)


def _places(plan: Plan) -> np.ndarray:
    """Rows (length, first number, last number + 1, pieces a copy, first sequence, offset in the sequence)."""
    rows, numbered, sequence = [], {}, 0
    for filling, copies in plan:
        offset = 0
        for length, times in filling:
            first = numbered.get(length, 0)
            numbered[length] = first + copies * times
            rows.append((length, first, first + copies * times, times, sequence, offset))
            offset += length * times
        sequence += copies
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)


def numbered(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``number``: 0, 1, 2, ... within each length.

    The pieces of a length are dealt to shares by a hash, each share is numbered by itself and begins where the shares
    before it end. So a length that a third of all pieces have is numbered by many tasks.
    """
    shares = max(8, pieces.count() // NUMBERED)
    dealt = pieces.withColumn("_share", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shares)))
    sizes = dealt.groupBy("length", "_share").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("length", "_share", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    order = Window.partitionBy("length", "_share").orderBy("doc_id", "piece", "ids_crc32")
    return (
        dealt.join(begins, ["length", "_share"])
        .withColumn("number", F.col("_begin") + F.row_number().over(order) - 1)
        .drop("_share", "_begin")
    )


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """Pack all documents into few sequences of at most ``capacity`` tokens.

    Needs ``doc_id`` and ``text``; other columns are ignored. A null or empty text is its end token alone; a null
    ``doc_id`` and repeated rows are packed like any other; no rows give no rows. Runs jobs: the pieces are
    checkpointed, then counted by length (at most ``capacity`` rows come to the driver).
    """
    pieces = checkpointed(token_pieces(docs, tokenizer, capacity))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = _places(complete(counts, capacity, nodes))
    width = int(places[:, 2].max()) + 1 if len(places) else 1
    keys = places[:, 0] * width + places[:, 1]  # ascending: a length, then its first number

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            number = batch.column("number").to_numpy(zero_copy_only=False)
            at = places[np.searchsorted(keys, length * width + number, side="right") - 1]
            copy, slot = np.divmod(number - at[:, 1], at[:, 3])
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(at[:, 4] + copy), pa.array(at[:, 5] + slot * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = numbered(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "number")
    return ranked.mapInArrow(place, PACKED)
