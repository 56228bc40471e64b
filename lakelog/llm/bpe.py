"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A leaf holds the rank of the pair that begins at its byte, an inner node the smallest rank below it and, among equal
ranks, the leftmost position. A merge reads the root, joins the pair, and updates three leaves: the grown part, its
left neighbour and the swallowed part. So a match of n bytes takes O(n log n) steps, also when n is the whole text.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lakelog.llm.pieces import Memory, cut
from lakelog.llm.rows import map_texts, texts_of

_NONE = 1 << 62
_POSITION = (1 << 32) - 1

SCHEMA = "doc_id long, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string"


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one match. A match that is a token by itself is that token, as in tiktoken."""
    whole = ranks.get(data)
    if whole is not None:
        return [whole]
    n = len(data)
    after = list(range(1, n + 1))  # where the part that begins here ends
    before = list(range(-1, n - 1))  # where the live part to the left begins
    size = 1 << max(0, n - 1).bit_length()
    tree = [_NONE] * (2 * size)
    find = ranks.get
    for i in range(n - 1):
        rank = find(data[i : i + 2])
        if rank is not None:
            tree[size + i] = rank << 32 | i
    for node in range(size - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left <= right else right

    def put(position: int, value: int) -> None:
        node = size + position
        tree[node] = value
        while node > 1:
            other = tree[node ^ 1]
            value = value if value <= other else other
            node >>= 1
            if tree[node] == value:
                return
            tree[node] = value

    while (top := tree[1]) != _NONE:
        i = top & _POSITION
        j = after[i]
        end = after[i] = after[j]
        put(j, _NONE)
        if end < n:
            before[end] = i
            rank = find(data[i : after[end]])
            put(i, _NONE if rank is None else rank << 32 | i)
        else:
            put(i, _NONE)
        left = before[i]
        if left >= 0:
            rank = find(data[left:end])
            put(left, _NONE if rank is None else rank << 32 | left)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[data[i : after[i]]])
        i = after[i]
    return ids


class Codec:
    """Encodes texts to little-endian unsigned 32-bit ids and back, for one vocabulary."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        self.ranks = load_ranks(path)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.matches = regex.compile(pattern).findall
        self.by_match = Memory(lambda match: np.array(merge(match.encode(), self.ranks), "<u4").tobytes())
        self.by_piece = Memory(lambda piece: self._ids(" " + piece))

    def _ids(self, text: str) -> bytes:
        return b"".join(map(self.by_match.__getitem__, self.matches(text)))

    def encode(self, text: str) -> bytes:
        first, *rest = cut(text)
        return self._ids(first) + b"".join(map(self.by_piece.__getitem__, rest))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=1)
def _codec(path: str, pattern: str) -> Codec:
    """One for a worker process, whose tasks share its memory."""
    return Codec(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, keep_ids: bool = True) -> DataFrame:
    """Encode every whole text, then decode its ids.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Null text is empty and has no ids; a null
    ``doc_id`` and repeated rows are kept, a row each; no rows give no rows. ``ids`` are little-endian unsigned 32-bit
    numbers (null without ``keep_ids``); ``decoded_sha256`` is of the bytes the ids decode to.
    """

    def make():
        codec = _codec(path, pattern)

        def run(part: pa.RecordBatch) -> dict:
            encoded = [codec.encode(t) for t in texts_of(part)]
            return {
                "doc_id": part.column("doc_id"),
                "n_tokens": [len(e) // 4 for e in encoded],
                "ids": encoded if keep_ids else [None] * len(encoded),
                "ids_sha256": [hashlib.sha256(e).hexdigest() for e in encoded],
                "decoded_sha256": [hashlib.sha256(codec.decode(e)).hexdigest() for e in encoded],
            }

        return run

    return map_texts(docs.select(docs["doc_id"].cast("long"), docs["text"]), "text", make, SCHEMA)
