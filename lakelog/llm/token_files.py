"""Token ids as binary files: every document compressed by itself with one shared zstandard dictionary.

A file holds, in ascending order of ``doc_id``::

    head    magic, bytes an id (2 or 4), SHA-256 of the dictionary
    frames  one zstandard frame per document: its ids, little-endian, made with the shared dictionary
    index   compressed: doc ids, where each frame begins, how many ids the file holds before each document
    foot    where the index is, its CRC-32, documents, documents without id (they come first), ids, magic

So one document is read with three range reads: foot, index, frame. The dictionary lies beside the files under its hash,
and a reader refuses a dictionary of another hash. Files are written by the tasks of a range partitioning, so their
numbers and the documents in them ascend; the table of files says which files count, and a lost task's files are never
in it.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from lakelog.llm.pieces import Memory
from lakelog.llm.rows import slices, texts_of, written
from lakelog.llm.warc import Reader, _filesystem

#: Bytes of the dictionary; documents it is trained on, and the longest of them in bytes of text.
DICTIONARY_BYTES = 112_640
SAMPLE = 2_000
SAMPLE_BYTES = 1 << 15
LEVEL = 3
#: Bytes after which a task begins another file; documents that one step of a reading task takes.
FILE_BYTES = 1 << 28
READ_DOCUMENTS = 1 << 13
#: Files whose ids are added up in one task before the blocks of files are.
FILES_BLOCK = 1 << 10

_MAGIC = b"TOKZIDS1"
_HEAD = struct.Struct("<8sI32s")
_FOOT = struct.Struct("<QQIQQQ8s")

FILES = "part int, file int, path string, documents long, tokens long, bytes long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


# ------------------------------------------------------------------ encoding


class Encoder:
    """Ids of whole texts as little-endian numbers of ``width`` bytes.

    With a vocabulary whose pre-tokens hold no white space, a text may be cut at every space, and two bounded memories
    keep what pieces and what single words encode to. A new word goes to the library's model; a new piece is normalised
    and cut into words here if all its characters are below U+0300, where composing changes nothing and classes of
    characters are old, and by the library otherwise. Any other vocabulary gets whole texts through the library.
    """

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if max(self.tokenizer.get_vocab().values()) < 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.specials = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)")
        said = json.loads(self.tokenizer.to_str())
        steps = [(said["normalizer"] or {}).get("normalizers", []), (said["pre_tokenizer"] or {}).get("pretokenizers", [])]
        plain = [[step["type"] for step in group] for group in steps] == _PLAIN
        self.words = regex.compile(steps[1][0]["pattern"]["Regex"]).findall if plain else None
        self.by_word = Memory(self._word)
        self.by_piece = Memory(self._piece)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _word(self, word: str) -> bytes:
        known = word if word.isascii() and word.isprintable() else "".join(map(_BYTE_CHARS.__getitem__, word.encode()))
        return b"".join([t.id.to_bytes(self.width, "little") for t in self.tokenizer.model.tokenize(known)])

    def _piece(self, piece: str) -> bytes:
        lower = piece.lower()
        if not (lower.isascii() or max(lower) < "\u0300") or self.specials.search(piece):
            return self._whole(piece)
        return b"".join(map(self.by_word.__getitem__, self.words(lower)))

    def encode(self, text: str) -> bytes:
        if self.words is None:
            return self._whole(text)
        if _is_latin(text) and not self.specials.search(text.lower()):
            text = text.lower()  # letter by letter, as in the library; fewer pieces differ then
        return b"".join(map(self.by_piece.__getitem__, text.replace("\n", " ").split(" ")))


#: What ``Encoder`` does itself: these normalisers and pre-tokenizers, in this order.
_PLAIN = [["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]]


def _is_latin(text: str) -> bool:
    """All characters are below U+0100."""
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


def _byte_chars() -> list[str]:
    """The character that a byte-level vocabulary writes for each byte: itself if it is printable, else the next free one."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    moved = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(kept)))}
    return [chr(moved.get(b, b)) for b in range(256)]


_BYTE_CHARS = _byte_chars()


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One for a worker process, whose tasks share its memory."""
    return Encoder(path)


# ------------------------------------------------------------------ the dictionary


def make_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary trained on serialized id arrays; what is too little to train on is a dictionary as it stands."""
    import zstandard

    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples, threads=0).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:size]


def train(docs: DataFrame, tokenizer: str, end_id: int, sample: int = SAMPLE) -> bytes:
    """The shared dictionary of a corpus, from ``sample`` documents of at most ``SAMPLE_BYTES`` that a hash chooses.

    It serves short documents, so longer ones are not asked. Four times as many documents of any length are looked at
    as are wanted, so that few texts are moved. Runs a job; only the dictionary comes to the driver.
    """
    size = F.octet_length("text")
    by = F.xxhash64(docs["doc_id"].cast("long"), size)
    looked_at = F.pmod(by, F.lit(max(1, docs.count()))) < 4 * sample
    short = docs.select(docs["doc_id"].cast("long"), docs["text"]).filter(looked_at & (size <= SAMPLE_BYTES))
    chosen = short.orderBy(by, "text").limit(sample).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        end = end_id.to_bytes(encoder.width, "little")
        samples = [ids + end for batch in batches for part in slices(batch, "text") for ids in map(encoder.encode, texts_of(part))]
        if samples:
            yield pa.RecordBatch.from_arrays([pa.array([make_dictionary(samples)], pa.binary())], names=["dictionary"])

    rows = chosen.mapInArrow(run, "dictionary binary").collect()
    return bytes(rows[0]["dictionary"]) if rows else b""


def dictionary_path(folder: str, dictionary: bytes) -> str:
    return f"{folder}/{hashlib.sha256(dictionary).hexdigest()}.dict"


def _shared(dictionary: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(dictionary) if len(dictionary) >= 8 else None


# ------------------------------------------------------------------ one file


class FileWriter:
    """Writes one file; documents must come in ascending order of their ids, those without id first."""

    def __init__(self, folder: str, width: int, dictionary: bytes) -> None:
        import zstandard

        filesystem, name = _filesystem(folder)
        filesystem.create_dir(name, recursive=True)
        file = f"{uuid.uuid4().hex}.tokz"
        self.path, self.width = f"{folder}/{file}", width
        self.stream = filesystem.open_output_stream(f"{name}/{file}", compression=None)
        head = _HEAD.pack(_MAGIC, width, hashlib.sha256(dictionary).digest())
        self.stream.write(head)
        self.at, self.nulls, self.tokens = len(head), 0, 0
        self.ids: list[int] = []
        self.places: list[int] = []
        self.starts: list[int] = []
        shared = _shared(dictionary)
        self.pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_dict_id=False).compress

    def write(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.pack(ids)
        self.nulls += doc_id is None
        self.ids.append(doc_id or 0)
        self.places.append(self.at)
        self.starts.append(self.tokens)
        self.stream.write(frame)
        self.at += len(frame)
        self.tokens += len(ids) // self.width

    def close(self) -> None:
        import zstandard

        columns = self.ids, [*self.places, self.at], [*self.starts, self.tokens]
        raw = b"".join(np.diff(np.array(c, "<i8"), prepend=0).astype("<i8").tobytes() for c in columns)
        index = zstandard.ZstdCompressor(level=LEVEL).compress(raw)
        self.stream.write(index)
        foot = self.at, len(index), zlib.crc32(index), len(self.ids), self.nulls, self.tokens, _MAGIC
        self.stream.write(_FOOT.pack(*foot))
        self.at += len(index) + _FOOT.size
        self.stream.close()


class TokenFile:
    """Reads one file by ranges: its index once, then any frame."""

    def __init__(self, path: str, dictionary: bytes, reader: Reader | None = None) -> None:
        import zstandard

        filesystem, name = _filesystem(path)
        size = filesystem.get_file_info(name).size
        self.path, self.reader = path, reader or Reader()
        magic, self.width, digest = _HEAD.unpack(self.reader.read(path, 0, _HEAD.size))
        foot = _FOOT.unpack(self.reader.read(path, size - _FOOT.size, _FOOT.size))
        at, length, crc, self.documents, self.nulls, self.tokens, last = foot
        index = self.reader.read(path, at, length)
        if magic != _MAGIC or last != _MAGIC or zlib.crc32(index) != crc:
            raise ValueError(f"damaged token file {path}")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path} was written with another dictionary")
        columns = np.frombuffer(zstandard.ZstdDecompressor().decompress(index), "<i8")
        n = self.documents
        self.ids, self.places, self.starts = (np.cumsum(c) for c in (columns[:n], columns[n : 2 * n + 1], columns[2 * n + 1 :]))
        self.unpack = zstandard.ZstdDecompressor(dict_data=_shared(dictionary)).decompress

    def doc_ids(self, begin: int, end: int) -> list[int | None]:
        nulls = max(0, min(end, self.nulls) - begin)
        return [None] * nulls + self.ids[begin + nulls : end].tolist()

    def documents_at(self, begin: int, end: int) -> Iterator[np.ndarray]:
        """The ids of the documents numbered ``begin`` to ``end`` of the file, read at once."""
        first = int(self.places[begin])
        raw = memoryview(self.reader.read(self.path, first, int(self.places[end]) - first))
        for a, b in zip((self.places[begin:end] - first).tolist(), (self.places[begin + 1 : end + 1] - first).tolist()):
            yield np.frombuffer(self.unpack(raw[a:b]), f"<u{self.width}")

    def find(self, doc_id: int) -> Iterator[np.ndarray]:
        """The ids of every document of this id, by binary search."""
        at = self.nulls + bisect_left(self.ids[self.nulls :], doc_id)
        while at < self.documents and self.ids[at] == doc_id:
            yield from self.documents_at(at, at + 1)
            at += 1


# ------------------------------------------------------------------ the corpus


def write_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int, dictionary: bytes) -> DataFrame:
    """Encode every whole text, ``end_id`` behind it, and write files under ``folder``; the table of files (stored).

    Needs ``doc_id`` and ``text``; other columns are ignored. Null text is empty: its end id alone. Documents without
    id come first, rows of equal id in order of a hash of their text; rows that equal each other are kept, a document
    each. No rows give no files. Texts are shuffled once, to ranges of ids, and encoded there. Runs jobs.
    """
    rows = docs.select(docs["doc_id"].cast("long"), F.xxhash64(docs["text"]).alias("_order"), docs["text"])
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.asc_nulls_first("doc_id"), F.asc("_order")]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    filesystem, name = _filesystem(folder)
    filesystem.create_dir(name, recursive=True)
    with filesystem.open_output_stream(_filesystem(dictionary_path(folder, dictionary))[1], compression=None) as stream:
        stream.write(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        end = end_id.to_bytes(encoder.width, "little")
        out: list[tuple] = []
        writer = None

        def close() -> None:
            writer.close()
            part = TaskContext.get().partitionId()
            out.append((part, len(out), writer.path, len(writer.ids), writer.tokens, writer.at))

        for batch in batches:
            for part in slices(batch, "text"):
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), map(encoder.encode, texts_of(part)), strict=True):
                    if writer is not None and writer.at >= FILE_BYTES:
                        close()
                        writer = None
                    writer = writer or FileWriter(folder, encoder.width, dictionary)
                    writer.write(doc_id, ids + end)
        if writer is not None:
            close()
        types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        names = [f.split()[0] for f in FILES.split(", ")]
        columns = zip(*out, strict=True) if out else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return written(dealt.mapInArrow(run, FILES), "token-files")


def with_starts(files: DataFrame) -> DataFrame:
    """The table of files with ``start``: the ids in all files before. Blocks of files are added up before the whole."""
    block = F.floor(F.col("part") / FILES_BLOCK).alias("_block")
    files = files.select("*", block)
    sums = files.groupBy("_block").agg(F.sum("tokens").alias("_t"))
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    outer = sums.select("_block", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_outer"))
    within = Window.partitionBy("_block").orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    inner = files.withColumn("_inner", F.coalesce(F.sum("tokens").over(within), F.lit(0)))
    return inner.join(outer, "_block").withColumn("start", F.col("_inner") + F.col("_outer")).drop("_block", "_inner", "_outer")


def read_files(files: DataFrame, folder: str, dictionary_hash: str) -> DataFrame:
    """Every document of the files: ``doc_id, start, n_tokens, ids_crc32`` (of its ids as unsigned 32-bit numbers).

    ``start`` counts the ids of all documents before it. A task reads runs of ``READ_DOCUMENTS`` documents.
    """
    steps = F.explode(F.sequence(F.lit(0), F.col("documents") - 1, F.lit(READ_DOCUMENTS).cast("long"))).alias("begin")
    runs = with_starts(files).select("path", "start", steps)
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [f.split()[0] for f in READ.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, dictionary, file = Reader(), None, None
        for batch in batches:
            for row in batch.to_pylist():
                if dictionary is None:
                    dictionary = reader.whole(f"{folder}/{dictionary_hash}.dict")
                if file is None or file.path != row["path"]:
                    file = TokenFile(row["path"], dictionary, reader)
                begin, end = row["begin"], min(file.documents, row["begin"] + READ_DOCUMENTS)
                lengths, crcs = [], []
                for ids in file.documents_at(begin, end):
                    lengths.append(len(ids))
                    crcs.append(zlib.crc32(ids.astype("<u4")))
                starts = file.starts[begin:end] + row["start"]
                columns = [file.doc_ids(begin, end), starts, lengths, crcs]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return runs.repartition(parts, "path", "begin").sortWithinPartitions("path", "begin").mapInArrow(run, READ)


def write_and_read(docs: DataFrame, tokenizer: str, folder: str, end_id: int) -> DataFrame:
    """Write a corpus as token files with a dictionary of its own and read all documents back from them."""
    dictionary = train(docs, tokenizer, end_id)
    files = write_files(docs, tokenizer, folder, end_id, dictionary)
    return read_files(files, folder, hashlib.sha256(dictionary).hexdigest())
