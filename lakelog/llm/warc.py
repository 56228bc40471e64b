"""WARC archives of pages, and a two-level index of their captures.

Archives hold a gzip member per record, so a record is read by its offset and length alone. Of equal payloads one is
stored as a response; the others are revisit records that refer to it.

The index has a line per capture, sorted by the address with its host reversed ("com,example,www)/path") and the page's
id. Lines are packed into compressed blocks, and a part of the index has a sparse directory with the first key of each
block. A lookup finds its part by binary search over the parts' first keys, its block by binary search over the part's
directory, reads that block, and then the records it names: three range reads, whatever the size of the archives.

Files go to the shared folder by pyarrow's file systems, under names no other attempt of a task uses. A file counts
only if the table of captures or of parts names it, and a lost task's rows never get there.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lakelog.llm.rows import slices, written
from lakelog.sinks.storage import fresh_path

#: Payloads shorter than this are always stored in full.
LEAST_SHARED = 1000
#: Bytes after which a task begins another archive; captures of an index block; captures of an index part, about.
ARCHIVE_BYTES = 1 << 30
BLOCK = 256
PART = 1 << 16
_OPEN_FILES = 16
_DATE = "1970-01-01T00:00:00Z"  # the pages carry no time of capture

CAPTURES = (
    "key string, page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long, "
    "file string, offset long, length long"
)
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _filesystem(path: str):
    """pyarrow's file system for a Hadoop path, and the path in it."""
    from pyarrow import fs

    path = re.sub(r"^s3[an]://", "s3://", path)
    if re.match(r"(file:)?/", path):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path)


def surt(url: Column) -> Column:
    """The address as an index key: host labels reversed, then the path; no scheme, user or fragment."""
    url = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/?#]*)", 1))
    rest = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)", 1)
    labels = F.concat_ws(",", F.reverse(F.split(F.regexp_replace(host, r":\d+$", ""), r"\.")))
    key = F.concat(labels, F.lit(")"), F.when(rest == "", "/").otherwise(rest))
    return F.regexp_replace(F.when(host == "", F.concat(F.lit(")"), url)).otherwise(key), r"\s", "%20")


def capture_key(url: Column, page_id: Column) -> Column:
    """Address and id, sorted by address and then id; a null id comes first."""
    number = page_id.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")
    digits = F.lpad(F.coalesce(number.cast("string"), F.lit("")), 20, "0")
    return F.concat(surt(url), F.lit(" "), digits)


# ------------------------------------------------------------------ records


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member. ``refers_to`` makes it a revisit, which keeps the HTTP head but not the payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (0 if revisit else len(payload))}",
    ]
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    packer = zlib.compressobj(1, wbits=31)
    body = http if revisit else http + payload
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def parse(member: bytes) -> dict:
    """A record read back. A response's payload is held against its digest and length."""
    raw = zlib.decompress(member, wbits=31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    size = int(_fields(http)["content-length"])
    if fields["warc-type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['warc-record-id']}")
    return {
        "page_id": _page(fields["warc-record-id"]),
        "url": fields["warc-target-uri"],
        "payload": payload,
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["warc-type"],
        "refers_to": _page(fields.get("warc-refers-to")),
    }


class Reader:
    """Range reads over a few open files."""

    def __init__(self) -> None:
        self.files: dict[str, object] = {}

    def read(self, path: str, offset: int, length: int) -> bytes:
        file = self.files.pop(path, None)
        if file is None:
            filesystem, name = _filesystem(path)
            file = filesystem.open_input_file(name)
            if len(self.files) >= _OPEN_FILES:
                self.files.pop(next(iter(self.files))).close()
        self.files[path] = file
        return file.read_at(length, offset)

    def whole(self, path: str) -> bytes:
        filesystem, name = _filesystem(path)
        with filesystem.open_input_stream(name) as stream:
            return stream.read()


class _Writer:
    """Files of a task, each under a new name."""

    def __init__(self, folder: str, suffix: str, most: int = 1 << 62) -> None:
        self.folder, self.suffix, self.most, self.stream = folder, suffix, most, None

    def write(self, data: bytes) -> tuple[str, int]:
        if self.stream is None or self.at >= self.most:
            self.close()
            filesystem, folder = _filesystem(self.folder)
            filesystem.create_dir(folder, recursive=True)
            name = f"{uuid.uuid4().hex}{self.suffix}"
            self.path, self.at = f"{self.folder}/{name}", 0
            self.stream = filesystem.open_output_stream(f"{folder}/{name}", compression=None)
        place = self.path, self.at
        self.stream.write(data)
        self.at += len(data)
        return place

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.stream = None


# ------------------------------------------------------------------ writing


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record per page under ``folder`` and return the table of captures (stored). Runs jobs.

    Needs ``page_id``, ``url`` and ``html``; other columns are ignored. Of equal payloads of at least ``LEAST_SHARED``
    bytes, rows with the largest ``page_id`` are responses and others revisit it (a null id is smaller than any; if
    all are null all are responses). Null html is an empty payload; repeated rows are records of their own; no rows
    give no captures.
    """
    html = F.coalesce(pages["html"], F.lit(""))
    rows = pages.select(pages["page_id"].cast("long"), pages["url"], html.alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    shared = rows.filter(F.octet_length("html") >= LEAST_SHARED).groupBy("digest")
    shared = shared.agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).filter("n > 1").drop("n")
    key = capture_key(F.col("url"), F.col("page_id")).alias("key")
    revisit = F.when(F.coalesce(F.col("page_id") < F.col("keeper"), F.col("page_id").isNull()), F.col("keeper"))
    dealt = rows.join(shared, "digest", "left").select(key, "page_id", "url", "html", "digest", revisit.alias("refers_to"))
    names = [f.split()[0] for f in CAPTURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Writer(folder, ".warc.gz", ARCHIVE_BYTES)
        for batch in batches:
            for part in slices(batch, "html"):
                out: list[list] = [[] for _ in names]
                for row in part.to_pylist():
                    payload = row["html"].encode()
                    member = record(row["page_id"], row["url"], payload, row["digest"], row["refers_to"])
                    file, offset = writer.write(member)
                    kind = "response" if row["refers_to"] is None else "revisit"
                    values = [row["key"], row["page_id"], kind, row["digest"], len(payload), row["refers_to"], file, offset, len(member)]
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _TYPES, strict=True)], names=names)
        writer.close()

    return written(dealt.mapInArrow(run, CAPTURES), "captures")


_TYPES = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]


@dataclass(frozen=True)
class Index:
    """First key, block file and directory file of each part, in order of keys: one entry per ``PART`` captures."""

    firsts: tuple[bytes, ...]
    blocks: tuple[str, ...]
    directories: tuple[str, ...]


def build_index(captures: DataFrame, folder: str) -> Index:
    """Sort the captures by key and write blocks and directories under ``folder``. Runs jobs."""
    parts = max(1, captures.count() // PART, int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    fields = ["page_id", "record_type", "payload_digest", "file", "offset", "length"]
    ordered = captures.select("key", *fields).repartitionByRange(parts, "key").sortWithinPartitions("key", "file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, lines, directory = _Writer(folder, ".idx"), [], []

        def block() -> None:
            data = zlib.compress("\n".join(lines).encode(), 6)
            _, offset = writer.write(data)
            directory.append((lines[0].split(" {", 1)[0], offset, len(data)))
            lines.clear()

        for batch in batches:
            for row in batch.to_pylist():
                lines.append(f"{row.pop('key')} {json.dumps(row, separators=(',', ':'))}")
                if len(lines) == BLOCK:
                    block()
        if lines:
            block()
        writer.close()
        if directory:
            path, _ = (index := _Writer(folder, ".dir")).write("\n".join(f"{o} {n} {k}" for k, o, n in directory).encode())
            index.close()
            row = [[directory[0][0]], [writer.path], [path]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in row], names=["first", "blocks", "directory"])

    table = written(ordered.mapInArrow(run, "first string, blocks string, directory string"), "parts")
    rows = sorted((r["first"].encode(), r["blocks"], r["directory"]) for r in table.collect())
    return Index(*map(tuple, zip(*rows, strict=True))) if rows else Index((), (), ())


# ------------------------------------------------------------------ reading


class Part:
    """One part of the index: its directory in memory, its blocks read when asked for."""

    def __init__(self, blocks: str, directory: str, reader: Reader) -> None:
        entries = [line.split(" ", 2) for line in reader.whole(directory).decode().split("\n")]
        self.places = [(int(offset), int(length)) for offset, length, _ in entries]
        self.keys = [key.encode() for _, _, key in entries]
        self.blocks, self.reader, self.last = blocks, reader, (-1, [])

    def _block(self, i: int) -> list[bytes]:
        if self.last[0] != i:
            self.last = i, zlib.decompress(self.reader.read(self.blocks, *self.places[i])).split(b"\n")
        return self.last[1]

    def find(self, key: bytes) -> Iterator[dict]:
        """Captures with exactly this key; they may run over several blocks."""
        i, prefix = max(0, bisect_left(self.keys, key) - 1), key + b" {"
        while i < len(self.keys) and self.keys[i] <= key:
            lines = self._block(i)
            for at in range(bisect_left(lines, prefix), len(lines)):
                if not lines[at].startswith(prefix):
                    break
                yield json.loads(lines[at][len(key) + 1 :])
            i += 1


def lookup(keys: DataFrame, index: Index) -> DataFrame:
    """Read the records of all captures under the given keys (column ``key``, each once) from the archives.

    A key without capture, and a null key, give no row. Keys are dealt to the parts of the index by range, so a task
    holds one directory at a time; a third of all captures under one address is many keys, one for each page id.
    """
    firsts = np.array(index.firsts, dtype=object)

    @F.pandas_udf("int")
    def part_of(key: pd.Series) -> pd.Series:
        return key.map(lambda k: max(0, bisect_right(firsts, k.encode()) - 1)).astype("int32")

    wanted = keys.select("key").filter("key is not null").distinct()
    wanted = wanted.withColumn("part", part_of("key")) if len(firsts) else wanted.limit(0).withColumn("part", F.lit(0))
    # A fixed number of partitions: a key is few bytes but a record to read, so sizes say little about the work.
    dealt = wanted.repartition(max(1, len(firsts)), "part").sortWithinPartitions("part", "key")
    names = [f.split()[0] for f in RECORDS.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, number, part = Reader(), -1, None
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for key, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if at != number:
                    number, part = at, Part(index.blocks[at], index.directories[at], reader)
                for capture in part.find(key.encode()):
                    found = parse(reader.read(capture["file"], capture["offset"], capture["length"]))
                    for column, name in zip(out, names, strict=True):
                        column.append(found[name])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    return dealt.mapInArrow(run, RECORDS)


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write the pages to archives in the shared folder, index them, and read every record back through the index."""
    folder = fresh_path(pages.sparkSession, "warc")
    captures = write_archives(pages, f"{folder}/records")
    index = build_index(captures, f"{folder}/index")
    return lookup(pages.select(capture_key(F.col("url"), F.col("page_id")).alias("key")), index)
