"""mbox archives by byte range, as a Spark data source.

A range of a file yields the messages whose separator begins in it: their offset and their header section. Bodies are passed
over chunk by chunk and never held, so a task needs memory for one chunk and one header section, however large a message is.
Ranges can be planned, committed and resumed at any byte. Files are looked at before they are read: what does not begin with
a separator, or would be decompressed on the way, is refused.

Paths are opened with pyarrow's file systems (local and shared folders, s3, gs, abfs, hdfs).
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sparkmail.functions.mbox_headers import parse_headers

SEPARATOR = b"From "
_NEXT = b"\n" + SEPARATOR
_HEAD_END = re.compile(rb"\n(?:\r?\n|From )")  # a blank line or the next separator, whichever comes first
CHUNK = 4 << 20  # bytes read at a time
TILE = 64 << 20  # bytes of a file that one task scans
HEAD_BYTES = 64 << 20  # a longer header section makes its message malformed
FIRST_BYTES = 64 << 10  # of a file that its fingerprint covers
BATCH_ROWS, BATCH_BYTES = 8192, 8 << 20  # of the rows handed to Spark at once
PROBES = 16  # files looked at side by side
# Endings of files that Spark and Hadoop decompress.
COMPRESSED = (".gz", ".gzip", ".bz2", ".zst", ".zstd", ".lz4", ".snappy", ".deflate", ".xz", ".lzo", ".z", ".zip")

SCHEMA = "file string, start_offset long, head binary, too_long boolean"


@dataclass
class Archive:
    """What a look at a file gives. `refused` says why it is no archive, None if it is one."""

    file: str
    size: int
    mtime: int
    fingerprint: str | None
    refused: str | None


def _uri(path: str) -> str:
    """A path as pyarrow spells it."""
    path = re.sub(r"^s3[an]://", "s3://", path)
    return re.sub(r"^file:/+", "file:///", path) if path.startswith("file:") else path


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in (uri := _uri(path)):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), path


def _look(system: fs.FileSystem, info: fs.FileInfo, name: str) -> Archive:
    """Five bytes of a file tell whether to read more of it."""
    size, mtime, refused, fingerprint = info.size, int((info.mtime_ns or 0) // 1_000_000_000), None, None
    if name.lower().endswith(COMPRESSED):
        refused = "compressed"
    else:
        with system.open_input_stream(info.path, compression=None) as stream:
            first = stream.read(len(SEPARATOR))
            if first != SEPARATOR:
                refused = "no separator"
            else:
                first += stream.read(FIRST_BYTES - len(first))
                fingerprint = f"{size}:{mtime}:{hashlib.sha256(first).hexdigest()[:16]}"
    return Archive(name, size, mtime, fingerprint, refused)


def archives(path: str) -> list[Archive]:
    """The files of a folder, or one file, by name. Hidden ones and empty ones are left out, as Spark's readers do."""
    system, place = _open(path)
    root = system.get_file_info(place)
    if root.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    infos = [root] if root.is_file else system.get_file_info(fs.FileSelector(place))
    files = sorted((i for i in infos if i.is_file and i.size and i.base_name[0] not in "._"), key=lambda i: i.path)
    prefix = "" if root.is_file else path.rstrip("/") + "/"
    with ThreadPoolExecutor(PROBES) as pool:
        return list(pool.map(lambda i: _look(system, i, prefix + i.base_name if prefix else path), files))


def joint_fingerprint(found: list[Archive]) -> str | None:
    """The fingerprint of one archive, or of several: their size, newest time, and a hash over all fingerprints."""
    if len(found) < 2:
        return found[0].fingerprint if found else None
    every = hashlib.sha256("\n".join(a.fingerprint for a in found).encode()).hexdigest()[:16]
    return f"{sum(a.size for a in found)}:{max(a.mtime for a in found)}:{every}"


class _Window:
    """A moving part of a stream, searched by absolute offset."""

    def __init__(self, stream: BinaryIO, start: int):
        self.stream, self.base, self.data, self.over = stream, start, b"", False
        stream.seek(start)

    @property
    def end(self) -> int:
        return self.base + len(self.data)

    def more(self, keep: int) -> bool:
        """Read on, and forget what is before `keep`."""
        got = self.stream.read(CHUNK)
        self.over = not got
        past = min(max(0, keep - self.base), len(self.data))
        self.data, self.base = self.data[past:] + got, self.base + past
        return not self.over

    def find(self, what: bytes, start: int) -> int | None:
        place = self.data.find(what, max(0, start - self.base))
        return None if place < 0 else self.base + place

    def head_end(self, start: int) -> int | None:
        """One pass that stops at the first end: what a file never holds is not looked for in the rest of the window."""
        found = _HEAD_END.search(self.data, max(0, start - self.base))
        return found and self.base + found.start()


def messages(stream: BinaryIO, start: int, stop: int) -> Iterator[tuple[int, bytes, bool]]:
    """(offset, header section, whether it was cut) of the messages whose separator begins in start..stop.

    The section starts behind the separator and ends before the first blank line or the next separator.
    """
    window = _Window(stream, max(0, start - 1))
    at = window.base  # where the line end before the next separator may be
    while start == 0 and window.end < len(SEPARATOR) and window.more(0):
        pass
    at_start = start == 0 and window.data.startswith(SEPARATOR) and stop > 0
    while True:
        if at_start:
            offset, head, at_start = 0, len(SEPARATOR), False
        else:
            found = window.find(_NEXT, at)
            if found is None:
                if window.end - len(_NEXT) + 2 > stop:
                    return
                at = max(at, window.end - len(_NEXT) + 1)
                if not window.more(at):
                    return
                continue
            offset, head = found + 1, found + len(_NEXT)
            if offset >= stop:
                return
        seen = head
        while True:
            end = window.head_end(seen)
            if end is not None or window.over or window.end - head > HEAD_BYTES:
                break
            seen = max(head, window.end - len(_NEXT) + 1)
            window.more(offset)
        at = window.end if end is None else end
        too_long = at - head > HEAD_BYTES
        yield offset, window.data[head - window.base:min(at, head + HEAD_BYTES) - window.base], too_long


@dataclass
class Range(InputPartition):
    file: str
    start: int
    stop: int


def tiles(ranges: list[Range], size: int = TILE) -> list[Range]:
    """Ranges cut into pieces for one task each."""
    return [Range(r.file, a, min(a + size, r.stop)) for r in ranges for a in range(r.start, r.stop, size)]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.ranges = [Range(*r) for r in json.loads(options["ranges"])]
        self.size = int(options.get("tile", TILE))

    def partitions(self) -> list[Range]:
        return tiles(self.ranges, self.size) or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.stop <= part.start:
            return
        system, place = _open(part.file)
        rows, size = [], 0
        with system.open_input_file(place) as stream:
            for row in messages(stream, part.start, part.stop):
                rows.append(row)
                size += len(row[1])
                if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield _rows(part.file, rows)
                    rows, size = [], 0
        if rows:
            yield _rows(part.file, rows)


def _rows(file: str, rows: list[tuple[int, bytes, bool]]) -> pa.RecordBatch:
    offsets, heads, cut = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array([file] * len(rows)), pa.array(offsets, pa.int64()), pa.array(heads, pa.binary()), pa.array(cut)],
        names=["file", "start_offset", "head", "too_long"])


class MboxRanges(DataSource):
    """`spark.read.format("mbox_ranges")` with the option `ranges`, a JSON list of [file, start, stop]."""

    @classmethod
    def name(cls) -> str:
        return "mbox_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class Progress:
    """What tasks have scanned so far, summed up on the driver as they end: messages, and bytes between them."""

    def __init__(self, spark: SparkSession):
        self.messages, self.bytes = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def reset(self) -> None:
        self.messages.value = self.bytes.value = 0


def _counting(messages, size):
    """Rows as they are; their number and the bytes they span are added up. A task run again is counted again."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets = batch.column("start_offset")
            messages.add(len(batch))
            size.add(offsets[-1].as_py() - offsets[0].as_py() if len(batch) else 0)
            yield batch

    return run


def read_ranges(spark: SparkSession, ranges: list[Range], tile: int = TILE, watch: Progress | None = None) -> DataFrame:
    """file, start_offset, bad, message_id, from_, return_path of the messages that begin in the ranges."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package
    spark.dataSource.register(MboxRanges)
    plan = json.dumps([[r.file, r.start, r.stop] for r in ranges])
    rows = spark.read.format("mbox_ranges").option("ranges", plan).option("tile", str(tile)).load()
    if watch is not None:
        rows = rows.mapInArrow(_counting(watch.messages, watch.bytes), SCHEMA)
    parsed = rows.select("file", "start_offset", "too_long", parse_headers(F.col("head").cast("string")).alias("h"))
    return parsed.select("file", "start_offset", (F.col("h.bad") | F.col("too_long")).alias("bad"),
                         "h.message_id", "h.from_", "h.return_path")


def resume_at(archive: Archive, done: dict[str, tuple[str, int]]) -> int:
    """Where to go on in a file: behind what is committed, if the file is still the same, else at its start."""
    fingerprint, offset = done.get(archive.file, (None, 0))
    return min(offset, archive.size) if fingerprint == archive.fingerprint and offset > 0 else 0


def plan_batches(found: list[Archive], done: dict[str, tuple[str, int]], batch_bytes: int,
                 max_files: int | None = None) -> list[list[Range]]:
    """The bytes that are left, file by file, in batches of up to batch_bytes and max_files files."""
    batches, room = [[]], batch_bytes
    for archive in found:
        at = resume_at(archive, done)
        while at < archive.size:
            if not room or max_files and len(batches[-1]) >= max_files:
                batches.append([])
                room = batch_bytes
            stop = min(archive.size, at + room)
            batches[-1].append(Range(archive.file, at, stop))
            room -= stop - at
            at = stop
    return [b for b in batches if b]
