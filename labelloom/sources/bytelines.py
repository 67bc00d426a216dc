"""Lines of text files by fixed byte ranges, as a batch table and as a stream over growing files.

A line belongs to the range that its first byte is in. Ranges depend on a file's size alone,
so two scans of a file agree on them, and counts per range number the lines without a copy.
The stream keeps a byte offset per file, always behind a line feed: a last line that is still
being written waits for a later batch, and a restart goes on where the offsets say.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from labelloom.sources.session import ship_package

FORMAT = "byte_lines"
SCHEMA = "path string, range_start bigint, place bigint, at bigint, value string"
ARROW = pa.schema(
    [("path", pa.string()), ("range_start", pa.int64()), ("place", pa.int64()), ("at", pa.int64()), ("value", pa.string())]
)
RANGE_BYTES = 64 << 20
# Small files share a task: its ranges hold this much at least, an open file counting as some bytes,
# unless so many tasks share a scan that each has work to do.
LEAST_TASK_BYTES = 1 << 20
OPEN_BYTES = 64 << 10
TASKS_PER_CORE = 4
# Bytes read at once, within a range or while looking for a line's end.
CHUNK = 4 << 20


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    stop: int


@dataclass
class Ranges(InputPartition):
    """Ranges that one task reads one after another."""

    parts: list[ByteRange]


def packed(parts: list[ByteRange], tasks: int, most: int) -> list[Ranges]:
    """Neighbouring ranges together, about as many groups as ``tasks``, none much above ``most`` bytes."""
    cost = lambda p: p.stop - p.start + OPEN_BYTES
    room = min(max(most, 1), max(LEAST_TASK_BYTES, sum(map(cost, parts)) // max(tasks, 1)))
    out, taken = [], 0
    for p in parts:
        if not out or taken + cost(p) > room:
            out.append(Ranges([]))
            taken = 0
        out[-1].parts.append(p)
        taken += cost(p)
    return out


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """File system of a path, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _sizes(root: str, glob: str) -> dict[str, int]:
    """Size of each file below a folder, or of the one file; hidden names and folders are left out."""
    system, place = open_path(root)
    info = system.get_file_info(place)
    if info.type == fs.FileType.NotFound:
        return {}
    if info.type == fs.FileType.File:
        return {root: info.size}
    out, cut = {}, len(place.rstrip("/"))
    for file in system.get_file_info(fs.FileSelector(place, recursive=True)):
        names = file.path[cut:].strip("/").split("/")
        if file.type == fs.FileType.File and not any(n[0] in "._" for n in names) and fnmatch.fnmatch(names[-1], glob):
            out[root.rstrip("/") + "/" + "/".join(names)] = file.size
    return out


def _whole_lines(path: str, start: int, stop: int) -> int:
    """Offset behind the last line feed between two offsets, or ``start``; reads from the end."""
    system, place = open_path(path)
    with system.open_input_file(place) as file:
        while stop > start:
            low = max(start, stop - CHUNK)
            at = file.read_at(stop - low, low).rfind(b"\n")
            if at >= 0:
                return low + at + 1
            stop = low
    return start


def _cut(path: str, start: int, stop: int, size: int) -> list[ByteRange]:
    return [ByteRange(path, at, min(at + size, stop)) for at in range(start, stop, size)]


def _batch(path: str, start: int, place: int, ats: list[int], values: list[bytes]) -> pa.RecordBatch:
    n = len(values)
    texts = [v.removesuffix(b"\r").decode("utf-8", "replace") for v in values]
    same = [pa.repeat(pa.scalar(path, pa.string()), n), pa.repeat(pa.scalar(start, pa.int64()), n)]
    columns = [pa.array(c, f.type) for c, f in zip([range(place, place + n), ats, texts], list(ARROW)[2:], strict=True)]
    return pa.RecordBatch.from_arrays([*same, *columns], schema=ARROW)


def read_range(part: ByteRange, first: int = 0) -> Iterator[pa.RecordBatch]:
    """Lines that start in a range; ``first`` is where reading of the file began.

    A line feed ends a line, a carriage return before it goes with it, and the end of the file
    ends the last one. Bytes that are no UTF-8 become replacement characters.
    """
    system, place = open_path(part.path)
    with system.open_input_file(place) as file:
        size, at = file.size(), part.start
        if at > first:
            # the line that the byte before the range is in belongs to an earlier range
            at = _next_line(file, at - 1, min(part.stop, size))
        rest, number = b"", 0
        while at < part.stop:
            data = file.read_at(CHUNK, at + len(rest))
            block = rest + data
            ended = at + len(block) >= size or not data
            lines = block.split(b"\n")
            tail = lines.pop()
            if ended and tail:
                lines.append(tail)
                tail = b""
            ats, values = [], []
            for line in lines:
                if at >= part.stop:
                    break
                ats.append(at)
                values.append(line)
                at += len(line) + 1
            if values:
                yield _batch(part.path, part.start, number, ats, values)
                number += len(values)
            if ended:
                return
            rest = tail


def _next_line(file, at: int, limit: int) -> int:
    """Offset behind the first line feed from ``at`` on, or ``limit`` if there is none before it."""
    while at < limit:
        data = file.read_at(min(CHUNK, limit - at), at)
        if not data:
            return limit
        found = data.find(b"\n")
        if found >= 0:
            return at + found + 1
        at += len(data)
    return limit


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.roots = options["path"].split("\n")
        self.glob = options.get("glob", "*")
        self.size = int(options.get("rangebytes", RANGE_BYTES))
        self.tasks = int(options.get("tasks", 1))

    def partitions(self) -> list[InputPartition]:
        parts = []
        for root in self.roots:
            system, place = open_path(root)
            if system.get_file_info(place).type == fs.FileType.NotFound:
                raise FileNotFoundError(root)
            for path, size in sorted(_sizes(root, self.glob).items()):
                parts += _cut(path, 0, size, self.size)
        return packed(parts, self.tasks, RANGE_BYTES) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for part in partition.parts:
            yield from read_range(part)


class _TailReader(_Reader, DataSourceStreamReader):
    """Offsets are {path: byte}; files that did not grow cost one listing."""

    known: dict[str, int] | None = None

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        offsets = dict(self.known or {})
        for root in self.roots:
            for path, size in _sizes(root, self.glob).items():
                if size > offsets.get(path, 0):
                    offsets[path] = _whole_lines(path, offsets.get(path, 0), size)
        self.known = {path: at for path, at in offsets.items() if at}
        return self.known

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        parts = []
        for path in sorted(end):
            parts += [_Grown(p.path, p.start, p.stop, start.get(path, 0)) for p in _cut(path, start.get(path, 0), end[path], self.size)]
        return parts or [_Grown("", 0, 0, 0)]

    def read(self, partition: _Grown) -> Iterator[pa.RecordBatch]:
        return read_range(partition, partition.first) if partition.path else iter([])

    def commit(self, end: dict) -> None:
        pass


@dataclass
class _Grown(ByteRange):
    first: int


class ByteLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options)

    def streamReader(self, schema: StructType) -> _TailReader:
        return _TailReader(self.options)


def _prepared(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(ByteLines)


def read_byte_lines(spark: SparkSession, path: str, glob: str = "*", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, range_start, place in the range from 0, byte offset ``at`` and value of all lines below a folder."""
    _prepared(spark)
    reader = spark.read.format(FORMAT).option("glob", glob).option("rangebytes", range_bytes)
    return reader.option("tasks", TASKS_PER_CORE * spark.sparkContext.defaultParallelism).load(path)


def tail_lines(spark: SparkSession, path: str, glob: str = "*", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Stream of the same columns over files that grow; whole lines only."""
    _prepared(spark)
    return spark.readStream.format(FORMAT).option("glob", glob).option("rangebytes", range_bytes).load(path)
