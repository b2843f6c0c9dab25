"""Lines of blocked gzip files (``.bgz``), read by many tasks.

Such a file is a row of small gzip members that each say how long they are, so a task can
start at any of them. The driver reads member headers only; a partition is a range of
members of about ``PART_BYTES``. A line that straddles ranges belongs to the range that it
begins in: a task leaves out what comes before its first line end and reads on to the
next one.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCKED = (".bgz",)
PART_BYTES = 16_000_000
#: Lines of a batch.
BATCH = 20_000


def member_size(head: bytes) -> int:
    """Bytes of the gzip member that ``head`` begins: the extra field BC holds them, less one."""
    if head[:4] != b"\x1f\x8b\x08\x04":
        raise ValueError("not a member of a blocked gzip file")
    (extra,) = struct.unpack_from("<H", head, 10)
    at = 12
    while at < 12 + extra:
        tag, n = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if tag == b"BC" and n == 2:
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + n
    raise ValueError("a gzip member without its size")


@dataclass
class Range(InputPartition):
    path: str
    part: int
    start: int
    end: int
    #: Where the last member with text before the range begins and ends; none at the file's start.
    before: tuple[int, int] | None


class BlockedLines(DataSource):
    """``spark.read.format("blocked_lines").load(path)``: (part, line, value), parts and lines in the file's order."""

    @classmethod
    def name(cls) -> str:
        return "blocked_lines"

    def schema(self) -> str:
        return "part long, line long, value string"

    def reader(self, schema) -> DataSourceReader:
        return BlockedReader(self.options["path"], int(self.options.get("part_bytes", PART_BYTES)))


class BlockedReader(DataSourceReader):
    def __init__(self, path: str, part_bytes: int):
        self.path, self.part_bytes = path, part_bytes

    def partitions(self) -> list[Range]:
        store, path = pyarrow.fs.FileSystem.from_uri(self.path)
        cuts, at, last = [(0, None)], 0, None
        with store.open_input_file(path) as f:
            size = f.size()
            while at < size:
                f.seek(at)
                end = at + member_size(f.read(64))
                f.seek(end - 4)
                if f.read(4) != b"\0\0\0\0":  # how much text it holds
                    last = at, end
                at = end
                if at - cuts[-1][0] >= self.part_bytes or at >= size:
                    cuts.append((at, last))
        return [Range(self.path, i, a, b, last) for i, ((a, last), (b, _)) in enumerate(zip(cuts, cuts[1:]))]

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        lines, number = [], 0
        for line in self._lines(part):
            lines.append(line)
            if len(lines) == BATCH:
                yield _batch(part.part, number, lines)
                number, lines = number + len(lines), []
        if lines:
            yield _batch(part.part, number, lines)

    @staticmethod
    def _lines(part: Range) -> Iterator[bytes]:
        store, path = pyarrow.fs.FileSystem.from_uri(part.path)
        with store.open_input_file(path) as f:
            text = lambda a, b: (f.seek(a), zlib.decompress(f.read(b - a), 31))[1]
            size, at, held = f.size(), part.start, b""
            # whether the text at hand still belongs to a line that an earlier range began
            theirs = part.before is not None and not text(*part.before).endswith(b"\n")
            while at < size:
                if at >= part.end and (theirs or not held):
                    return
                f.seek(at)
                end = at + member_size(f.read(64))
                *whole, rest = (held + text(at, end)).split(b"\n")
                held = rest
                if theirs and whole:
                    whole, theirs = whole[1:], False
                if at >= part.end and whole:
                    yield whole[0]
                    return
                yield from whole
                at = end
            if held and not theirs:
                yield held


def _batch(part: int, number: int, lines: list[bytes]) -> pa.RecordBatch:
    n = len(lines)
    text = pa.array([x.removesuffix(b"\r") for x in lines], pa.binary()).cast(pa.string())
    return pa.record_batch([pa.array([part] * n, pa.int64()), pa.array(range(number, number + n), pa.int64()), text], names=["part", "line", "value"])


def read_blocked_lines(spark: SparkSession, path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """(part, line, value) of a blocked gzip file."""
    spark.dataSource.register(BlockedLines)
    return spark.read.format("blocked_lines").option("part_bytes", part_bytes).load(path)
