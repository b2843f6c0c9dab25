"""Token ids in files of independent zstandard frames, as a Spark data source.

A file is, in this order:

* data frames: the ids of documents end to end, little-endian unsigned 32-bit, cut at
  document ends once a frame holds ``FRAME_IDS`` of them; a longer document is cut inside.
  Each frame carries zstandard's content checksum;
* a skippable frame with the documents' index: doc_id, whether it is null, number of ids;
* a skippable frame with the seek table of the zstandard seekable format: for each frame
  its compressed and its decompressed size and the low 32 bits of the XXH64 of its content.

Any zstandard tool decompresses a file to its ids. A reader takes the seek table from the
end of the file and decompresses the frames that hold what it wants, checking both sums.

Writing takes rows in ascending doc_id order, one range for each task (``write_ids`` makes
them so); each task writes a file of its own under a new name. The driver lists the files
of tasks that succeeded in ``manifest.json``, which appears whole by a rename: files of
lost or repeated attempts are in no manifest. The driver sees one line for each file.

Reading a folder gives (doc_id, start, n_tokens, ids): ``start`` counts the ids of all
documents before. With the option ``doc_ids`` (a JSON list) only these documents are read:
files are left out by their ranges, frames by the index. Null doc_ids come first. Rows of one doc_id stay together. A null
text has the end id alone. An empty table gives a manifest without files.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from helixframe.llm.batches import text_chunks, texts_of
from helixframe.llm.bytebpe import TOKENIZER, encoder

# fixed values of the zstandard formats
SKIPPABLE_MAGIC = 0x184D2A50
SEEK_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

#: Ids after which a frame ends, at the next document's end or here at the latest.
FRAME_IDS = 65_536
#: About how many bytes of ids a reader yields at a time.
BATCH_BYTES = 4_000_000
END_ID = 2
SCHEMA = "doc_id long, start long, n_tokens long, ids binary"


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store that ``path`` (a URI or an absolute path) is in, and the path there."""
    return pyarrow.fs.FileSystem.from_uri(path)


def checksum(content: bytes) -> int:
    return xxhash.xxh64_intdigest(content) & 0xFFFFFFFF


class FrameWriter:
    """Writes one file; ``add`` takes documents in order."""

    def __init__(self, sink, level: int = 3):
        self.sink, self.table, self.held, self.size = sink, [], [], 0
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.doc_ids, self.counts = [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids))
        for at in range(0, len(ids), FRAME_IDS):
            part = ids[at : at + FRAME_IDS]
            self.held.append(part)
            self.size += len(part)
            if self.size >= FRAME_IDS:
                self._flush()

    def _flush(self) -> None:
        if self.size:
            content = np.concatenate(self.held).astype("<u4").tobytes()
            frame = self.compressor.compress(content)
            self.sink.write(frame)
            self.table.append((len(frame), len(content), checksum(content)))
            self.held, self.size = [], 0

    def _skippable(self, magic: int, content: bytes) -> int:
        self.sink.write(struct.pack("<II", magic, len(content)) + content)
        return 8 + len(content)

    def close(self) -> None:
        self._flush()
        null = np.array([d is None for d in self.doc_ids], np.uint8)
        ids = np.array([d or 0 for d in self.doc_ids], "<i8")
        index = struct.pack("<Q", len(ids)) + ids.tobytes() + null.tobytes() + np.array(self.counts, "<u8").tobytes()
        self.table.append((self._skippable(SKIPPABLE_MAGIC, self.compressor.compress(index)), 0, checksum(b"")))
        entries = b"".join(struct.pack("<III", *entry) for entry in self.table)
        self._skippable(SEEK_MAGIC, entries + struct.pack("<IBI", len(self.table), CHECKSUM_FLAG, SEEKABLE_MAGIC))


class FrameReader:
    """Reads one file by its seek table; ``source`` can seek."""

    def __init__(self, source, size: int):
        self.source, self.decompressor = source, zstandard.ZstdDecompressor()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("no seek table with checksums at the end of the file")
        table = self._at(size - 9 - 12 * n, 12 * n)
        self.packed, self.plain, self.sums = np.frombuffer(table, "<u4").reshape(-1, 3).T.astype(np.int64)
        self.places = np.cumsum(self.packed) - self.packed
        self.ends = np.cumsum(self.plain) // 4  # ids up to each frame's end
        index = self.decompressor.decompress(self._at(self.places[-1] + 8, self.packed[-1] - 8))
        (m,) = struct.unpack_from("<Q", index)
        self.null = np.frombuffer(index, np.uint8, m, 8 + 8 * m).astype(bool)
        self.doc_ids, self.counts = np.frombuffer(index, "<i8", m, 8), np.frombuffer(index, "<u8", m, 8 + 9 * m).astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.decompressed, self._last = 0, (-1, b"")

    def _at(self, place: int, n: int) -> bytes:
        self.source.seek(int(place))
        return self.source.read(int(n))

    def frame(self, i: int) -> bytes:
        """The content of frame ``i``; the last one is kept."""
        if self._last[0] != i:
            content = self.decompressor.decompress(self._at(self.places[i], self.packed[i]))
            if len(content) != self.plain[i] or checksum(content) != self.sums[i]:
                raise ValueError(f"frame {i} isn't what was written")
            self._last, self.decompressed = (i, content), self.decompressed + 1
        return self._last[1]

    def document(self, at: int) -> bytes:
        """The ids of the document at place ``at`` of the file."""
        a, b = int(self.starts[at]), int(self.starts[at] + self.counts[at])
        parts, i = [], int(np.searchsorted(self.ends, a, side="right"))
        while a < b:
            first, last = int(self.ends[i] - self.plain[i] // 4), min(b, int(self.ends[i]))
            parts.append(self.frame(i)[4 * (a - first) : 4 * (last - first)])
            a, i = last, i + 1
        return b"".join(parts)


@dataclass
class WrittenFile(WriterCommitMessage):
    """What a task's file holds."""

    task: int
    name: str
    ids: int
    documents: int
    first: list
    last: list


def _place(doc_id: int | None) -> list:
    return [doc_id is not None, doc_id or 0]


class TokenFrames(DataSource):
    """``spark.read.format("token_frames").load(folder)`` and ``df.write.format("token_frames").mode("append").save(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "token_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TokenReader(self.options["path"], self.options.get("doc_ids"))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return TokenWriter(self.options["path"], int(self.options.get("level", "3")))


class TokenWriter(DataSourceArrowWriter):
    def __init__(self, path: str, level: int):
        self.path, self.level = path, level

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WrittenFile:
        store, folder = file_system(self.path)
        name, file, sink, first, last, total = f"ids-{uuid.uuid4().hex}.zst", None, None, None, None, 0
        for batch in iterator:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                if file is None:
                    store.create_dir(folder, recursive=True)
                    sink = store.open_output_stream(f"{folder}/{name}", compression=None)
                    file, first, last = FrameWriter(sink, self.level), _place(doc_id), _place(doc_id)
                if _place(doc_id) < last:
                    raise ValueError("rows must come in ascending doc_id order")
                last, body = _place(doc_id), np.frombuffer(ids.as_buffer() or b"", "<u4")
                file.add(doc_id, body)
                total += len(body)
        if file is None:
            return WrittenFile(0, "", 0, 0, [], [])
        file.close()
        sink.close()
        return WrittenFile(TaskContext.get().partitionId(), name, total, len(file.counts), first, last)

    def commit(self, messages: list) -> None:
        files, base = sorted((m for m in messages if m.documents), key=lambda m: m.task), 0
        if any(a.last > b.first for a, b in zip(files, files[1:])):
            raise ValueError("tasks must hold ascending ranges of doc_id")
        listed = []
        for m in files:
            listed.append({"name": m.name, "base": base, "ids": m.ids, "documents": m.documents, "first": m.first, "last": m.last})
            base += m.ids
        store, folder = file_system(self.path)
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/manifest.json.tmp") as out:
            out.write(json.dumps({"files": listed}).encode())
        store.move(f"{folder}/manifest.json.tmp", f"{folder}/manifest.json")

    def abort(self, messages: list) -> None:
        store, folder = file_system(self.path)
        for m in messages:
            if m is not None and m.documents:
                store.delete_file(f"{folder}/{m.name}")


@dataclass
class FilePart(InputPartition):
    name: str
    base: int


class TokenReader(DataSourceReader):
    def __init__(self, path: str, doc_ids: str | None):
        self.path, self.wanted = path, None if doc_ids is None else sorted(json.loads(doc_ids))

    def partitions(self) -> list[FilePart]:
        store, folder = file_system(self.path)
        with store.open_input_file(f"{folder}/manifest.json") as f:
            files = json.loads(f.read())["files"]
        if self.wanted is not None:
            files = [x for x in files if any(x["first"] <= _place(d) <= x["last"] for d in self.wanted)]
        return [FilePart(x["name"], x["base"]) for x in files]

    def read(self, part: FilePart | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # what Spark asks for where there are no parts
            return
        store, folder = file_system(self.path)
        path = f"{folder}/{part.name}"
        with store.open_input_file(path) as source:
            file = FrameReader(source, source.size())
            chosen = np.arange(len(file.counts)) if self.wanted is None else np.flatnonzero(~file.null & np.isin(file.doc_ids, self.wanted))
            share = np.cumsum(file.counts[chosen] * 4) // BATCH_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), len(chosen)]
            for a, b in zip(cuts, cuts[1:]):
                at = chosen[a:b]
                ids = pa.array([file.document(i) for i in at.tolist()], pa.binary())
                columns = [pa.array(file.doc_ids[at], mask=file.null[at]), pa.array(part.base + file.starts[at]), pa.array(file.counts[at]), ids]
                yield pa.record_batch(columns, names=["doc_id", "start", "n_tokens", "ids"])


def register(spark: SparkSession) -> None:
    """Make the format known to the session."""
    spark.dataSource.register(TokenFrames)


def encoded(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids) for each row of ``docs``, in its order: the text's ids and the end id, as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for chunk in text_chunks(batches):
            found = encode.ids(chunk.column(1))
            ends = found.start + found.count
            body = np.insert(found.ids, ends, np.uint32(end_id))
            cuts = np.concatenate(([0], ends + np.arange(1, len(ends) + 1))) * 4
            ids = pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(body.astype("<u4"))])
            yield pa.record_batch([chunk.column(0), ids], names=["doc_id", "ids"])

    return texts_of(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def write_ids(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> None:
    """The texts' ids in files below ``path``, in ascending doc_id order; a file for each range of doc_ids.

    Ranges split rows of one doc_id (or none) by where they were read, so the files stay even.
    """
    by = ["doc_id", "_tie"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_tie", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by).select("doc_id", "text")
    register(docs.sparkSession)
    encoded(rows, tokenizer, end_id).write.format("token_frames").mode("append").save(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of what ``write_ids`` wrote below ``path``."""
    register(spark)
    return spark.read.format("token_frames").load(path)


def documents_of(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of ``read_ids`` of some documents; only the frames that hold them are decompressed."""
    register(spark)
    return spark.read.format("token_frames").option("doc_ids", json.dumps([int(x) for x in doc_ids])).load(path)
