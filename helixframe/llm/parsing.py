"""Document fingerprints by locally consistent parsing.

A text is a sequence of symbols. Deterministic coin tossing compares each symbol's name
with its left neighbour's and keeps the lowest differing bit, a few times over, until
names are smaller than six; a local minimum of these small names starts a phrase. Where
phrases start depends on a few neighbours only, so equal substrings are cut alike in
their interior wherever they stand. A phrase is named by a hash of its symbols, and the
names are the symbols of the next level. Runs of one symbol are a phrase of their own.

The fingerprint is the name of the whole text followed by a sketch: phrases of the
sketch levels are dealt into bins by name and occurrence, and each bin keeps its smallest.
Two sketches' likeness is the Dice share that their agreeing bins estimate, 0 to 1.

Null text counts as empty. Empty texts have equal fingerprints and likeness 1 to each
other, 0 to any other text. Rows with a null doc_id come first in the order of
documents. Rows of one doc_id follow each other by their texts' hashes. One document alone is its own
next document. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.batches import texts_of
from helixframe.llm.storage import written

BINS, SKETCH_LEVELS = 64, (2, 3)
EMPTY_BIN = 0xFFFF


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _toss(name: np.ndarray, first: np.ndarray) -> np.ndarray:
    """2 * (lowest bit that differs from the left neighbour) + that bit; a text's first symbol keeps bit 0."""
    left = np.empty_like(name)
    left[1:] = name[:-1]
    left[0] = 0
    diff = name ^ left
    one = diff.dtype.type(1)
    low = diff & (~diff + one)
    at = np.bitwise_count(low - one)
    bit = ((name & low) != 0).astype(np.uint8)
    out = (2 * at + bit).astype(np.uint8)
    out[first] = (name[first] & one).astype(np.uint8)
    return out


def _starts(name: np.ndarray, text_start: np.ndarray) -> np.ndarray:
    """Where phrases start. ``name`` has no equal neighbours inside a text."""
    small = _toss(name, text_start)
    # 64-bit names become < 128, then < 14, < 8, < 6
    for _ in range(3):
        small = _toss(small, text_start)
    cut = np.zeros(len(name), bool)
    cut[1:-1] = (small[1:-1] < small[:-2]) & (small[1:-1] <= small[2:])
    # a text's first symbol starts a phrase; its second and last ones don't, whatever text stands beside it
    cut[(text_start + 1)[text_start + 1 < len(cut)]] = False
    cut[text_start[1:] - 1] = False
    cut[text_start] = True
    return np.flatnonzero(cut)


def _named(symbol: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A 64-bit name for each phrase, from its symbols in order."""
    size = np.diff(np.concatenate((start, [len(symbol)])))
    place = (np.arange(len(symbol)) - np.repeat(start, size)).astype(np.uint64)
    mixed = _mix(symbol.astype(np.uint64) + (place + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    return _mix(np.add.reduceat(mixed, start) + size.astype(np.uint64))


def _level(symbol: np.ndarray, text_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next level's symbols and where its texts start. Runs of one symbol are taken together first."""
    new = np.ones(len(symbol), bool)
    new[1:] = symbol[1:] != symbol[:-1]
    new[text_start] = True
    at = np.flatnonzero(new)
    if len(at) < len(symbol):
        size = np.diff(np.concatenate((at, [len(symbol)])))
        run = symbol[at].astype(np.uint64)
        symbol = np.where(size > 1, _mix(run + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), run)
        text_start = np.searchsorted(at, text_start)
    start = _starts(symbol, text_start)
    return _named(symbol, start), np.searchsorted(start, text_start)


def _occurrence(owner: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """How often a text has had each symbol before: repeats count as often as they stand there."""
    order = np.lexsort((symbol, owner))
    o, s = owner[order], symbol[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (s[1:] != s[:-1])
    at = np.arange(len(o))
    out = np.empty(len(o), np.uint64)
    out[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return out


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    body = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    return body, np.fromiter(map(len, texts), np.int64, len(texts))


def sketches(texts: list[str], bins: int = BINS, levels: tuple[int, ...] = SKETCH_LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """(name of each whole text, its bins as uint16) for many texts at once."""
    body, size = _code_points(texts)
    root = np.zeros(len(texts), np.uint64)
    bin_of = np.full((len(texts), bins), EMPTY_BIN, np.uint16)
    real = np.flatnonzero(size)
    if not len(real):
        return root, bin_of
    symbol, start = body, (np.cumsum(size) - size)[real]
    best = np.full(len(texts) * bins, np.uint64(2**64 - 1))
    named = np.zeros(len(real), bool)
    level = 0
    while True:  # each level at least halves what isn't one symbol yet
        level += 1
        symbol, start = _level(symbol, start)
        if level in levels:
            owner = np.repeat(real, np.diff(np.concatenate((start, [len(symbol)]))))
            key = _mix(symbol + np.uint64(level) + _occurrence(owner, symbol) * np.uint64(0x9E3779B97F4A7C15))
            np.minimum.at(best, owner * bins + (key >> np.uint64(40)).astype(np.int64) % bins, key & np.uint64(0xFFFFFFFFFF))
        whole = np.diff(np.concatenate((start, [len(symbol)]))) == 1
        fresh = whole & ~named
        root[real[fresh]] = _mix(symbol[start[fresh]] + size[real[fresh]].astype(np.uint64))
        named |= whole
        if level >= max(levels) and named.all():
            break
    full = best != np.uint64(2**64 - 1)
    flat = bin_of.reshape(-1)
    flat[full] = np.minimum(_mix(best[full]) & np.uint64(0xFFFF), EMPTY_BIN - 1).astype(np.uint16)
    return root, bin_of


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dice share of two rows of bins: 1 for equal ones, two empty texts included."""
    full = (a != EMPTY_BIN) | (b != EMPTY_BIN)
    same = ((a == b) & full).sum(axis=1)
    total = full.sum(axis=1)
    j = np.where(total > 0, same / np.maximum(total, 1), 1.0)
    return 2 * j / (1 + j)


def fingerprint_strings(root: np.ndarray, bins: np.ndarray) -> list[str]:
    """The whole text's name and its bins, in hexadecimal."""
    tail = bins.astype(">u2").tobytes().hex()
    width = 4 * bins.shape[1]
    return [f"{r:016x}{tail[i * width : (i + 1) * width]}" for i, r in enumerate(root.tolist())]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by the start of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _compared(ids: list, texts: list[str]) -> pa.RecordBatch:
    """Results of all texts but the last, each next to its follower."""
    own, nxt = texts[:-1], texts[1:]
    changed = [edited(a, b) for a, b in zip(own, nxt)]
    root, bins = sketches(texts)
    e_root, e_bins = sketches(changed)
    columns = [
        pa.array(ids[:-1], pa.int64()), pa.array([len(t) for t in own], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in changed]),
        pa.array(fingerprint_strings(root[:-1], bins[:-1]), pa.string()), pa.array(fingerprint_strings(e_root, e_bins), pa.string()),
        pa.array(likeness(bins[:-1], e_bins)), pa.array(likeness(bins[:-1], bins[1:])),
    ]
    return pa.record_batch(columns, names=[f.split()[0] for f in RESULT.split(", ")])


def neighbour_fingerprints(docs: DataFrame, chunk_chars: int = 1_000_000) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next document's are.

    Documents are range-partitioned by doc_id and sorted; a task walks its documents in
    order. A partition's last document needs the first of the next partition that has any:
    only these two texts of each partition take a second step.
    """
    rows = texts_of(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranged = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    names = [f.split()[0] for f in RESULT.split(", ")]
    out_schema = f"{RESULT}, part int, edge int, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def done(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = batch.num_rows
            return pa.record_batch([*batch.columns, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())], names=[*names, "part", "edge", "text"])

        def edge(doc_id: int | None, text: str, which: int) -> pa.RecordBatch:
            blank = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
            return pa.record_batch([pa.array([doc_id], pa.int64()), *blank, pa.array([part], pa.int32()), pa.array([which], pa.int32()), pa.array([text], pa.string())], names=[*names, "part", "edge", "text"])

        ids, texts, chars, first = [], [], 0, True
        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if first:
                    yield edge(d, t, 0)
                    first = False
                ids.append(d)
                texts.append(t)
                chars += len(t)
                if chars > chunk_chars and len(ids) > 1:
                    yield done(_compared(ids, texts))
                    ids, texts, chars = ids[-1:], texts[-1:], len(texts[-1])
        if len(ids) > 1:
            yield done(_compared(ids, texts))
        if ids:
            yield edge(ids[-1], texts[-1], 1)

    found = written(ranged.mapInArrow(run, out_schema), "fingerprints")
    inside = found.filter("edge is null").select(*names)
    edges = found.filter("edge is not null")
    # which partitions have documents: a number for each, a few thousand at the most
    parts = sorted(r["part"] for r in edges.filter("edge = 0").select("part").collect())
    if not parts:
        return inside
    follows = docs.sparkSession.createDataFrame([(p, q) for p, q in zip(parts, [*parts[1:], parts[0]])], "part int, next_part int")
    heads = edges.filter("edge = 0").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    pairs = edges.filter("edge = 1").select("part", "doc_id", "text").join(follows, "part").join(heads, "next_part").select("doc_id", "text", "next_text")

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                yield _compared([d, None], [a, b])

    return inside.unionByName(pairs.mapInArrow(last, RESULT))
