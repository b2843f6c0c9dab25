"""Periodic runs of words in texts, and texts without the repeats.

A run is a stretch of words with smallest period q (words q apart are equal) and at
least ``max(least, exponent * q)`` words that no neighbouring word extends. Runs come
from ``tandem.runs``. Only stretches that could hold one go there: inside a run every
sequence of three words comes again within q words, so a run leaves a streak of such
places behind. Streaks are found for q up to 1, 2, 4, ... at once, for all texts of a
chunk; no run is lost by it, and most prose has none. A stretch that was met before in
the task is not parsed again.

Nothing is shuffled: a text's runs depend on it alone. A null text has no words, no runs
and an empty collapsed text. Rows may repeat, share a doc_id or have none; each is judged
by its own text. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.batches import text_chunks, texts_of
from helixframe.llm.substring import cut_words
from helixframe.llm.tandem import runs

LEAST, EXPONENT = 6, 4
_NEVER = np.iinfo(np.int64).max
#: Words in the stretches whose runs a task remembers, about.
KEPT = 100_000
RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _next_same(symbol: np.ndarray, end: np.ndarray, gram: int) -> np.ndarray:
    """How many places on the ``gram`` symbols from each place come again in the same text."""
    code = symbol.astype(np.int64)
    for j in range(1, gram):
        code = code[:-1] * (int(symbol.max()) + 1) + symbol[j:]
        if j + 1 < gram:
            code = np.unique(code, return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    here, there = order[:-1], order[1:]
    same = (code[here] == code[there]) & (there + gram <= end[here])
    out = np.full(len(symbol), _NEVER)
    out[here[same]] = (there - here)[same]
    return out


def _least_streak(low: int, high: int, gram: int, least: int, exponent: int) -> int:
    """The fewest places that a run of a period from ``low`` to ``high`` leaves."""
    turn = min(max(-(-least // exponent), low), high)
    return min(max(least, exponent * q) - q - gram + 1 for q in {low, high, turn, max(low, turn - 1)})


def stretches(symbol: np.ndarray, sizes: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of disjoint stretches that hold every run of the texts whose symbols are laid end to end."""
    if len(symbol) < 3:
        return (np.zeros(0, np.int64),) * 2
    end = np.repeat(np.cumsum(sizes), sizes)
    near = {1: _next_same(symbol, end, 1), 3: _next_same(symbol, end, 3)}
    begins, ends, high = [], [], 1
    while high // 2 + 1 <= sizes.max() // exponent:
        low = high // 2 + 1
        gram = 3 if high > 2 and _least_streak(low, high, 3, least, exponent) > 0 else 1
        edge = np.diff(np.concatenate(([0], near[gram] <= high, [0])).astype(np.int8))
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        enough = b - a >= _least_streak(low, high, gram, least, exponent)
        a, b = a[enough], b[enough]
        begins.append(a)
        ends.append(np.minimum(b - 1 + high + gram, end[a]))
        high *= 2
    if not begins:
        return (np.zeros(0, np.int64),) * 2
    a, b = np.concatenate(begins), np.concatenate(ends)
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order]) if len(a) else b
    first = np.concatenate(([True], a[1:] >= b[:-1])) if len(a) else np.zeros(0, bool)
    return a[first], np.maximum.reduceat(b, np.flatnonzero(first)) if len(a) else b


class _Finder:
    """Runs of stretches; those of the last ones are remembered."""

    def __init__(self, least: int, exponent: int):
        self.least, self.exponent, self.held, self.words = least, exponent, OrderedDict(), 0

    def __call__(self, symbol: np.ndarray) -> list[tuple[int, int, int]]:
        _, first, plain = np.unique(symbol, return_index=True, return_inverse=True)
        named = np.argsort(np.argsort(first))[plain].astype(np.int32)  # by first place, so equal stretches are equal here
        key = named.tobytes()
        if key not in self.held:
            self.held[key] = [r for r in runs(named.tolist()) if r[1] >= max(self.least, self.exponent * r[2])]
            self.words += len(named)
            while self.words > KEPT and len(self.held) > 1:
                self.words -= len(self.held.popitem(last=False)[0]) // 4
        self.held.move_to_end(key)
        return self.held[key]


def found_runs(symbol: np.ndarray, sizes: np.ndarray, finder: _Finder) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of each text's runs, by start and period."""
    out, starts = [[] for _ in sizes], np.cumsum(sizes) - sizes
    a, b = stretches(symbol, sizes, finder.least, finder.exponent)
    row = np.searchsorted(starts + sizes, a, side="right")
    for r, x, y in zip(row.tolist(), a.tolist(), b.tolist()):
        at = x - int(starts[r])
        out[r] += [(at + s, n, q) for s, n, q in finder(symbol[x:y])]
    return [sorted(x) for x in out]


def repeated_tails(sizes: np.ndarray, doc_ids: list[int | None]) -> np.ndarray:
    """For each word, which word to take instead, so that the tails of a tenth of the texts repeat.

    With h the crc32 of the decimal doc_id and g = h // 10: where 10 divides h, word i of n
    from a = g % n on is word a + (i - a) % p, with p = 1 + (n - a) // (3 + g % 8).
    """
    out, starts = np.arange(int(sizes.sum())), np.cumsum(sizes) - sizes
    for start, n, d in zip(starts.tolist(), sizes.tolist(), doc_ids):
        if d is None or n == 0:
            continue
        g, rest = divmod(zlib.crc32(str(d).encode()), 10)
        if rest == 0:
            a = g % n
            out[start + a : start + n] = start + a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return out


def periodic_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT, repeat_tails: bool = False) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for each row of ``docs``.

    ``collapsed`` is the text's words, joined by one space, without those that some run
    holds after its first period. ``repeat_tails`` plants repeats first (``repeated_tails``).
    """
    if exponent < 2 or least < 2:
        raise ValueError("a run has at least two periods and two words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _Finder(least, exponent)
        for chunk in text_chunks(batches):
            words, sizes = cut_words(chunk.column(1))
            coded = words.dictionary_encode()
            symbol = coded.indices.to_numpy(zero_copy_only=False)
            if repeat_tails:
                symbol = symbol[repeated_tails(sizes, chunk.column(0).to_pylist())]
            found, starts = found_runs(symbol, sizes, finder), np.cumsum(sizes) - sizes
            drop = np.zeros(len(symbol) + 1, np.int32)
            flat = np.array([(s + r[0], *r) for s, some in zip(starts.tolist(), found) for r in some], np.int64).reshape(-1, 4)
            np.add.at(drop, flat[:, 0] + flat[:, 3], 1)
            np.add.at(drop, flat[:, 0] + flat[:, 2], -1)
            kept = np.cumsum(drop[:-1]) == 0
            ends = np.concatenate(([0], np.cumsum(kept)))[np.concatenate(([0], np.cumsum(sizes)))]
            left = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), coded.dictionary.take(pa.array(symbol[kept])))
            held = pa.StructArray.from_arrays([pa.array(flat[:, j], pa.int64()) for j in (1, 2, 3)], names=["start", "length", "period"])
            each = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in found]))), pa.int32()), held)
            yield pa.record_batch([chunk.column(0), pa.array(sizes, pa.int64()), each, pc.binary_join(left, " ").cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return texts_of(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RUNS)


def digests(found: DataFrame) -> DataFrame:
    """One row for each of ``periodic_runs``: how many runs, the longest one (ties: smallest start, then period), and digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    rows = found.select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.period")
    return rows.select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(length * 1000 / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words",
    )
