"""Counts, means, ranges and centred products of groups, that can be merged and taken away.

Rows come as chunks: one record holds some hundred rows of a group as arrays, so a chunk
is a matrix product and nothing is sent for each row. Products are taken about the
group's own mean, which a first pass finds, so they add up over chunks without loss.
Matrices wider than ``BLOCK`` are made as a two-dimensional grid of blocks: a task holds
two column blocks of some chunks and makes one block of the product.

Merging adds what separates the means and never cancels. Taking away subtracts, and is
only as exact as what is left is large: where a column keeps less than ``GUARD`` of its
centred energy, ``risky`` says so, and the caller merges the parts that stay instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of a block of a product, rows and bytes of a chunk, chunks that a block's task multiplies together.
BLOCK, CHUNK_ROWS, CHUNK_BYTES, TOGETHER = 1024, 512, 16_000_000, 4
#: The share of a column's centred energy below which a difference isn't trusted.
GUARD = 1e-4


@dataclass
class Moments:
    """n rows: their mean, their range by column, and their products about the mean (or, as a vector, its diagonal)."""

    n: float
    mean: np.ndarray
    c: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def _apart(self, gap: np.ndarray) -> np.ndarray:
        return gap * gap if self.c.ndim == 1 else np.outer(gap, gap)

    def merge(self, other: Moments) -> Moments:
        n = self.n + other.n
        gap = other.mean - self.mean
        c = self.c + other.c + self._apart(gap) * (self.n * other.n / n)
        return Moments(n, self.mean + gap * (other.n / n), c, np.minimum(self.low, other.low), np.maximum(self.high, other.high))

    def without(self, part: Moments) -> Moments:
        """What is left of these rows without ``part`` of them; the range stays as it was."""
        n = self.n - part.n
        if n < 0.5:
            return Moments(0.0, self.mean, self.c * 0, self.low, self.high)
        gap = part.mean - self.mean
        return Moments(n, self.mean - gap * (part.n / n), self.c - part.c - self._apart(gap) * (self.n * part.n / n), self.low, self.high)

    def risky(self, whole: Moments) -> np.ndarray:
        """Columns of a difference that kept so little of ``whole`` that it can't be trusted."""
        mine, all_of_it = (m.c if m.c.ndim == 1 else np.diag(m.c) for m in (self, whole))
        return (whole.high > whole.low) & (mine <= GUARD * all_of_it)


def chunked(rows: DataFrame, by: list[str], width: int, carried: list[str], counts: DataFrame) -> DataFrame:
    """(by, chunk, carried as arrays, x): rows' vectors ``all`` end to end, ``width`` each; ``counts`` has (by, _n)."""
    per = max(1, min(CHUNK_ROWS, CHUNK_BYTES // (8 * max(width, 1))))
    at = rows.join(counts, by).withColumn("chunk", F.pmod(F.xxhash64(*carried), F.ceil(F.col("_n") / per)).cast("int"))
    held = at.groupBy(*by, "chunk").agg(F.collect_list(F.struct(*carried, "all")).alias("_s"))
    return held.select(*by, "chunk", *[F.col(f"_s.{c}").alias(c) for c in carried], F.flatten("_s.all").alias("x"))


def matrix(batch: pa.RecordBatch, i: int, y: str | None = "y") -> np.ndarray:
    """Chunk ``i`` of a batch as rows and columns, with ``y`` as the last column."""
    x = batch.column("x")[i].values.to_numpy(zero_copy_only=False)
    target = batch.column(y)[i].values.to_numpy(zero_copy_only=False)
    return np.column_stack((x.reshape(len(target), -1), target))


def _keys(batch: pa.RecordBatch, by: list[str]) -> list[tuple]:
    return list(zip(*[batch.column(k).to_pylist() for k in by]))


def _frame(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _schema(df: DataFrame, by: list[str], rest: list[tuple[str, str]]) -> tuple[str, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    types = dict(df.dtypes)
    text = ", ".join([*(f"{k} {types[k]}" for k in by), *(f"{k} {t}" for k, t in rest)])
    return text, to_arrow_schema(_parse_datatype_string(text))


def means(chunks: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, mean, low, high) of the columns of (x, y)."""
    text, schema = _schema(chunks, by, [("n", "long"), ("total", "array<double>"), ("low", "array<double>"), ("high", "array<double>")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, key in enumerate(_keys(batch, by)):
                a = matrix(batch, i)
                out.append((*key, len(a), a.sum(axis=0), a.min(axis=0), a.max(axis=0)))
            if out:
                yield _frame(schema, out)

    parts = chunks.select(*by, "x", "y").mapInArrow(run, text)
    cells = parts.select(*by, "n", F.posexplode(F.arrays_zip("total", "low", "high")).alias("at", "c"))
    cells = cells.groupBy(*by, "at").agg(F.sum("n").alias("n"), (F.sum("c.total") / F.sum("n")).alias("mean"), F.min("c.low").alias("low"), F.max("c.high").alias("high"))
    each = cells.groupBy(*by).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "mean", "low", "high"))).alias("c"))
    return each.select(*by, "n", *[F.col(f"c.{k}").alias(k) for k in ("mean", "low", "high")])


def _summed(parts: DataFrame, by: list[str]) -> DataFrame:
    """Blocks ``c`` added up by ``by``, one after the other: a task holds the sum and one block."""
    text, schema = _schema(parts, by, [("c", "binary")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for batch in batches:
            for k, c in zip(_keys(batch, by), batch.column("c")):
                c = np.frombuffer(c.as_buffer())
                if total is not None and k == key:
                    total += c
                else:
                    if total is not None:
                        yield _frame(schema, [(*key, total.tobytes())])
                    key, total = k, c.copy()
        if total is not None:
            yield _frame(schema, [(*key, total.tobytes())])

    return parts.select(*by, "c").repartition(*by).sortWithinPartitions(*by).mapInArrow(run, text)


def products(chunks: DataFrame, centres: DataFrame, by: list[str], width: int) -> DataFrame:
    """(by, c): the flat ``width`` x ``width`` matrix of products of (x, y) about the means that ``centres`` has."""
    grid = -(-width // BLOCK)
    cut = [slice(b * BLOCK, min(width, (b + 1) * BLOCK)) for b in range(grid)]
    joined = chunks.select(*by, "chunk", "x", "y").join(centres.select(*by, "mean"), by)
    if grid == 1:
        text, schema = _schema(chunks, by, [("c", "binary")])

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple, np.ndarray] = {}
            for batch in batches:
                for i, key in enumerate(_keys(batch, by)):
                    a = matrix(batch, i) - batch.column("mean")[i].values.to_numpy(zero_copy_only=False)
                    sums[key] = sums.get(key, 0.0) + a.T @ a
                if len(sums) * width * width * 8 > 64_000_000:
                    yield _frame(schema, [(*k, c.tobytes()) for k, c in sums.items()])
                    sums = {}
            if sums:
                yield _frame(schema, [(*k, c.tobytes()) for k, c in sums.items()])

        return _summed(joined.mapInArrow(whole, text), by)
    cell = [*by, "some", "bi", "bj"]
    text, schema = _schema(chunks, by, [("some", "int"), ("bi", "int"), ("bj", "int"), ("a", "binary"), ("b", "binary")])

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, key in enumerate(_keys(batch, by)):
                a = matrix(batch, i) - batch.column("mean")[i].values.to_numpy(zero_copy_only=False)
                parts = [np.ascontiguousarray(a[:, s]).tobytes() for s in cut]
                for bi in range(grid):
                    for bj in range(bi, grid):
                        yield _frame(schema, [(*key, batch.column("chunk")[i].as_py() // TOGETHER, bi, bj, parts[bi], None if bi == bj else parts[bj])])

    types = dict(chunks.dtypes)
    product_schema = ", ".join([*(f"{k} {types[k]}" for k in by), "some int, bi int, bj int, c binary"])

    def product(rows: pd.DataFrame) -> pd.DataFrame:
        bi, bj = int(rows["bi"].iloc[0]), int(rows["bj"].iloc[0])
        wi, wj = (cut[b].stop - cut[b].start for b in (bi, bj))
        total = 0.0
        for a, b in zip(rows["a"], rows["b"]):
            a = np.frombuffer(a).reshape(-1, wi)
            total = total + a.T @ (a if b is None else np.frombuffer(b).reshape(-1, wj))
        return pd.DataFrame([(*(rows[k].iloc[0] for k in cell), total.tobytes())], columns=[*cell, "c"])

    blocks = _summed(joined.mapInArrow(slices, text).groupBy(*cell).applyInPandas(product, product_schema), [*by, "bi", "bj"])
    whole_schema = ", ".join([*(f"{k} {types[k]}" for k in by), "c binary"])

    def assemble(rows: pd.DataFrame) -> pd.DataFrame:
        c = np.zeros((width, width))
        for bi, bj, part in zip(rows["bi"], rows["bj"], rows["c"]):
            part = np.frombuffer(part).reshape(cut[bi].stop - cut[bi].start, -1)
            c[cut[bi], cut[bj]] = part
            c[cut[bj], cut[bi]] = part.T
        return pd.DataFrame([(*(rows[k].iloc[0] for k in by), c.tobytes())], columns=[*by, "c"])

    return blocks.groupBy(*by).applyInPandas(assemble, whole_schema)


FIELDS = [("n", "long"), ("mean", "array<double>"), ("low", "array<double>"), ("high", "array<double>"), ("var", "array<double>"), ("c", "binary")]


def moments(chunks: DataFrame, by: list[str], width: int, write: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(by, n, mean, low, high, var, c) of the columns of (x, y), ``width`` of them; ``var`` is the diagonal of ``c``."""
    centres = write(means(chunks, by), "means")
    text, schema = _schema(chunks, by, FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                var = np.diag(np.frombuffer(batch.column("c")[i].as_buffer()).reshape(width, width))
                columns = [batch.column(k).slice(i, 1) for k in (*by, "n", "mean", "low", "high")]
                yield pa.RecordBatch.from_arrays([*[c.cast(f.type) for c, f in zip(columns, schema)], pa.array([var], schema.field("var").type), batch.column("c").slice(i, 1)], schema=schema)

    return write(centres.join(products(chunks, centres, by, width), by).select(*by, "n", "mean", "low", "high", "c").mapInArrow(run, text), "moments")


def read(batch: pa.RecordBatch, i: int, prefix: str = "", diagonal: bool = False) -> Moments | None:
    """The moments in row ``i``, from columns that ``prefix`` begins; None where they are null."""
    n = batch.column(f"{prefix}n")[i].as_py()
    if n is None:
        return None
    get = lambda k: batch.column(f"{prefix}{k}")[i].values.to_numpy(zero_copy_only=False)
    mean = get("mean")
    c = get("var") if diagonal else np.frombuffer(batch.column(f"{prefix}c")[i].as_buffer()).reshape(len(mean), len(mean))
    return Moments(float(n), mean, c, get("low"), get("high"))


def merged(parts: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Moments of the rows of all parts of each ``by``, merged one after the other in ``order``."""
    text, arrow = _schema(parts, by, FIELDS)

    def row(key: tuple, m: Moments) -> pa.RecordBatch:
        return _frame(arrow, [(*key, int(round(m.n)), m.mean, m.low, m.high, np.diag(m.c), np.ascontiguousarray(m.c).tobytes())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for batch in batches:
            for i, k in enumerate(_keys(batch, by)):
                part = read(batch, i)
                if total is not None and k == key:
                    total = total.merge(part)
                else:
                    if total is not None:
                        yield row(key, total)
                    key, total = k, part
        if total is not None:
            yield row(key, total)

    held = parts.select(*dict.fromkeys([*by, *order]), "n", "mean", "low", "high", "c")
    return held.repartition(*by).sortWithinPartitions(*dict.fromkeys([*by, *order])).mapInArrow(run, text)
