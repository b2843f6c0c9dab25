"""Small helpers for Arrow batches inside tasks."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

#: About how many bytes of text a task turns into Python objects at a time.
CHUNK_BYTES = 4_000_000


#: Rows of an Arrow batch of texts, where the session doesn't set a number: Spark's own 10,000 could be gigabytes of long texts.
BATCH_ROWS = 2000


def texts_of(docs: DataFrame) -> DataFrame:
    """``docs``, in a session whose Arrow batches are small enough for texts."""
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key, None) is None:
        conf.set(key, str(BATCH_ROWS))
    return docs


def release() -> None:
    """Give freed memory back: a Python worker outlives its tasks, and the next stage shares the executor with it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def text_chunks(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about ``most`` bytes of text each; a longer text comes alone."""
    release()  # what the worker's last task has left
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        if batch.num_rows == 0:
            continue
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        part = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
    release()


def long_column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)
