"""Intermediate tables in the folder that the whole cluster shares.

A written Parquet table cuts the lineage: a lost executor costs a re-read of the
table, never a recomputation of what led to it.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary one only where none is set and all tasks run in the driver's process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        found = tempfile.mkdtemp(prefix="helixframe-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


#: Tables this process has written and not yet dropped.
_LIVE: set[str] = set()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that ``clear`` deletes."""
    path = f"{shared_dir(spark)}/helixframe-{name}-{uuid.uuid4().hex}"
    _LIVE.add(path)
    return path


class Written:
    """A table written to the shared folder; ``df`` reads it, ``drop`` deletes it."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = new_path(self.spark, name)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        _delete(self.spark, self.path)


def _delete(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
    _LIVE.discard(path)


def live() -> frozenset[str]:
    """The paths of the intermediate tables that this process has written and not dropped."""
    return frozenset(_LIVE)


def clear(spark: SparkSession, but: frozenset[str] = frozenset()) -> int:
    """Delete the intermediate tables of this process, once results that read them are written, other than ``but``; returns how many."""
    paths = sorted(_LIVE - but)
    for path in paths:
        _delete(spark, path)
    return len(paths)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table that lives as long as the shared folder does."""
    return Written(df, name).df
