"""A session with the settings that the operators' semantics rest on."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a repeated key in a delimited list keeps its last value
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def session(master: str | None = None, **more: str) -> SparkSession:
    """A session with ``SETTINGS``; ``master`` and ``more`` as the caller needs."""
    builder = SparkSession.builder.appName("helixframe").config(map=SETTINGS | more)
    return (builder.master(master) if master else builder).getOrCreate()


def table(spark: SparkSession, folder: str, name: str):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares; a temporary one only where none is set and all tasks run in the driver's process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        found = tempfile.gettempdir()
    return f"{found.rstrip('/')}/helixframe-{name}-{uuid.uuid4().hex}"


def rename(spark: SparkSession, path: str, target: str, overwrite: bool) -> bool:
    """Move a file in one step, in any store that Spark reaches: over what ``target`` holds, or else False where it holds anything."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    a, b = (jvm.org.apache.hadoop.fs.Path(x) for x in (path, target))
    a, b = (x.makeQualified(fs.getUri(), fs.getWorkingDirectory()) for x in (a, b) for fs in (x.getFileSystem(conf),))
    kinds = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kinds, 1)
    options[0] = kinds.OVERWRITE if overwrite else kinds.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(b.toUri(), conf).rename(a, b, options)
    except Py4JJavaError as failed:
        if overwrite or "FileAlreadyExists" not in str(failed.java_exception):
            raise
        return False
    return True


#: Folders and tables in the shared folder that this process has made and not deleted.
_LIVE: set[str] = set()


def kept(path: str) -> str:
    """``path``, to be deleted by ``clear`` or at the end of the process."""
    _LIVE.add(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table in the shared folder: a lost executor costs a re-read of it, not what led to it."""
    path = kept(scratch(df.sparkSession, name))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Delete what ``scratch`` paths hold, once results that read them are written; returns how many."""
    paths = sorted(_LIVE)
    for path in paths:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
        _LIVE.discard(path)
    return len(paths)


@atexit.register
def _clear_at_exit() -> None:
    spark = SparkSession._instantiatedSession
    if _LIVE and spark is not None and spark.sparkContext._jsc is not None:
        clear(spark)
