"""CSV, JSON and Parquet tables with explicit schemas, literal relations, listings of files."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions.vectors import valid_series


def read_csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV table with a header. Empty cells are NULL; a byte-order mark is no part of the first name.

    ``columns`` is a whitelist: nothing else leaves the reader, so a column that must not
    be used cannot be.
    """
    df = spark.read.csv(path, schema=schema, header=True, nullValue="", emptyValue="", enforceSchema=False, mode="FAILFAST")
    if columns is None:
        return df
    out = df.select(*columns)
    if out.columns != columns:
        raise ValueError(f"columns are {out.columns}, not {columns}")
    return out


def truth(c: Column) -> Column:
    """A boolean written as True or False."""
    return F.when(c.isNotNull(), c == "True")


def read_json_documents(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One row for each file, however many lines it has."""
    return spark.read.json(path, schema=schema, multiLine=True)


def list_files(spark: SparkSession, folder: str, pattern: str = "*", content: bool = False) -> DataFrame:
    """(path, name, stem, extension, bytes, modified[, sha256]) of files below a folder."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    name = F.substring_index("path", "/", -1)
    out = reader.select(
        "path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.regexp_extract(name, r"\.([^.]*)$", 1).alias("extension"),
        F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), *([F.sha2("content", 256).alias("sha256")] if content else []),
    )
    return out


def complete_stems(listing: DataFrame, extensions: list[str]) -> DataFrame:
    """Stems that have a file with every one of the extensions."""
    return listing.filter(F.col("extension").isin(extensions)).groupBy("stem").agg(F.count_distinct("extension").alias("n")).filter(F.col("n") == len(extensions)).select("stem")


def literal(spark: SparkSession, rows: list[tuple], schema: str, explode: str | None = None) -> DataFrame:
    """A relation written in code; ``explode`` is a list column to have one row for each entry of."""
    df = spark.createDataFrame(rows, schema)
    return df.withColumn(explode, F.explode(explode)) if explode else df


def read_series(spark: SparkSession, path: str, key: str, series: list[str], length: int) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid) rows of a table of arrays: the length, finite, in range (distances at most 2)."""
    df = spark.read.parquet(path)
    high = {"cosine_distance": 2.0, "changed_dimension_fraction": 1.0}
    ok = F.lit(True)
    for s in series:
        ok = ok & valid_series(F.col(s), length, 0.0, high.get(s))
    return df.filter(ok), df.filter(~ok).select(key)


def wait_until(done: Callable[[], bool], seconds: float = 30.0, limit: float | None = None, sleep: Callable[[float], None] = time.sleep) -> bool:
    """Poll a status until it is complete; False once ``limit`` seconds have gone by."""
    waited = 0.0
    while not done():
        if limit is not None and waited >= limit:
            return False
        sleep(seconds)
        waited += seconds
    return True
