"""Explosions, pivots, unions with a tag, set comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def positions_around(df: DataFrame, centre: str, radius: int, into: str = "position") -> DataFrame:
    """One row for each position no farther than ``radius`` from ``centre``."""
    return df.withColumn(into, F.explode(F.sequence(F.col(centre) - radius, F.col(centre) + radius)))


def alternative_bases(df: DataFrame, ref: str, into: str = "alt") -> DataFrame:
    """One row for each base that isn't the reference's."""
    return df.withColumn(into, F.explode(F.filter(F.array(*map(F.lit, "ACGT")), lambda b: b != F.col(ref))))


def split_rows(df: DataFrame, column: str, separator: str, into: str, place: str | None = None) -> DataFrame:
    """One row for each entry of a delimited list, with its 1-based place if asked for."""
    parts = F.split(column, separator)
    if place is None:
        return df.withColumn(into, F.explode(parts))
    return df.select("*", F.posexplode(parts).alias(place, into)).withColumn(place, F.col(place) + 1)


def tagged_union(frames: dict[str, DataFrame], tag: str = "dataset") -> DataFrame:
    """All frames, with the union of their columns and a column that names the frame."""
    out = None
    for name, df in frames.items():
        df = df.withColumn(tag, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def heat_map(df: DataFrame, rows: list[str], column: str, values: list, cell) -> DataFrame:
    """Wide form: one column for each of ``values``, fixed beforehand so the pivot needs no extra pass."""
    return df.groupBy(*rows).pivot(column, values).agg(cell)


def set_comparison(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """One row: distinct keys of either side only, of both, and whether the sets are equal, disjoint or nested.

    One aggregation by key over both sides; no join.
    """
    tagged = left.select(*key, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(right.select(*key, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    by = tagged.groupBy(*key).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    out = by.agg(
        F.count_if((F.col("_l") == 1) & (F.col("_r") == 0)).alias("left_only"),
        F.count_if((F.col("_l") == 0) & (F.col("_r") == 1)).alias("right_only"), F.count_if((F.col("_l") == 1) & (F.col("_r") == 1)).alias("both"),
    )
    return out.select("*", ((F.col("left_only") == 0) & (F.col("right_only") == 0)).alias("equal"), (F.col("both") == 0).alias("disjoint"), (F.col("left_only") == 0).alias("left_in_right"))
