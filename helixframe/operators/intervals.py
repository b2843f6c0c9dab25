"""Unions of closed intervals by a sweep that is spread over tasks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.ordinals import range_sorted
from helixframe.session import written

_PART, _AT = "_part", "_at"


def _carried(df: DataFrame, keys: list[str], value: str, into: str) -> DataFrame:
    """(_part, keys, ``into``): the largest ``value`` that earlier ranges hold of each key; one row for each range and key."""
    held = df.groupBy(_PART, *keys).agg(F.max(value).alias("_v"))
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    return held.select(F.col(_PART).alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.max("_v").over(earlier).alias(into))


def _with(df: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    same = F.col(_PART) == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(carried, same, "left").drop("_p", *[f"_k{i}" for i in range(len(keys))])


def interval_union(df: DataFrame, keys: list[str], start: str, end: str, write: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """(keys, start, end): the disjoint closed intervals that cover what the intervals of each key cover.

    Intervals that share a position become one; those that only lie next to each other
    don't. Intervals with a null or with end < start cover nothing. Rows are put in order
    in ranges; each range starts with the largest end that earlier ranges of its key have
    reached, so no key is walked in one task.
    """
    rows = range_sorted(df.select(*keys, start, end).filter(F.col(start) <= F.col(end)), keys, [start, end], write)
    inside = Window.partitionBy(_PART, *keys).orderBy(_AT)
    before = F.greatest("_carry", F.max(end).over(inside.rowsBetween(Window.unboundedPreceding, -1)))  # greatest skips nulls
    at = _with(rows, _carried(rows, keys, end, "_carry"), keys).withColumn("_begin", F.when(before.isNull() | (F.col(start) > before), F.col(start)))
    at = at.withColumn("_last", F.max("_begin").over(inside.rowsBetween(Window.unboundedPreceding, 0))).drop("_carry")
    begun = _carried(at, keys, "_begin", "_earlier")
    named = _with(at, begun, keys).select(*keys, F.coalesce("_last", "_earlier").alias("_start"), F.col(end))
    return named.groupBy(*keys, "_start").agg(F.max(end).alias(end)).select(*keys, F.col("_start").alias(start), end)
