"""Places of rows in a global order, when one key may hold most rows.

Rows are range-partitioned by (keys, order), sorted inside partitions and written; a row's
place is its place in its partition plus what earlier partitions hold of its key. Only one
row for each key and partition meets a window. Rows that tie in everything are told apart
by where they were read, so ties split over partitions as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.session import written

_PART, _AT, _TIE = "_part", "_at", "_tie"


def range_sorted(df: DataFrame, keys: list[str], order: list[Column | str], write: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """``df`` written in ranges of (keys, order), with ``_part`` (the range's number) and ``_at`` (grows by one from row to row of a range)."""
    by = [*keys, *order, _TIE]
    rows = df.withColumn(_TIE, F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop(_TIE)
    rows = rows.withColumn(_AT, F.monotonically_increasing_id())
    return write(rows.withColumn(_PART, F.shiftright(_AT, 33)), "ordinals")


def with_ordinals(df: DataFrame, keys: list[str], order: list[Column | str], name: str = "ordinal", write: Callable[[DataFrame, str], DataFrame] = written, total: str | None = None) -> DataFrame:
    """``df`` with each row's place, from 0, among the rows of its keys (null is a key) by ``order``, and with ``total`` how many they are.

    An empty ``keys`` is one order over all rows.
    """
    rows = range_sorted(df, keys, order, write)
    held = rows.groupBy(_PART, *keys).agg(F.min(_AT).alias("_first"), F.count("*").alias("_n"))
    # a row for each range that a key has rows in: at most as many for a key as there are partitions
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    shift = held.select(F.col(_PART).alias("_p"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("_total"))
    same = F.col(_PART) == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(shift, same).select(*df.columns, (F.col(_AT) + F.col("_shift")).alias(name), *([F.col("_total").alias(total)] if total else []))


def in_blocks(df: DataFrame, keys: list[str], order: list[Column | str], behind: int, block: int = 8192) -> DataFrame:
    """``df`` with its ordinals cut into blocks, for frames that reach ``behind`` rows back: ``_ordinal``, ``_block`` and ``_halo``.

    The last rows of a block come a second time, marked as halo, before the next block's, so a
    window over (keys, ``_block``) by ``_ordinal`` sees all it needs. Drop the halo after it.
    """
    size = max(block, behind)
    rows = with_ordinals(df, keys, order, "_ordinal")
    at = F.floor(F.col("_ordinal") / size)
    places = F.when(F.col("_ordinal") % size >= size - behind, F.array(F.struct(at.alias("_block"), F.lit(False).alias("_halo")), F.struct((at + 1).alias("_block"), F.lit(True).alias("_halo")))).otherwise(F.array(F.struct(at.alias("_block"), F.lit(False).alias("_halo"))))
    return rows.select(*df.columns, "_ordinal", F.inline(places))
