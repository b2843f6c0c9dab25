"""Sorting by priority, paging, best rows of groups, shared-draw resampling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.ranks import places


def by_priority(column: Column, order: list) -> Column:
    """A sort key: the place of the value in ``order``, others last."""
    out = None
    for i, v in enumerate(order):
        out = F.when(column == v, i) if out is None else out.when(column == v, i)
    return out.otherwise(len(order))


def first_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows in order; 0 means all."""
    out = df.orderBy(*order)
    return out.limit(n) if n else out


def page_of_keys(df: DataFrame, key: list[str], ordinal: str, offset: int, limit: int) -> DataFrame:
    """All rows of the keys at places [offset, offset + limit) in first-seen order; limit 0 means to the end.

    Only the page's keys are ranked in one place: sorting finds the first offset + limit.
    """
    seen = df.groupBy(*key).agg(F.min(ordinal).alias("_first"))
    chosen = seen.orderBy("_first").offset(offset)
    if limit:
        chosen = chosen.limit(limit)
    return df.join(chosen.select(*key), key, "left_semi")


def best_of_group(df: DataFrame, keys: list[str], priority: list[Column], ordinal: str) -> DataFrame:
    """The row of highest priority of each group; the first row wins ties."""
    w = Window.partitionBy(*keys).orderBy(*[p.desc_nulls_last() for p in priority], F.col(ordinal).asc())
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def head_groups(df: DataFrame, partition: list[str], group: str, k: int) -> DataFrame:
    """Rows of the first ``k`` groups of each partition, by the number in the group's name."""
    number = F.regexp_extract(F.col(group), r"(\d+)", 1).cast("int")
    groups = df.select(*partition, group).distinct().withColumn("_n", F.row_number().over(Window.partitionBy(*partition).orderBy(number, group)))
    return df.join(groups.filter(F.col("_n") <= k).drop("_n"), [*partition, group], "left_semi")


def top_labels(df: DataFrame, key: str, metrics: list[tuple[str, str]], k: int, order_ties: list[str] | None = None) -> DataFrame:
    """Keys in the top ``k`` of any metric (metric, label), with the labels joined by ``;``. NULLs never rank.

    Each metric's top k is one sort-and-limit; equal values go by key.
    """
    parts = [df.filter(F.col(m).isNotNull()).orderBy(F.col(m).desc(), *(order_ties or [key])).limit(k).select(key, F.lit(i).alias("_i"), F.lit(label).alias("_label")) for i, (m, label) in enumerate(metrics)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_label"))), lambda x: x["_label"]), ";").alias("labels"))


def every_kth(df: DataFrame, group: str, k: int) -> DataFrame:
    """Rows whose group's place in sorted order is a multiple of ``k``; no window holds all groups."""
    return df.join(places(df.filter(F.col(group).isNotNull()), group).filter(F.col("place") % k == 0).select(group), group, "left_semi")


def draws(n_groups: int, n_draws: int, seed: int) -> np.ndarray:
    """Group indexes of each draw, the same for every comparison."""
    return np.random.default_rng(seed).integers(0, n_groups, (n_draws, n_groups))


def bootstrap_interval(stats: DataFrame, draw_table: DataFrame, keys: list[str], group_index: str = "group_idx", total: str = "total", count: str = "count", ci: tuple[float, float] = (0.025, 0.975)) -> DataFrame:
    """Percentile intervals of the macro and weighted means of groups under shared draws.

    ``stats`` has sufficient statistics by key and group; ``draw_table`` (draw, slot,
    group_idx) is small and the same for all keys.
    """
    # a group drawn several times counts as often: one row for each (draw, group)
    times = draw_table.groupBy("draw", group_index).agg(F.count("*").alias("_times"))
    each = stats.join(times, group_index).groupBy(*keys, "draw").agg(
        (F.sum(F.col("_times") * F.col(total) / F.col(count)) / F.sum("_times")).alias("macro"),
        (F.sum(F.col("_times") * F.col(total)) / F.sum(F.col("_times") * F.col(count))).alias("weighted"),
    )
    q = F.array(*[F.lit(x) for x in ci])
    out = each.groupBy(*keys).agg(F.percentile("macro", q).alias("_m"), F.percentile("weighted", q).alias("_w"), F.count("*").alias("draws"))
    return out.select(*keys, "draws", F.col("_m")[0].alias("macro_low"), F.col("_m")[1].alias("macro_high"), F.col("_w")[0].alias("weighted_low"), F.col("_w")[1].alias("weighted_high"))


def interpretation(low: Column, high: Column) -> Column:
    return F.when(high < 0, "below zero").when(low > 0, "above zero").otherwise("includes zero")


def capped_points(df: DataFrame, stage: list[str], channel: str, point: str, max_channels: int = 16, max_points: int = 4) -> DataFrame:
    """Of each stage the first ``max_channels`` channels in order, and the first ``max_points`` points of all of those."""
    channels = df.select(*stage, channel).distinct().withColumn("_c", F.row_number().over(Window.partitionBy(*stage).orderBy(channel)))
    kept = df.join(channels.filter(F.col("_c") <= max_channels).drop("_c"), [*stage, channel], "left_semi")
    w = Window.partitionBy(*stage).orderBy(channel, point)
    return kept.withColumn("_p", F.row_number().over(w)).filter(F.col("_p") <= max_points).drop("_p")
