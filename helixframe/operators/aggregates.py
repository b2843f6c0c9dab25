"""Exact distribution summaries, macro metrics, ranks and conditional counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.ordinals import in_blocks, with_ordinals
from helixframe.operators.ranks import below, join_same, percentiles


def unpivot(df: DataFrame, keys: list[str], metrics: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    """Long form: one row for each key and metric."""
    return df.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(keys, metrics, name, value)


def distribution_summary(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """n, median, p90, p99 and maximum by keys and metric, exact with linear interpolation; NULL values don't count."""
    long = unpivot(df, keys, metrics).filter("value is not null")
    by = [*keys, "metric"]
    sums = long.groupBy(*by).agg(F.count("*").alias("n"), F.max("value").alias("maximum"))
    q = percentiles(long, by, "value", [0.5, 0.9, 0.99], ["median", "p90", "p99"])
    return join_same(sums, q, by).select(*by, "n", "median", "p90", "p99", "maximum")


def describe(df: DataFrame, column: str, keys: list[str] = []) -> DataFrame:
    """n, mean, median, minimum and maximum; NULLs but for n when there is nothing."""
    long = df.select(*keys, F.col(column).cast("double").alias("_v"))
    sums = long.groupBy(*keys).agg(F.count("_v").alias("n"), F.avg("_v").alias("mean"), F.min("_v").alias("minimum"), F.max("_v").alias("maximum"))
    return join_same(sums, percentiles(long, keys, "_v", [0.5], ["median"]), keys, "left").select(*keys, "n", "mean", "median", "minimum", "maximum")


def counts_by_label(df: DataFrame, label: Column, conditions: dict[str, Column]) -> DataFrame:
    """How many rows of each label meet each condition."""
    return df.groupBy(label.alias("label")).agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in conditions.items()])


def metric_bundle(df: DataFrame, keys: list[str], group: str, truth: str, prediction: str, ranked: bool = False) -> DataFrame:
    """n, MAE, macro MAE (mean of the groups' MAEs), RMSE; with ``ranked`` also the rank correlation, NULL where a side is constant, and whether it is defined.

    Rows without a truth or a prediction count in none of the errors and no rank.
    """
    if ranked:
        ranks = spearman(df, keys, prediction, truth).select(*keys, "spearman", "spearman_defined")
        return join_same(metric_bundle(df, keys, group, truth, prediction), ranks, keys)
    e = F.col(prediction) - F.col(truth)
    per = df.groupBy(*keys, group).agg(F.count("*").alias("_n"), F.sum(F.abs(e)).alias("_a"), F.sum(e * e).alias("_s"))
    return per.groupBy(*keys).agg(
        F.sum("_n").alias("n"), (F.sum("_a") / F.sum("_n")).alias("mae"), F.avg(F.col("_a") / F.col("_n")).alias("macro_mae"), F.sqrt(F.sum("_s") / F.sum("_n")).alias("rmse")
    )


def average_rank(df: DataFrame, keys: list[str], column: str, into: str) -> DataFrame:
    """Ranks from 1 within ``keys``; equal values share the mean of their ranks."""
    ranks = below(df, keys, column).select(*keys, column, (F.col("_below") + (F.col("_n") + 1) / 2).alias(into))
    return join_same(df, ranks, [*keys, column])


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation, NULL if a side is constant."""
    n, sx, sy = F.count(x), F.sum(x), F.sum(y)
    spread = (F.max(x) > F.min(x)) & (F.max(y) > F.min(y))
    a, b = F.var_pop(x), F.var_pop(y)
    return F.when(spread & (n > 1), F.covar_pop(x, y) / F.sqrt(F.when(spread, a).otherwise(1.0) * F.when(spread, b).otherwise(1.0)))


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """n, spearman (NULL if undefined) and spearman_defined over rows where both sides are there."""
    there = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    ranked = average_rank(average_rank(there, keys, x, "_rx"), keys, y, "_ry")
    out = ranked.groupBy(*keys).agg(F.count("*").alias("n"), safe_corr(F.col("_rx"), F.col("_ry")).alias("spearman"))
    return out.withColumn("spearman_defined", F.col("spearman").isNotNull())


def ecdf(df: DataFrame, keys: list[str], column: str, ties: list[str]) -> DataFrame:
    """Each value with rank / n of its group: one point for each row, equal values at different heights.

    Rows of one value go by ``ties``. Neither a group nor the rows of one value are put in
    order in one task.
    """
    there = df.filter(F.col(column).isNotNull()).select(*keys, *ties, column)
    placed = with_ordinals(there, keys, [column, *ties], "_place", total="_all")
    return placed.select(*keys, *ties, column, ((F.col("_place") + 1) / F.col("_all")).alias("ecdf"))


def trailing_mean(df: DataFrame, keys: list[str], order: list[str], column: str, rows: int, into: str, number: str | None = None) -> DataFrame:
    """Mean of the last ``rows`` values, the present one included; with ``number``, also each row's number in its group, from 1.

    A group of any size is cut into blocks of rows, each with the few rows before it.
    """
    blocks = in_blocks(df, keys, order, rows - 1)
    w = Window.partitionBy(*keys, "_block").orderBy("_ordinal").rowsBetween(-(rows - 1), Window.currentRow)
    out = blocks.withColumn(into, F.avg(column).over(w)).filter("not _halo")
    return out.select(*df.columns, into, *([(F.col("_ordinal") + 1).alias(number)] if number else []))


def remaining_seconds(mean_seconds: Column, done: Column, planned: Column) -> Column:
    """Time left at the trailing mean."""
    return mean_seconds * F.greatest(planned - done, F.lit(0))


def first_where(df: DataFrame, keys: list[str], ordinal: str, holds: Column, columns: list[str]) -> DataFrame:
    """The first row in ordinal order for which ``holds``; groups without one keep NULLs."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(ordinal, *columns), F.when(holds, F.col(ordinal))).alias("_f"), F.count_if(holds).alias("_n")).select(
        *keys, *[F.when(F.col("_n") > 0, F.col("_f")[c]).alias(c) for c in (ordinal, *columns)]
    )


def argmax_row(df: DataFrame, keys: list[str], value: str, position: str) -> DataFrame:
    """Maximum of each group and the first position that has it."""
    return df.groupBy(*keys).agg(F.max(value).alias("maximum"), F.max_by(position, F.struct(F.col(value), -F.col(position))).alias("argmax"))
