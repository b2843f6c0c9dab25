"""Exact order statistics and ranks of groups of any size.

A group's values are counted first, so repeated values cost one row, and cut into bins
by approximate quantiles of the group. How many rows lie below a bin follows from the
bins' counts; only inside a bin are values put in order. So no window and no aggregation
buffer holds a group, and the results are exact whatever the quantiles were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 512


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join by ``keys`` in which NULL equals NULL; without keys, ``right`` has one row."""
    if not keys:
        return left.withColumn("_one", F.lit(1)).join(right.withColumn("_one", F.lit(1)), "_one", how).drop("_one")
    names = {k: f"_r_{k}" for k in keys}
    on = None
    for k, r in names.items():
        same = F.col(k).eqNullSafe(F.col(r))
        on = same if on is None else on & same
    return left.join(right.withColumnsRenamed(names), on, how).drop(*names.values())


def _bin(value: Column, cuts: Column, bins: int) -> Column:
    """How many cuts are at most ``value``, by halving."""
    steps, step = [], 1
    while step <= bins:
        steps.append(step)
        step *= 2
    return F.aggregate(F.array(*[F.lit(s) for s in reversed(steps)]), F.lit(0), lambda at, s: F.when(F.get(cuts, at + s - 1) <= value, at + s).otherwise(at))


def value_counts(df: DataFrame, keys: list[str], value: str, bins: int = BINS) -> tuple[DataFrame, DataFrame]:
    """(keys, value, _n, _bin) of the distinct values that aren't NULL, and (keys, _bin, _below, _all): rows in lower bins and in the group."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    cuts = counts.groupBy(*keys).agg(F.percentile_approx(value, [i / bins for i in range(1, bins)], 20 * bins).alias("_cuts"))
    binned = join_same(counts, cuts, keys).withColumn("_bin", _bin(F.col(value), F.col("_cuts"), bins)).drop("_cuts")
    sums = binned.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_m"))
    # at most ``bins`` rows a group
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    places = sums.select(*keys, "_bin", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_below"), F.col("_m"), F.sum("_m").over(Window.partitionBy(*keys)).alias("_all"))
    return binned, places


def _inside(binned: DataFrame, places: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``binned`` values with how many rows are below each, and in the group."""
    w = Window.partitionBy(*keys, "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return join_same(binned, places.drop("_m"), [*keys, "_bin"]).withColumn("_below", F.col("_below") + F.coalesce(F.sum("_n").over(w), F.lit(0)))


def percentiles(df: DataFrame, keys: list[str], value: str, shares: list[float], into: list[str], bins: int = BINS) -> DataFrame:
    """(keys, *into): exact percentiles of each group with linear interpolation; NULLs don't count. Groups without values drop out."""
    binned, places = value_counts(df, keys, value, bins)
    place = lambda q: F.lit(q) * (F.col("_all") - 1)
    low, high = (lambda q: F.floor(place(q))), (lambda q: F.ceil(place(q)))
    holds = lambda at, n: (F.col("_below") <= at) & (at < F.col("_below") + F.col(n))
    wanted = None
    for q in shares:
        some = holds(low(q), "_m") | holds(high(q), "_m")
        wanted = some if wanted is None else wanted | some
    # only the bins that hold one of the order statistics are put in order
    at = _inside(binned, places.filter(wanted), keys, value)
    pick = lambda f, q: F.max(F.when(holds(f(q), "_n"), F.col(value)))
    found = at.groupBy(*keys).agg(F.max("_all").alias("_all"), *[x for i, q in enumerate(shares) for x in (pick(low, q).alias(f"_l{i}"), pick(high, q).alias(f"_h{i}"))])
    out = []
    for i, (q, name) in enumerate(zip(shares, into)):
        a, b = F.col(f"_l{i}"), F.col(f"_h{i}")
        out.append(F.when(a == b, a).otherwise((high(q) - place(q)) * a + (place(q) - low(q)) * b).alias(name))
    return found.select(*keys, *out)


def below(df: DataFrame, keys: list[str], value: str, bins: int = BINS) -> DataFrame:
    """(keys, value, _n, _below, _all) of each distinct value: how often it occurs, rows with smaller ones, rows of the group."""
    return _inside(*value_counts(df, keys, value, bins), keys, value).drop("_bin")


def places(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """(column, place) of the distinct values, in order from 0.

    Bins come from a sample of values taken by hash, so a value's bin depends on nothing
    but the values; the driver sees about ``bins`` of them.
    """
    one = df.select(column).distinct()
    step = max(1, one.count() // bins)
    cuts = sorted(r[0] for r in one.filter(F.col(column).isNotNull() & (F.pmod(F.xxhash64(column), F.lit(step)) == 0)).collect())
    table = df.sparkSession.createDataFrame([(cuts,)], f"_cuts array<{dict(df.dtypes)[column]}>")
    binned = one.join(F.broadcast(table)).withColumn("_bin", F.when(F.col(column).isNull(), -1).otherwise(_bin(F.col(column), F.col("_cuts"), len(cuts)))).drop("_cuts")
    sums = binned.groupBy("_bin").agg(F.count("*").alias("_m"))
    before = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("_bin", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_base"))
    w = Window.partitionBy("_bin").orderBy(column)
    return binned.join(bases, "_bin").select(column, (F.col("_base") + F.row_number().over(w) - 1).alias("place"))
