"""Long series as rows of blocks: convolution and pooled means without whole arrays.

A series is named by ``keys`` (run, view, layer, channel, ...) and cut into blocks of
``size`` positions: (keys, block, values). Positions count from 0 and have no gaps. A task
holds a block and what reaches into it, so a series may be of any length, and one key may
hold any share of the rows. Null values count as zero in a convolution and aren't
allowed in vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.comoments import _frame, _keys, _schema

SIZE = 4096


def blocks_of(df: DataFrame, keys: list[str], position: str, value: str, size: int = SIZE) -> DataFrame:
    """(keys, block, values) of rows (keys, position, value)."""
    held = df.groupBy(*keys, F.floor(F.col(position) / size).alias("block")).agg(F.array_sort(F.collect_list(F.struct(F.col(position).alias("_p"), F.col(value).cast("double").alias("_v")))).alias("_s"))
    return held.select(*keys, "block", F.col("_s._v").alias("values"))


def rows_of(blocks: DataFrame, keys: list[str], value: str = "value", size: int = SIZE) -> DataFrame:
    """(keys, position, value) of blocks."""
    return blocks.select(*keys, F.posexplode("values").alias("_i", value), "block").select(*keys, (F.col("block") * size + F.col("_i")).alias("position"), value)


def blocked_convolution(blocks: DataFrame, keys: list[str], filters: DataFrame, group: list[str], size: int = SIZE) -> DataFrame:
    """(keys, block, values): the causal convolution y[t] = sum of taps[k] * u[t - k], by overlap-save.

    ``filters`` has (group, taps): one filter for each value of ``group``, columns of
    ``keys``; channels without one drop out. A block gets the ends of the blocks that its
    filter reaches back to by a join, and is transformed together with them; filters may
    be longer than blocks.
    """
    held = blocks.join(filters.select(*group, "taps"), group).withColumn("_back", F.size("taps") - 1)
    # a block's last values go to the blocks that reach them
    reach = F.ceil(F.col("_back") / size).cast("int")
    sent = held.select(*keys, F.explode(F.when(F.col("_back") > 0, F.sequence(F.lit(0), reach)).otherwise(F.array(F.lit(0)))).alias("_far"), "block", "values", "taps", "_back")
    take = F.least(F.lit(size), F.col("_back") - (F.col("_far") - 1) * size)
    part = F.when(F.col("_far") == 0, F.col("values")).otherwise(F.slice("values", F.greatest(F.size("values") - take + 1, F.lit(1)), F.greatest(take, F.lit(0))))
    sent = sent.select(*keys, (F.col("block") + F.col("_far")).alias("block"), F.struct((-F.col("_far")).alias("at"), part.alias("v")).alias("_p"), F.when(F.col("_far") == 0, F.col("taps")).alias("taps"))
    met = sent.groupBy(*keys, "block").agg(F.array_sort(F.collect_list("_p")).alias("_p"), F.max("taps").alias("taps"))
    met = met.filter("taps is not null")  # past the series' end
    own = F.element_at(F.col("_p.v"), -1)
    whole = met.select(*keys, "block", F.flatten("_p.v").alias("x"), F.size(own).alias("n"), "taps")
    text, schema = _schema(whole, [*keys, "block"], [("values", "array<double>")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, spectra = [], {}
            for i, key in enumerate(_keys(batch, [*keys, "block"])):
                x, taps = (np.nan_to_num(batch.column(c)[i].values.to_numpy(zero_copy_only=False).astype(float)) for c in ("x", "taps"))
                width = 1 << max(0, len(x) + len(taps) - 2).bit_length()
                name = (width, taps.tobytes())
                if name not in spectra:
                    spectra[name] = np.fft.rfft(taps, width)
                y = np.fft.irfft(np.fft.rfft(x, width) * spectra[name], width)
                n = batch.column("n")[i].as_py()
                out.append((*key, y[len(x) - n : len(x)]))
            if out:
                yield _frame(schema, out)

    return whole.mapInArrow(run, text)


def prefix_sums(df: DataFrame, keys: list[str], position: str, vector: str, size: int = SIZE) -> DataFrame:
    """(keys, block, base, sums): for each block the sum of all vectors before it, and the running sums inside it, end to end.

    Running sums are made block by block; blocks' totals are added up dimension by
    dimension, so no window holds more than one number for each block.
    """
    held = df.groupBy(*keys, F.floor(F.col(position) / size).alias("block")).agg(F.array_sort(F.collect_list(F.struct(F.col(position).alias("_p"), F.col(vector).cast("array<double>").alias("_v")))).alias("_s"))
    stacked = held.select(*keys, "block", F.size("_s").alias("n"), F.flatten("_s._v").alias("x"))
    text, schema = _schema(stacked, [*keys, "block"], [("sums", "array<double>"), ("total", "array<double>")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, key in enumerate(_keys(batch, [*keys, "block"])):
                sums = np.cumsum(batch.column("x")[i].values.to_numpy(zero_copy_only=False).reshape(batch.column("n")[i].as_py(), -1), axis=0)
                out.append((*key, sums.ravel(), sums[-1]))
            if out:
                yield _frame(schema, out)

    parts = stacked.mapInArrow(run, text)
    before = Window.partitionBy(*keys, "_d").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select(*keys, "block", F.posexplode("total").alias("_d", "_t")).withColumn("_b", F.coalesce(F.sum("_t").over(before), F.lit(0.0)))
    bases = bases.groupBy(*keys, "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("_d", "_b"))), lambda c: c["_b"]).alias("base"))
    return parts.drop("total").join(bases, [*keys, "block"])


def region_means(sums: DataFrame, keys: list[str], regions: DataFrame, start: str = "start", end: str = "end", size: int = SIZE) -> DataFrame:
    """``regions`` (keys, start, end, ...) with ``mean``: the mean vector over the half-open [start, end), from two look-ups each.

    Regions that are empty, begin before 0 or end past the series have a null mean.
    ``regions`` rows must differ.
    """
    columns = regions.columns
    ends = regions.filter((F.col(start) >= 0) & (F.col(end) > F.col(start))).select(*columns, F.explode(F.array(F.struct((F.col(start) - 1).alias("_at"), F.lit(-1.0).alias("_sign")), F.struct((F.col(end) - 1).alias("_at"), F.lit(1.0).alias("_sign")))).alias("_e")).select(*columns, "_e.*")
    asked = ends.filter("_at >= 0").withColumn("block", F.floor(F.col("_at") / size))
    width = F.size("base")
    inside = F.slice("sums", F.pmod(F.col("_at"), F.lit(size)) * width + 1, width)
    # past the series' end the slice is empty
    found = asked.join(sums, [*keys, "block"]).filter(F.size(inside) == width).select(*columns, "_at", F.col("_sign").alias("_s"), F.transform(F.zip_with("base", inside, lambda a, b: a + b), lambda x: x * F.col("_sign")).alias("_v"))
    both = found.groupBy(*columns).agg(F.sum("_s").alias("_balance"), F.count("*").alias("_n"), F.max(F.when(F.col("_s") > 0, F.col("_v"))).alias("_end"), F.max(F.when(F.col("_s") < 0, F.col("_v"))).alias("_start"))
    n = (F.col(end) - F.col(start)).cast("double")
    whole = F.when(F.col("_start").isNull(), F.col("_end")).otherwise(F.zip_with("_end", "_start", lambda a, b: a + b))
    ok = F.col("_end").isNotNull() & ((F.col(start) == 0) | F.col("_start").isNotNull())
    means = both.filter(ok).select(*columns, F.transform(whole, lambda x: x / n).alias("mean"))
    named = {c: f"_r_{c}" for c in columns}
    same = None
    for c, r in named.items():
        one = F.col(c).eqNullSafe(F.col(r))
        same = one if same is None else same & one
    return regions.join(means.withColumnsRenamed(named), same, "left").drop(*named.values())


def reversed_region(start: Column, end: Column, length: Column) -> tuple[Column, Column]:
    """The same region counted from the other end of a series."""
    return length - end, length - start
