"""Column builders for array columns: vector differences, slices of series, filters.

Elements are widened to DOUBLE before any sum. Every builder is a plain expression, so
it stays inside the JVM and composes with filters and pruning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-30


def wide(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(wide(a), wide(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(wide(v), lambda x: x * x)))


def difference(a: Column, r: Column) -> Column:
    """a - r in the arrays' own precision: FLOAT arrays give FLOAT differences."""
    return F.zip_with(a, r, lambda x, y: x - y)


def relative_l2(a: Column, r: Column) -> Column:
    return norm(difference(a, r)) / F.greatest(norm(r), F.lit(TINY))


def rms_difference(a: Column, r: Column) -> Column:
    return norm(difference(a, r)) / F.sqrt(F.size(r).cast("double"))


def cosine_distance(a: Column, r: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(2.0), F.lit(1.0) - dot(a, r) / F.greatest(norm(a) * norm(r), F.lit(TINY))))


def max_abs_difference(a: Column, r: Column) -> Column:
    return F.array_max(F.transform(difference(a, r), lambda d: F.abs(d.cast("double"))))


def changed_fraction(a: Column, r: Column) -> Column:
    return F.size(F.filter(difference(a, r), lambda d: d != 0)) / F.size(r)


def position_metrics(a: Column, r: Column) -> dict[str, Column]:
    """The six metrics of an (ALT, REF) pair of vectors."""
    return {
        "relative_l2": relative_l2(a, r), "rms_difference": rms_difference(a, r), "cosine_distance": cosine_distance(a, r),
        "max_abs_difference": max_abs_difference(a, r), "changed_dimension_fraction": changed_fraction(a, r), "reference_l2": norm(r),
    }


def mean(v: Column) -> Column:
    return F.when(F.size(v) > 0, total(wide(v)) / F.size(v))


def slice_mean(v: Column, start: Column | int, end: Column | int) -> Column:
    """Mean over the half-open 0-based [start, end), cut to the array; NULL when empty."""
    start, end = (F.lit(x) if isinstance(x, int) else x for x in (start, end))
    lo, hi = F.greatest(start, F.lit(0)), F.least(end, F.size(v))
    return F.when(hi > lo, total(F.slice(wide(v), lo + 1, hi - lo)) / (hi - lo))


def region_mean(v: Column, centre: Column | int, radius: int) -> Column:
    """Mean of the 2 * radius + 1 values around ``centre``, or NULL unless all of them exist."""
    centre = F.lit(centre) if isinstance(centre, int) else centre
    lo = centre - radius
    return F.when((lo >= 0) & (centre + radius + 1 <= F.size(v)), total(F.slice(wide(v), lo + 1, F.lit(2 * radius + 1))) / (2 * radius + 1))


def argmax(v: Column) -> Column:
    """0-based place of the first maximum."""
    return F.array_position(v, F.array_max(v)) - 1


def nonzero(v: Column) -> Column:
    return F.size(F.filter(v, lambda x: x != 0))


def median(v: Column) -> Column:
    s, n = F.sort_array(wide(v)), F.size(v)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def series_slices(v: Column, centre: int, radius: int = 20, ahead: int = 127) -> dict[str, Column]:
    """Whole, before, from and around ``centre``: means, maximum, where it is, and how many values aren't zero."""
    return {
        "whole_mean": mean(v), "pre_mean": slice_mean(v, 0, centre), "post_mean": slice_mean(v, F.lit(centre), F.size(v)),
        "around_mean": slice_mean(v, centre - radius, centre + radius + 1), "ahead_mean": slice_mean(v, centre, centre + ahead + 1),
        "maximum": F.array_max(wide(v)), "argmax": argmax(v), "max_offset": argmax(v) - centre, "nonzero": nonzero(v), "median": median(v),
    }


def pooled_delta(alt_mean: Column, ref_mean: Column) -> Column:
    """ALT mean minus REF mean in double, stored as FLOAT."""
    return F.zip_with(wide(alt_mean), wide(ref_mean), lambda a, r: (a - r).cast("float"))


def unit_direction(v: Column) -> Column:
    """The vector over its norm; a zero vector stays zero."""
    n = norm(v)
    return F.when(n == 0, wide(v)).otherwise(F.transform(wide(v), lambda x: x / F.when(n == 0, 1.0).otherwise(n)))


def changed_count(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda u, x: u + x)


def first_change(a: Column, b: Column) -> Column:
    """0-based place of the first unequal element, or NULL."""
    at = F.array_position(F.zip_with(a, b, lambda x, y: x != y), True)
    return F.when(at > 0, at - 1)


def direct_fir(u: Column, taps: list[float]) -> Column:
    """Causal convolution y[t] = sum over k of taps[k] * u[t - k], by its definition."""
    n = len(taps)
    padded = F.concat(F.array_repeat(F.lit(0.0), n - 1), wide(u))
    weights = F.lit(list(reversed([float(t) for t in taps])))
    return F.transform(F.sequence(F.lit(1), F.size(u)), lambda t: total(F.zip_with(F.slice(padded, t, n), weights, lambda x, h: x * h)))


def gated_skip(y: Column, u: Column, skip: float, gate: Column) -> Column:
    """(y + u * skip) * gate, element by element."""
    return F.zip_with(F.zip_with(wide(y), wide(u), lambda a, b: a + b * skip), wide(gate), lambda a, g: a * g)


def softmax(v: Column) -> Column:
    """Probabilities over the given scores, shifted by their maximum."""
    top = F.array_max(wide(v))
    e = F.transform(wide(v), lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / total(e))


def mean_log_probability(v: Column) -> Column:
    return mean(v)


def valid_series(v: Column, length: int, low: float = 0.0, high: float | None = None) -> Column:
    """The array has ``length`` finite values in range."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")) & (x >= low) & (F.lit(True) if high is None else x <= high)
    return F.coalesce((F.size(v) == length) & F.forall(wide(v), ok), F.lit(False))


def edge_slices(v: Column, centre: int, n: int = 256) -> dict[str, Column]:
    """The first ``n`` values, and the last ``n`` before ``centre``."""
    lo = max(0, centre - n)
    return {"first": F.slice(v, 1, n), "before": F.slice(v, lo + 1, centre - lo)}


def comparison(a: Column, b: Column) -> dict[str, Column]:
    """Whether two arrays are equal, how many elements aren't, the largest gap and the relative distance."""
    return {"equal": changed_count(a, b) == 0, "unequal": changed_count(a, b), "max_abs": max_abs_difference(a, b), "relative_l2": relative_l2(a, b)}
