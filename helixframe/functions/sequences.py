"""Column builders for nucleotide strings and coordinates.

Genomic positions are 1-based and closed; positions inside a window are 0-based and
half-open. SQL substring is 1-based, so a genomic position needs no shift there.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(s, "ACGTN", "TGCAN"))


def complement(s: Column) -> Column:
    """Complement without reversal, for bases already listed in transcript order."""
    return F.translate(s, "ACGTN", "TGCAN")


def window_around(sequence: Column, position: Column, length: int) -> Column:
    """``length`` bases with 1-based ``position`` at 0-based index length / 2; NULL where the window runs off an end."""
    start = position - length // 2
    inside = (start >= 1) & (start + (length - 1) <= F.length(sequence))
    return F.when(inside, F.substring(sequence, start, F.lit(length)))


def with_centre(window: Column, base: Column, length: int) -> Column:
    """The window with its centre base replaced."""
    return F.overlay(window, base, F.lit(length // 2 + 1), F.lit(1))


def differences(a: Column, b: Column) -> Column:
    """How many places differ in two strings; NULL for unequal lengths."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.when(F.length(a) == F.length(b), F.aggregate(pairs, F.lit(0), lambda u, x: u + x))


def matches_reference(sequence: Column, position: Column, ref: Column) -> Column:
    """The reference allele stands at a 1-based position of ``sequence``: a window or a chunk, not a chromosome."""
    return F.substring(sequence, position, F.length(ref)) == ref


def reversed_interval(start: Column, end: Column, length: int | Column) -> tuple[Column, Column]:
    """A half-open interval as seen in the reverse complement of a window of ``length``."""
    length = F.lit(length) if isinstance(length, int) else length
    return length - end, length - start


def input_index(position: Column, window_start: Column) -> Column:
    """0-based index in a window of a 1-based genomic position."""
    return position - window_start


def variant_key(prefix: str, *parts: Column) -> Column:
    return F.concat_ws("_", F.lit(prefix), *[p.cast("string") for p in parts])


def orientation_pair(sequence: Column, index: Column | int, length: Column | int) -> Column:
    """Both views of a window as an array of (view, sequence, variant index)."""
    index = F.lit(index) if isinstance(index, int) else index
    forward = F.struct(F.lit("forward").alias("view"), sequence.alias("sequence"), index.alias("variant_index_0based"))
    return F.array(forward, F.struct(F.lit("rc").alias("view"), reverse_complement(sequence).alias("sequence"), (length - 1 - index).alias("variant_index_0based")))
