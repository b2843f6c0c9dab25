"""Classes by ordered rules, membership in delimited lists, priorities by membership in sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_rules(rules: list[tuple[Column, object]], otherwise: object) -> Column:
    """The value of the first rule that holds."""
    out = None
    for holds, value in rules:
        out = F.when(holds, value) if out is None else out.when(holds, value)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def variant_class(ref: Column, alt: Column) -> Column:
    """SNV, MNV, insertion, deletion or other; the test for equal lengths comes before those for unequal ones."""
    bases = lambda s: s.rlike("^[A-Za-z]+$")
    one = lambda s: s.rlike("^[ACGT]$")
    return ordered_rules(
        [
            (one(ref) & one(alt) & (ref != alt), "SNV"),
            ((F.length(ref) == F.length(alt)) & bases(ref) & bases(alt), "MNV"),
            (F.length(alt) > F.length(ref), "insertion"),
            (F.length(alt) < F.length(ref), "deletion"),
        ],
        "other",
    )


def site_category(site_type: Column, offset: Column, near: int = 20) -> Column:
    """Where an offset in transcript direction lies: the two intronic bases at the site, its exonic base, nearby or beyond."""
    canonical = ((site_type == "donor") & offset.isin(1, 2)) | ((site_type == "acceptor") & offset.isin(-1, -2))
    return ordered_rules([(canonical, "canonical_intronic"), (offset == 0, "exonic_boundary"), (F.abs(offset) <= near, "nearby")], "distant")


def in_list(delimited: Column, value: Column | str, separator: str = r"\|") -> Column:
    """Exact membership in a delimited list; part of an entry is no match."""
    return F.array_contains(F.split(delimited, separator), value if isinstance(value, Column) else F.lit(value))


def accepted(column: Column, values: list) -> Column:
    """Membership in ``values``; an empty list accepts everything."""
    return column.isin(*values) if values else F.lit(True)


def priority_by_membership(df: DataFrame, keys: list[str], sets: list[tuple[str, DataFrame]], otherwise: str, column: str = "priority_class") -> DataFrame:
    """The name of the first set that has the row's key. Each set is reduced to its distinct keys first."""
    out = df
    for i, (_, members) in enumerate(sets):
        out = out.join(members.select(*keys).distinct().withColumn(f"_in{i}", F.lit(True)), keys, "left")
    picked = ordered_rules([(F.col(f"_in{i}").isNotNull(), name) for i, (name, _) in enumerate(sets)], otherwise)
    return out.withColumn(column, picked).drop(*[f"_in{i}" for i in range(len(sets))])
