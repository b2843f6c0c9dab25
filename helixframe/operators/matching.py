"""Greedy matching in turn, as rounds of joins.

Each chosen row in turn takes an unused row of its group: one of its own locus if any is
left, else of the whole group, of least metric. Two kinds of lists say what rows prefer:
the rows of a (group, locus) and those of a group, each by (metric, candidate). All rows
that read one list take strictly later places of it the later their turn is, which lets
every row start at a lower bound of its place and move on, never back:

* of those at one candidate the earliest turn stays, the others go on to the next place
  that nobody of an earlier turn is at;
* a row whose own list is at its end goes on with its group's;
* a row is always behind all earlier ones of its list.

A bound never passes the place that the row gets in turn, so once nobody moves the result
is that of the sequential walk. Rows are put in order in ranges, so neither a group nor a
locus is one task's, and of the pool no more is kept than there are rows that ask for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.ordinals import range_sorted, with_ordinals
from helixframe.session import written

_LIST = ["_g", "_list"]


def _behind_earlier(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_from`` raised so that it grows with ``_turn`` in each list."""
    ranged = range_sorted(rows, _LIST, ["_turn"])
    inside = Window.partitionBy("_part", *_LIST).orderBy("_at")
    local = ranged.withColumn("_i", F.row_number().over(inside) - 1)
    held = local.groupBy("_part", *_LIST).agg(F.count("*").alias("_n"), F.max(F.col("_from") - F.col("_i")).alias("_most"))
    # a row for each range that a list has rows in
    earlier = Window.partitionBy(*_LIST).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("_base", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    held = held.select("_part", *_LIST, "_base", F.max(F.col("_most") - F.col("_base")).over(earlier).alias("_carry"))
    own = F.max(F.col("_from") - F.col("_i")).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_base")
    met = local.join(held, ["_part", *_LIST])
    return met.select(*_LIST, "_turn", "_chosen", (F.greatest(own, F.col("_carry")) + F.col("_base") + F.col("_i")).alias("_from"))


def matched_controls(chosen: DataFrame, pool: DataFrame, key: str, group: list[str], locus: str, metric: str, look: int = 32) -> DataFrame:
    """(key, control): for each chosen row in turn an unused row of its group, at the same locus if any is, of least metric.

    Turns go by (``ordinal``, ``key``); ties of the metric by the candidate's key. Rows of
    the pool that are chosen or have no metric are no candidates; rows with a null in their
    group match nothing, a null locus is like no other. Keys of the pool must differ. Rows
    for which nothing is left have no row in the result. ``look`` is how many places a row
    that lost its place looks ahead in a round; it changes the number of rounds alone.
    """
    whole = F.struct(*[F.col(g) for g in group])
    there = lambda df: df.filter(" and ".join(f"`{g}` is not null" for g in group))
    own = F.concat(F.lit("="), F.col(locus).cast("string"))
    turns = with_ordinals(there(chosen).select(whole.alias("_g"), own.alias("_own"), F.col(key).alias("_chosen"), "ordinal"), [], ["ordinal", "_chosen"], "_turn")
    rows = written(turns.select("_g", F.coalesce("_own", F.lit("")).alias("_list"), "_turn", "_chosen", F.lit(0).cast("long").alias("_from")), "matching")
    wanted = rows.groupBy("_g").agg(F.count("*").alias("_wanted"))
    asked = rows.select(*_LIST).union(rows.select("_g", F.lit(""))).distinct().join(wanted, "_g")
    free = there(pool).join(chosen.select(key), key, "left_anti").filter(F.col(metric).isNotNull())
    free = free.select(whole.alias("_g"), F.col(key).alias("_candidate"), F.col(metric).alias("_metric"), F.explode(F.array_compact(F.array(F.lit(""), own))).alias("_list"))
    # a row loses at most one candidate to each other row of its group
    placed = with_ordinals(free.join(asked, _LIST), _LIST, ["_metric", "_candidate"], "_place").filter(F.col("_place") < F.col("_wanted"))
    lists = written(placed.select(*_LIST, "_place", "_candidate"), "matching")
    while True:
        at = _behind_earlier(rows).join(lists.withColumnRenamed("_place", "_from"), [*_LIST, "_from"], "left")
        at = written(at, "matching")
        first = at.filter(F.col("_candidate").isNotNull()).groupBy("_g", "_candidate").agg(F.min("_turn").alias("_first"))
        lost = at.join(first, ["_g", "_candidate"]).filter(F.col("_turn") > F.col("_first"))
        ahead = lost.select(*_LIST, "_turn", F.explode(F.sequence(F.col("_from") + 1, F.col("_from") + look)).alias("_place"))
        taken = lists.join(first, ["_g", "_candidate"]).select(*_LIST, "_place", "_first")
        open_ = F.col("_first").isNull() | (F.col("_first") > F.col("_turn"))
        onward = ahead.join(taken, [*_LIST, "_place"], "left").groupBy("_turn").agg(F.coalesce(F.min(F.when(open_, F.col("_place"))), F.max("_place") + 1).alias("_next"))
        at_end = F.col("_candidate").isNull() & (F.col("_list") != "")
        rows = written(
            at.join(onward, "_turn", "left").select(
                "_g", F.when(at_end, F.lit("")).otherwise(F.col("_list")).alias("_list"), "_turn", "_chosen",
                F.when(at_end, F.lit(0)).otherwise(F.coalesce("_next", "_from")).cast("long").alias("_from"), (at_end | F.col("_next").isNotNull()).alias("_moved"),
            ), "matching",
        )
        if not rows.filter("_moved").limit(1).count():
            return at.filter(F.col("_candidate").isNotNull()).select(F.col("_chosen").alias(key), F.col("_candidate").alias("control"))
        rows = rows.drop("_moved")
