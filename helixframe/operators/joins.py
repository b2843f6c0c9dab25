"""Joins by overlap, nearness and radius, and joins whose cardinality is checked.

Range conditions are turned into equality on bins, so they plan as hash joins and
survive any size of both sides. A pair that shares several bins is kept in the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.intervals import interval_union
from helixframe.operators.ordinals import range_sorted
from helixframe.operators.ranks import join_same


class CardinalityError(ValueError):
    """A key that should be unique, or a join that should keep every row, isn't or doesn't."""


def _binned(df: DataFrame, start: str, end: str, bin_size: int) -> DataFrame:
    return df.filter(F.col(start) <= F.col(end)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / bin_size), F.floor(F.col(end) / bin_size))))


#: Rows that a list of ``_packed`` or ``_packed_bins`` holds at most.
PACK = 4096


def _lists(rows: DataFrame, keys: list[str], others: list[str], into: str) -> DataFrame:
    """(keys, ``into``) of ``rows`` in order of ``keys`` with ``_at``: the ``others`` of rows with equal keys as lists."""
    return rows.groupBy(*keys, F.floor(F.col("_at") / PACK).alias("_pack")).agg(F.collect_list(F.struct(*(others or [F.lit(True)]))).alias(into)).drop("_pack")


def _packed(df: DataFrame, on: list[str], span: tuple[str, str], into: str) -> DataFrame:
    """(on, span, ``into``): rows that share ``on`` and a span as lists of at most ``PACK`` rows' other columns."""
    rows = range_sorted(df.filter(F.col(span[0]) <= F.col(span[1])), on, list(span))
    # rows of one span stand one after the other in their range
    return _lists(rows, [*on, *span], [c for c in df.columns if c not in (*on, *span)], into)


def _packed_bins(df: DataFrame, on: list[str], span: tuple[str, str], bin_size: int, into: str) -> DataFrame:
    """(on, ``_bin``, span, ``into``): like ``_packed`` for each bin, dealt by (on, ``_bin``) to as many tasks as a shuffle has; nothing is written."""
    keys, tasks = [*on, "_bin"], int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _binned(df, *span, bin_size).repartition(tasks, *keys).sortWithinPartitions(*keys, *span).withColumn("_at", F.monotonically_increasing_id())
    return _lists(rows, [*keys, *span], [c for c in df.columns if c not in (*on, *span)], into)


def overlap_join(
    left: DataFrame, right: DataFrame, on: list[str], left_span: tuple[str, str], right_span: tuple[str, str], bin_size: int, shared: bool = False
) -> DataFrame:
    """Pairs of rows with equal ``on`` whose closed spans share at least one position.

    Column names other than ``on`` must differ between the two sides. Where many rows of
    a side have the same span, ``shared`` compares two spans once for all rows that have them
    and unfolds the pairs that are in the result only; left rows then go to as many tasks as a
    shuffle has, since it's the pairs and not the rows that take the time. Pairs of two spans
    stand together, each left row's one after the other: in a columnar file that is written
    from them a run of one value beside a list that comes again.
    """
    (ls, le), (rs, re_) = left_span, right_span
    touch = (F.col(ls) <= F.col(re_)) & (F.col(le) >= F.col(rs))
    first = F.greatest(F.floor(F.col(ls) / bin_size), F.floor(F.col(rs) / bin_size))
    if not shared:
        return _binned(left, ls, le, bin_size).join(_binned(right, rs, re_, bin_size), [*on, "_bin"]).filter(touch & (F.col("_bin") == first)).drop("_bin")
    l, r = _packed_bins(left, on, left_span, bin_size, "_lefts"), _binned(_packed(right, on, right_span, "_rows"), rs, re_, bin_size)
    met = l.join(r, [*on, "_bin"]).filter(touch & (F.col("_bin") == first)).drop("_bin")
    columns = [*on, *[c for side in (left, right) for c in side.columns if c not in on]]
    return met.select("*", F.inline("_lefts")).select("*", F.inline("_rows")).select(*columns)


def overlap_exists(
    left: DataFrame, right: DataFrame, on: list[str], key: list[str], left_span: tuple[str, str], right_span: tuple[str, str], bin_size: int, keep: bool = True
) -> DataFrame:
    """Rows of ``left`` whose span overlaps any of ``right`` (or none, with ``keep=False``); ``key`` names a left row."""
    (ls, le), (rs, re_) = left_span, right_span
    l, r = _binned(left.select(*{*on, *key, ls, le}), ls, le, bin_size), _binned(right.select(*on, rs, re_), rs, re_, bin_size)
    same = F.lit(True)
    for c in (*on, "_bin"):
        same = same & (F.col(f"l.{c}") == F.col(f"r.{c}"))
    touch = (F.col(f"l.{ls}") <= F.col(f"r.{re_}")) & (F.col(f"l.{le}") >= F.col(f"r.{rs}"))
    hit = l.alias("l").join(r.alias("r"), same & touch, "left_semi").select(*key).distinct()
    return left.join(hit, key, "left_semi" if keep else "left_anti")


def counted_upto(df: DataFrame, marks: DataFrame, on: list[str], position: str, mark: str, bin_size: int, into: str) -> DataFrame:
    """Each row of ``df`` with how many ``marks`` of its ``on`` group lie at or before its position.

    Marks are counted by bin first; rows and marks are put in order inside their bin only.
    """
    held = marks.groupBy(*on, F.col(mark).alias("_at")).agg(F.count("*").alias("_n")).withColumns({"_kind": F.lit(0), "_row": F.lit(None).cast(df.select(F.struct("*")).schema[0].dataType)})
    asked = df.select(*on, F.col(position).alias("_at"), F.lit(0).cast("long").alias("_n"), F.lit(1).alias("_kind"), F.struct("*").alias("_row"))
    both = held.unionByName(asked).withColumn("_bin", F.floor(F.col("_at") / bin_size))
    bins = both.groupBy(*on, "_bin").agg(F.sum("_n").alias("_m"))
    bases = bins.select(*on, "_bin", F.coalesce(F.sum("_m").over(Window.partitionBy(*on).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*on, "_bin").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = both.withColumn("_upto", F.sum("_n").over(inside)).filter("_kind = 1").join(bases, [*on, "_bin"])
    return counted.select("_row.*", (F.col("_base") + F.col("_upto")).alias(into))


def overlap_count(left: DataFrame, right: DataFrame, on: list[str], left_span: tuple[str, str], right_span: tuple[str, str], bin_size: int, keys: list[str]) -> DataFrame:
    """How many overlapping pairs each value of ``keys``, columns of ``left``, has.

    A span meets those that start at or before its end, less those that end before its
    start: two cumulative counts, and no pair is made.
    """
    (ls, le), (rs, re_) = left_span, right_span
    l, r = left.filter(F.col(ls) <= F.col(le)).select(*dict.fromkeys([*on, *keys, ls, le])), right.filter(F.col(rs) <= F.col(re_))
    begun = counted_upto(l, r, on, le, rs, bin_size, "_begun").withColumn("_before", F.col(ls) - 1)
    met = counted_upto(begun, r, on, "_before", re_, bin_size, "_ended")
    return met.groupBy(*keys).agg(F.sum(F.col("_begun") - F.col("_ended")).alias("overlap_pairs")).filter("overlap_pairs > 0")


def purge_counts(df: DataFrame, group: str, key: str, span: tuple[str, str], bin_size: int) -> DataFrame:
    """For each group held out: (group, initial_train_n, excluded_overlap_n, retained_train_n, overlap_pairs).

    Rows of other groups whose span overlaps any of the held-out group's are excluded from
    training. A row meets a group's merged intervals, not its rows, and the table isn't
    copied for each fold: counts of all other rows are the total less the group's own.
    Pairs are counted from cumulative counts, over all rows less inside the group.
    """
    (start, end), every = span, "_every"
    rows = df.select(F.lit(0).alias(every), group, key, *span)
    sizes = rows.groupBy(group).agg(F.count("*").alias("_n"))
    whole = rows.agg(F.count("*").alias("_all"))
    merged = interval_union(rows.select(every, F.col(group).alias("_outer"), F.col(start).alias("_from"), F.col(end).alias("_to")), [every, "_outer"], "_from", "_to")
    met = overlap_join(rows, merged, [every], span, ("_from", "_to"), bin_size).filter(~F.col(group).eqNullSafe(F.col("_outer")))
    gone = met.select(key, "_outer").distinct().groupBy(F.col("_outer").alias(group)).agg(F.count("*").alias("excluded_overlap_n"))
    # each row once under a name that all share and once under its group's
    named = rows.select(group, *span, F.explode(F.array(F.lit("*"), F.concat(F.lit("g"), F.coalesce(F.col(group).cast("string"), F.lit(""))))).alias("_scope"))
    right = named.select("_scope", F.col(start).alias("_from"), F.col(end).alias("_to"))
    met_by = overlap_count(named, right, ["_scope"], span, ("_from", "_to"), bin_size, [group, "_scope"])
    pairs = met_by.groupBy(group).agg(F.sum(F.when(F.col("_scope") == "*", F.col("overlap_pairs")).otherwise(-F.col("overlap_pairs"))).alias("_pairs"))
    out = join_same(join_same(sizes.crossJoin(F.broadcast(whole)), gone, [group], "left"), pairs, [group], "left")  # ``whole`` is one row
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = out.select(group, (F.col("_all") - F.col("_n")).alias("initial_train_n"), zero("excluded_overlap_n").alias("excluded_overlap_n"), zero("_pairs").alias("overlap_pairs"))
    return out.withColumn("retained_train_n", F.col("initial_train_n") - F.col("excluded_overlap_n")).filter("initial_train_n > 0")


def radius_join(points: DataFrame, sites: DataFrame, on: list[str], point: str, site: str, radius: int) -> DataFrame:
    """One row for each (point, site) no farther apart than ``radius``; a site is copied to three bins."""
    p = points.withColumn("_bin", F.floor(F.col(point) / radius))
    s = sites.withColumn("_bin", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col(site) / radius) + d)))
    return p.join(s, [*on, "_bin"]).filter(F.abs(F.col(point) - F.col(site)) <= radius).drop("_bin")


def nearest_site(points: DataFrame, sites: DataFrame, on: list[str], point: str, site: str, ties: list[str], bin_size: int = 1 << 14) -> DataFrame:
    """Each point with the nearest site of its ``on`` group, by (distance, *ties*); points of groups without sites drop out.

    Both sides are walked together in order of position, bin by bin: the last site at or
    before a point and the first at or after it are the only candidates. They stand in the
    point's bin or are the last of an earlier and the first of a later bin, which come
    from one row a bin; so a group's rows spread over its bins, and no pair is made that
    isn't one of the two. Sites at one position are reduced to the first in ``ties`` order.
    """
    names = [site, *ties]
    best = sites.groupBy(*on, F.col(site).alias("_at")).agg(F.min(F.struct(*[F.col(c) for c in ties])).alias("_tie"))
    s = best.select(*on, "_at", F.struct(F.col("_at").alias(site), *[F.col(f"_tie.{c}").alias(c) for c in ties]).alias("_site"), F.lit(0).alias("_kind"), F.lit(None).cast(points.select(F.struct("*")).schema[0].dataType).alias("_row"))
    p = points.select(*on, F.col(point).alias("_at"), F.lit(None).cast(s.schema["_site"].dataType).alias("_site"), F.lit(1).alias("_kind"), F.struct("*").alias("_row"))
    both = s.unionByName(p).withColumn("_bin", F.floor(F.col("_at") / bin_size))
    # structs compare by position first: the last and first site of each bin, then of all bins before and after
    bins = both.groupBy(*on, "_bin").agg(F.max("_site").alias("_last"), F.min("_site").alias("_first"))
    by_bin = Window.partitionBy(*on).orderBy("_bin")
    around = bins.select(
        *on, "_bin", F.last("_last", ignorenulls=True).over(by_bin.rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"),
        F.first("_first", ignorenulls=True).over(by_bin.rowsBetween(1, Window.unboundedFollowing)).alias("_later"),
    )
    before = Window.partitionBy(*on, "_bin").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy(*on, "_bin").orderBy(F.desc("_at"), "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = both.withColumn("_b", F.last("_site", ignorenulls=True).over(before)).withColumn("_a", F.last("_site", ignorenulls=True).over(after)).filter("_kind = 1")
    seen = inside.join(around, [*on, "_bin"]).withColumns({"_b": F.coalesce("_b", "_earlier"), "_a": F.coalesce("_a", "_later")})
    ranked = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("_at") - F.col(f"{c}.{site}")).alias("distance"), *[F.col(f"{c}.{t}").alias(t) for t in ties], F.col(f"{c}.{site}").alias(site)))
    pick = F.least(ranked("_b"), ranked("_a"))
    return seen.withColumn("_n", pick).filter("_n is not null").select("_row.*", *[F.col(f"_n.{c}").alias(c) for c in names], F.col("_n.distance").alias("distance"))


def points_in_windows(windows: DataFrame, points: DataFrame, on: list[str], span: tuple[str, str], point: str, key: list[str], fields: list[str], into: str) -> DataFrame:
    """Each window with the sorted structs of the points inside its closed span; an empty list where there are none."""
    width = 1 << 15
    marked = points.withColumns({"_s": F.col(point), "_e": F.col(point)})
    inside = overlap_join(windows.select(*on, *key, *span), marked, on, span, ("_s", "_e"), width)
    lists = inside.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(into))
    return windows.join(lists, key, "left").withColumn(into, F.coalesce(into, F.array()))


def with_lists(df: DataFrame, many: DataFrame, key: list[str], fields: list[str], into: str) -> DataFrame:
    """Each row with the sorted structs of its matches in ``many``; an empty list where there are none."""
    lists = many.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(into))
    return df.join(lists, key, "left").withColumn(into, F.coalesce(into, F.array()))


def assert_unique(df: DataFrame, key: list[str], name: str) -> None:
    twice = df.groupBy(*key).count().filter("count > 1").first()
    if twice is not None:
        raise CardinalityError(f"{name}: key {[twice[k] for k in key]} occurs {twice['count']} times")


def exactly_one(df: DataFrame, **conditions) -> DataFrame:
    """The only row with the given values; raises if there is none or more than one."""
    for c, v in conditions.items():
        df = df.filter(F.col(c).eqNullSafe(F.lit(v)))
    if (n := len(df.limit(2).collect())) != 1:
        raise CardinalityError(f"{'no' if n == 0 else 'more than one'} row has {conditions}")
    return df


def one_to_one(left: DataFrame, right: DataFrame, key: list[str], suffixes: tuple[str, str] = ("_left", "_right")) -> DataFrame:
    """An inner join that must pair every row of both sides exactly once; equal column names get suffixes."""
    assert_unique(left, key, "left")
    assert_unique(right, key, "right")
    both = set(left.columns) & set(right.columns) - set(key)
    l = left.select(*key, *[F.col(c).alias(c + suffixes[0] if c in both else c) for c in left.columns if c not in key])
    r = right.select(*key, *[F.col(c).alias(c + suffixes[1] if c in both else c) for c in right.columns if c not in key])
    out = l.join(r, key)
    n, nl, nr = out.count(), left.count(), right.count()
    if not n == nl == nr:
        raise CardinalityError(f"{nl} and {nr} rows made {n} pairs")
    return out


def aligned(left: DataFrame, right: DataFrame, key: list[str], suffixes: tuple[str, str] = ("_left", "_right")) -> DataFrame:
    """Full outer join of frames that must have the same keys; raises when run if a key is on one side only."""
    l, r = left.withColumn("_l", F.lit(True)), right.withColumn("_r", F.lit(True))
    both = (set(left.columns) & set(right.columns)) - set(key)
    for c in both:
        l, r = l.withColumnRenamed(c, c + suffixes[0]), r.withColumnRenamed(c, c + suffixes[1])
    out = l.join(r, key, "full_outer")
    ok = F.assert_true(F.col("_l") & F.col("_r"), F.lit("keys differ"))
    return out.filter(F.coalesce(ok.cast("boolean"), F.lit(True))).drop("_l", "_r")


def in_order_of(ids: DataFrame, df: DataFrame, key: list[str], ordinal: str = "ordinal") -> DataFrame:
    """Rows of ``df`` for each id, with the ids' ordinal; sort by it to have the ids' order."""
    return ids.select(*key, ordinal).join(df, key)


def scored_once(df: DataFrame, key: list[str], score) -> DataFrame:
    """``score`` applied to the distinct keys only, joined back to every row."""
    return df.join(score(df.select(*key).distinct()), key)


def pending(plan: DataFrame, done: list[DataFrame], key: list[str]) -> DataFrame:
    """Rows of a plan that aren't in every one of ``done``: an artifact is complete when all its parts exist."""
    complete = done[0].select(*key).distinct()
    for d in done[1:]:
        complete = complete.join(d.select(*key).distinct(), key)
    return plan.join(complete, key, "left_anti")


def adjacent(df: DataFrame, partition: list[str], order: list[Column], columns: list[str], prefix: str = "next_") -> DataFrame:
    """Each row beside its successor; the last row of a partition drops out."""
    w = Window.partitionBy(*partition).orderBy(*order)
    out = df.select("*", *[F.lead(c).over(w).alias(prefix + c) for c in columns], F.lead(F.lit(True)).over(w).alias("_more"))
    return out.filter("_more").drop("_more")


def zipped_positions(df: DataFrame, key: list[str], arrays: dict[str, Column]) -> DataFrame:
    """One row for each place of several arrays side by side, as (position, name...)."""
    zipped = F.arrays_zip(*[c.alias(n) for n, c in arrays.items()])
    return df.select(*key, F.posexplode(zipped).alias("position", "_z")).select(*key, "position", *[F.col("_z")[n].alias(n) for n in arrays])
