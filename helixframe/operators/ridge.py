"""Train-only ridge models with nested leave-one-group-out validation, from moments of groups.

A linear model's fit needs counts, means and centred products of its features and nothing
else of its rows. Each group of rows is reduced to one such matrix (``comoments``), once
for all models; what a fold trains on is the total less the groups that it holds out and
the rows that a purge takes away. Where a column would keep less than 1e-4 of its energy,
the difference isn't used: the fold's groups are merged instead, which cancels nothing.
Fits are small solves, one for each fold and model; a chunk of rows meets the coefficients
of all folds that judge it as one matrix. With one feature the solve is a formula and
everything stays in SQL functions.

Models are lists of blocks that share the weight: the scalars, standardised, and blocks
of one or more vectors, each scaled to a mean squared norm of one. Centres and scales
come from training rows; a column or vector whose training rows are all the same is
inactive and its block's weight goes to the others, whatever its unit.

One of rows and columns must fit a matrix of ``MOST_COLUMNS`` squared. Wider vectors are
first replaced by their coordinates in the space that the rows of a cohort span, which
changes no inner product and so no model: the rows' Gram matrix is summed over blocks of
columns, and refused beyond ``MOST_ROWS`` rows.

Groups are whole: a fold never splits one. Ties of the tuning score within 1e-12 go to
the strongest regularisation.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.vectors import norm, wide
from helixframe.operators.comoments import CHUNK_BYTES, FIELDS, GUARD, Moments, _frame, _keys, _schema, _summed, chunked, matrix, merged, moments, read
from helixframe.operators.intervals import interval_union
from helixframe.operators.joins import overlap_join
from helixframe.operators.ranks import join_same
from helixframe.quality.checks import require
from helixframe.session import written

#: Fixed value: the grid of regularisation strengths.
LAMBDAS = (1e-4, 1e-3, 0.01, 0.1, 1.0, 10.0)
#: Feature columns beyond which vectors are replaced by coordinates, and the rows of a cohort up to which they can be.
MOST_COLUMNS, MOST_ROWS = 4096, 4096
#: Tables of lines of at most so many rows, counted first, are broadcast.
SMALL_SIDE = 200_000
#: The blocks of each model; a block named twice has twice the weight.
MODELS = {
    "scalar": ("scalars",), "duplicate_scalar": ("scalars", "scalars"), "signed": ("scalars", "vector"), "reference": ("scalars", "reference"),
    "unit_direction": ("scalars", "direction"), "vector_only": ("vector",),
}


def loeo_one_feature(df: DataFrame, keys: list[str], group: str, x: str, y: str, lambdas: tuple[float, ...] = LAMBDAS) -> DataFrame:
    """Each row with its held-out prediction and the chosen lambda of its outer fold.

    Needs only moments of groups: fold tables have groups^2 rows, whatever the number of rows.
    """
    if not keys:
        return loeo_one_feature(df.withColumn("_all", F.lit(0)), ["_all"], group, x, y, lambdas).drop("_all")
    held = df.select(*keys, F.col(group).alias("_g"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    by = [*keys, "_g"]
    m = held.groupBy(*by).agg(
        F.count("*").cast("double").alias("n"), F.avg("_x").alias("mx"), F.avg("_y").alias("my"), (F.var_pop("_x") * F.count("*")).alias("sxx"), (F.var_pop("_y") * F.count("*")).alias("syy"),
        (F.covar_pop("_x", "_y") * F.count("*")).alias("sxy"), *[f(c).alias(f"{k}{c[1]}") for c in ("_x", "_y") for k, f in (("low_", F.min), ("high_", F.max))],
    )
    m = written(m, "groups")  # a row for each group; read several times below
    groups = m.count()
    # no row goes to its group's task where the groups, counted, leave a small side; the planner's estimate of it is a product of sizes
    small = lambda side, rows: F.broadcast(side) if rows <= SMALL_SIDE else side
    whole = _merged_lines(m, keys)
    outer = _less_line(m.select(*keys, F.col("_g").alias("outer_group"), *[F.col(c).alias(f"o_{c}") for c in _LINE]).join(whole, keys), "o_").select(*keys, "outer_group", *_LINE)
    inner = outer.join(m.select(*keys, F.col("_g").alias("inner_group"), *[F.col(c).alias(f"o_{c}") for c in _LINE]), keys).filter("inner_group <> outer_group")
    inner = _less_line(inner, "o_").select(*keys, "outer_group", "inner_group", *_LINE)
    folds = _checked_lines(outer.withColumn("inner_group", F.lit(None).cast(dict(m.dtypes)["_g"])).unionByName(inner), whole, m, keys)

    def line(lam):
        """The slope of ridge on standardised x: it shrinks by 1 + lambda."""
        return F.when(F.col("live"), F.col("sxy") / F.when(F.col("live"), F.col("sxx")).otherwise(1.0) / (1 + lam)).otherwise(0.0)

    grid = F.explode(F.array(*[F.lit(v) for v in lambdas])).alias("lambda")
    tuned = folds.filter("inner_group is not null").select("*", grid).select(*keys, "outer_group", "inner_group", "lambda", "mx", "my", line(F.col("lambda")).alias("slope"))
    error = F.abs(F.col("_y") - F.col("my") - F.col("slope") * (F.col("_x") - F.col("mx")))
    # a row meets the (groups - 1) x lambdas lines of its group
    scores = held.withColumnRenamed("_g", "inner_group").join(small(tuned, groups * groups * len(lambdas)), [*keys, "inner_group"]).groupBy(*keys, "outer_group", "lambda", "inner_group").agg(F.avg(error).alias("mae"))
    score = scores.groupBy(*keys, "outer_group", "lambda").agg(F.avg("mae").alias("score"))
    listed = score.groupBy(*keys, "outer_group").agg(F.min("score").alias("best"), F.collect_list(F.struct("lambda", "score")).alias("all"))
    near = F.filter("all", lambda t: t["score"] <= F.col("best") + 1e-12)
    chosen = listed.select(*keys, "outer_group", F.array_max(F.transform(near, lambda t: t["lambda"])).alias("lambda"))
    lines = folds.filter("inner_group is null").join(chosen, [*keys, "outer_group"]).select(*keys, F.col("outer_group").alias(group), "lambda", F.col("mx").alias("_mx"), F.col("my").alias("_my"), line(F.col("lambda")).alias("_slope"))
    out = df.join(small(lines, groups), [*keys, group])
    return out.select(*df.columns, "lambda", (F.col("_my") + F.col("_slope") * (F.col(x) - F.col("_mx"))).alias("prediction"))


_LINE = ("n", "mx", "my", "sxx", "syy", "sxy")


def _merged_lines(m: DataFrame, by: list[str]) -> DataFrame:
    """Counts, means, centred products and ranges of all rows of ``m`` by ``by``."""
    centre = m.groupBy(*by).agg(*[(F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(f"c_{c}") for c in ("mx", "my")])
    dx, dy = F.col("mx") - F.col("c_mx"), F.col("my") - F.col("c_my")
    return join_same(m, centre, by).groupBy(*by).agg(
        F.sum("n").alias("n"), F.first("c_mx").alias("mx"), F.first("c_my").alias("my"), F.sum(F.col("sxx") + F.col("n") * dx * dx).alias("sxx"), F.sum(F.col("syy") + F.col("n") * dy * dy).alias("syy"),
        F.sum(F.col("sxy") + F.col("n") * dx * dy).alias("sxy"), *[f(c).alias(c) for k, f in (("low_", F.min), ("high_", F.max)) for c in (f"{k}x", f"{k}y")],
    )


def _less_line(df: DataFrame, part: str) -> DataFrame:
    """``df`` with the moments of the rows that stay when those in columns that ``part`` begins go."""
    n, gone = F.col("n"), F.col(f"{part}n")
    left = n - gone
    safe = F.when(left > 0.5, left).otherwise(1.0)
    dx, dy = F.col(f"{part}mx") - F.col("mx"), F.col(f"{part}my") - F.col("my")
    apart = n * gone / safe
    return df.withColumns({
        "n": left, "mx": F.col("mx") - dx * gone / safe, "my": F.col("my") - dy * gone / safe, "sxx": F.col("sxx") - F.col(f"{part}sxx") - apart * dx * dx,
        "syy": F.col("syy") - F.col(f"{part}syy") - apart * dy * dy, "sxy": F.col("sxy") - F.col(f"{part}sxy") - apart * dx * dy,
    })


def _checked_lines(folds: DataFrame, whole: DataFrame, m: DataFrame, keys: list[str]) -> DataFrame:
    """Folds with ``live``: whether x varies. Where x or y keeps little of its energy, the groups that stay are merged anew."""
    at = folds.join(whole.select(*keys, F.col("sxx").alias("w_sxx"), F.col("syy").alias("w_syy"), (F.col("high_x") > F.col("low_x")).alias("_varies"), (F.col("high_y") > F.col("low_y")).alias("_moves")), keys)
    risky = (F.col("_varies") & (F.col("sxx") <= GUARD * F.col("w_sxx"))) | (F.col("_moves") & (F.col("syy") <= GUARD * F.col("w_syy")))
    ids = [*keys, "outer_group", "inner_group"]
    at = written(at.filter("n > 0.5").select(*ids, *_LINE, F.col("_varies").alias("live"), risky.alias("_risky")), "folds")
    sure = at.filter("not _risky").drop("_risky")
    if not at.filter("_risky").take(1):
        return sure
    stay = at.filter("_risky").select(*ids).join(m, keys).filter((F.col("_g") != F.col("outer_group")) & (F.col("inner_group").isNull() | (F.col("_g") != F.col("inner_group"))))
    exact = _merged_lines(stay, ids)
    return written(sure.unionByName(exact.select(*ids, *_LINE, (F.col("high_x") > F.col("low_x")).alias("live"))), "folds")


# --- several features -------------------------------------------------------------------


def direction(v: Column) -> Column:
    """The vector at length one; zero stays zero."""
    size = norm(v)
    return F.transform(wide(v), lambda x: F.when(size > 0, x / size).otherwise(0.0))


def coordinates(df: DataFrame, keys: list[str], row_id: str, vectors: list[str], most_rows: int | None = None) -> DataFrame:
    """``df`` with each vector replaced by its coordinates in the space that its cohort's rows span.

    A task holds some columns of a cohort's rows and adds to the cohort's Gram matrix;
    the matrix is of at most ``most_rows`` squared, whatever the number of columns.
    """
    most_rows = most_rows or MOST_ROWS
    types = dict(df.dtypes)
    most = (df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) if keys else df.count()
    if most > most_rows:
        raise ValueError(f"vectors of so many dimensions need cohorts of at most {most_rows} rows")
    width = max(1, CHUNK_BYTES // (8 * max(most, 1)))
    named = {c: f"_v{i}" for i, c in enumerate(vectors)}
    flat = df.select(*keys, row_id, F.explode(F.array(*[F.struct(F.lit(n).alias("_view"), wide(F.col(c)).alias("_v")) for c, n in named.items()])).alias("_s")).select(*keys, row_id, "_s.*")
    cuts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size("_v") / width) - 1, F.lit(0)).cast("int"))
    slices = flat.select(*keys, "_view", row_id, F.posexplode(F.transform(cuts, lambda b: F.slice("_v", b * width + 1, width))).alias("_block", "_x"))
    blocks = slices.groupBy(*keys, "_view", "_block").agg(F.array_sort(F.collect_list(F.struct(row_id, "_x"))).alias("_s")).select(*keys, "_view", F.size("_s").alias("_n"), F.col(f"_s.{row_id}").alias("_rows"), F.flatten("_s._x").alias("_x"))
    by = [*keys, "_view"]
    text, schema = _schema(blocks, by, [("_rows", dict(blocks.dtypes)["_rows"]), ("c", "binary")])

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, key in enumerate(_keys(batch, by)):
                x = batch.column("_x")[i].values.to_numpy(zero_copy_only=False).reshape(batch.column("_n")[i].as_py(), -1)
                x = x - x.mean(axis=0)
                yield _frame(schema, [(*key, batch.column("_rows")[i].as_py(), (x @ x.T).tobytes())])

    sums = _summed(blocks.mapInArrow(gram, text), [*by, "_rows"])
    out_schema = ", ".join([*(f"{c} {types[c]}" for c in (*keys, row_id)), "_view string, _c array<double>"])

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            for row in rows.to_dict("records"):
                g = np.frombuffer(row["c"]).reshape(len(row["_rows"]), -1)
                value, axes = np.linalg.eigh((g + g.T) / 2)
                flat = np.pad(axes * np.sqrt(np.maximum(value, 0.0)), ((0, 0), (0, most - len(g))))
                yield pd.DataFrame({**{k: [row[k]] * len(g) for k in keys}, row_id: row["_rows"], "_view": row["_view"], "_c": list(flat)})

    each = sums.mapInPandas(spread, out_schema)
    back = each.groupBy(*keys, row_id).agg(*[F.max_by("_c", F.when(F.col("_view") == n, F.lit(1))).alias(c) for c, n in named.items()])
    return df.drop(*vectors).join(back, [*keys, row_id])


def _weights(var: np.ndarray, live: np.ndarray, blocks: list[tuple[str, list[list[int]]]], model: str) -> np.ndarray:
    """The factor of each column: its block's share of the weight, over its scale; zero where it is inactive."""
    scales = [[(view, var[view].sum()) for view in views if live[view].any()] for _, views in blocks]
    times = [MODELS[model].count(name) if some else 0 for (name, _), some in zip(blocks, scales)]
    out = np.zeros(len(var))
    for some, t in zip(scales, times):
        for view, s in some:
            out[view] = np.sqrt(t / sum(times) / len(some) / s)
    return out


def solve(m: Moments, live: np.ndarray, blocks: list[tuple[str, list[list[int]]]], model: str, lambdas: tuple[float, ...], direct: bool = False) -> list[tuple[float, float, np.ndarray]]:
    """(lambda, intercept at the columns' means, coefficients) of raw features, from one eigendecomposition or, ``direct``, a solve for each lambda.

    The last column of ``m`` is the outcome. ``live`` says which columns vary.
    """
    if not m.n > 0.5:
        raise ValueError("a fold has no training rows")
    used = np.array([c for _, views in blocks for view in views for c in view], int)
    w = _weights(np.diag(m.c)[:-1] / m.n, live[:-1], blocks, model)[used]
    a, b = m.c[np.ix_(used, used)] / m.n * np.outer(w, w), m.c[used, -1] / m.n * w
    if direct:
        fits = [np.linalg.solve(a + lam * np.eye(len(a)), b) for lam in lambdas]
    else:
        value, axes = np.linalg.eigh((a + a.T) / 2)
        if len(value) and value.min() < -1e-9 * max(1.0, value.max()):
            raise ValueError("the moments aren't positive semidefinite")
        fits = [axes @ ((axes.T @ b) / (np.maximum(value, 0.0) + lam)) for lam in lambdas]
    out = []
    for lam, f in zip(lambdas, fits):
        beta = np.zeros(len(m.mean) - 1)
        beta[used] = f * w
        out.append((lam, float(m.mean[-1]), beta))
    return out


def _picked(df: DataFrame, prefix: str, fields: list[str]) -> list[Column]:
    return [F.col(f).alias(f"{prefix}{f}") for f in fields]


def _fits(folds: DataFrame, by: list[str], parts: list[str], layout: dict[str, list], lambdas: tuple[float, ...]) -> DataFrame:
    """(by, model, train_n, centre, levels, betas, betas2) for each fold and model.

    A fold trains on the moments ``w_`` less those of ``parts``. ``betas`` and ``betas2``
    are the coefficients of all lambdas end to end, by two solvers (``betas2`` for
    folds without an ``inner`` alone); ``centre`` is the training mean of the columns.
    """
    text, schema = _schema(folds, by, [("model", "string"), ("train_n", "long"), ("level", "double"), ("centre", "binary"), ("betas", "binary"), ("betas2", "binary")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, key in enumerate(_keys(batch, by)):
                whole = read(batch, i, "w_")
                m = whole
                for p in parts:
                    if (part := read(batch, i, p)) is not None:
                        m = m.without(part)
                out = []
                for model, blocks in layout.items():
                    found = solve(m, whole.high > whole.low, blocks, model, lambdas)
                    again = solve(m, whole.high > whole.low, blocks, model, lambdas, direct=True) if key[-1] is None else None
                    laid = [None if f is None else np.concatenate([b for *_, b in f]).tobytes() for f in (found, again)]
                    out.append((*key, model, int(round(m.n)), found[0][1], m.mean[:-1].tobytes(), *laid))
                yield _frame(schema, out)

    return folds.mapInArrow(run, text)


def _risky(folds: DataFrame, by: list[str], parts: list[str]) -> DataFrame:
    """(by, left, risky): how many rows each fold trains on, and whether subtraction would lose a column; from the diagonals alone."""
    text, schema = _schema(folds, by, [("left", "long"), ("own", "long"), ("risky", "boolean")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, key in enumerate(_keys(batch, by)):
                whole = m = read(batch, i, "w_", True)
                for p in parts:
                    if (part := read(batch, i, p, True)) is not None:
                        before, m = m.n, m.without(part)
                out.append((*key, int(round(m.n)), int(round(before - m.n)), bool(m.risky(whole).any()) if m.n > 0.5 else False))
            if out:
                yield _frame(schema, out)

    return folds.mapInArrow(run, text)


def _masked(chunks: DataFrame, keys: list[str], touched: DataFrame, keep: bool) -> DataFrame:
    """Chunks of each (keys, outer, grp) of ``touched``, of the rows that ``outer`` purges or, with ``keep``, of the others."""
    there = F.transform("gone", lambda g: F.array_contains(g, F.col("outer")))
    at = F.filter(F.sequence(F.lit(0), F.size("y") - 1), lambda i: F.get("_hit", i) != F.lit(keep))
    joined = chunks.join(touched, [*keys, "grp"]).withColumn("_hit", there).withColumn("_at", at).filter(F.size("_at") > 0)
    width = F.col("_width")
    x = F.flatten(F.transform("_at", lambda i: F.slice("x", i * width + 1, width)))
    return joined.withColumn("_width", (F.size("x") / F.size("y")).cast("int")).select(*keys, "outer", "grp", "chunk", F.transform("_at", lambda i: F.get("y", i)).alias("y"), x.alias("x"))


def nested_loeo(
    df: DataFrame, keys: list[str], group: str, row_id: str, y: str, scalars: list[str], vector: list[str] = [], reference: list[str] = [],
    models: tuple[str, ...] = ("scalar", "signed"), span: tuple[str, str] | None = None, bin_size: int = 1 << 15, lambdas: tuple[float, ...] = LAMBDAS,
) -> DataFrame:
    """Held-out predictions of every (keys, model, fold): (keys, model, group, row_id, truth, prediction, lambda, gap, train_n, purged_n).

    With ``span`` (closed start and end of each row's window) rows whose window overlaps
    any window of the held-out group are purged from training. ``vector`` and
    ``reference`` name array columns, one for each view. ``gap`` is how far two solvers'
    predictions lie apart; a run fails where that is more than 1e-7. Raises where a
    feature or an outcome isn't finite or a fold has nothing to train on.
    """
    if not keys:
        return nested_loeo(df.withColumn("_all", F.lit(0)), ["_all"], group, row_id, y, scalars, vector, reference, models, span, bin_size, lambdas).drop("_all")
    views = {"vector": vector, "reference": reference, "direction": vector}
    columns = {f"{name}{i}": direction(F.col(c)) if name == "direction" else wide(F.col(c)) for name, cs in views.items() if any(name in MODELS[m] for m in models) for i, c in enumerate(cs)}
    rows = df.select(*keys, F.col(group).alias("grp"), F.col(row_id).alias("row"), F.col(y).cast("double").alias("y"), *[F.col(c).cast("double").alias(c) for c in scalars], *[v.alias(c) for c, v in columns.items()], *(span or ()))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    bad = reduce(lambda a, b: a | b, [odd(F.col(c)) for c in ("y", *scalars)] + [F.exists(c, odd) for c in columns])
    rows = require(rows, ~bad, "features and outcomes must be finite")
    counts = written(rows.groupBy(*keys, "grp").agg(F.count("*").alias("_n"), *[F.max(F.size(c)).alias(c) for c in columns]), "counts")
    sizes = {c: n or 0 for c, n in (counts.agg(*[F.max(c).alias(c) for c in columns]).first().asDict() if columns else {}).items()}
    if len(scalars) + sum(sizes.values()) > MOST_COLUMNS:
        rows = coordinates(rows, keys, "row", list(columns))
        sizes = rows.agg(*[F.max(F.size(c)).alias(c) for c in columns]).first().asDict()
    width = len(scalars) + sum(sizes.values())
    gone = _purged(rows, keys, span, bin_size) if span else None
    rows = rows.select(*keys, "grp", "row", "y", F.concat(*([F.array(*scalars)] if scalars else []), *columns).alias("all"))
    if gone is not None:
        rows = rows.join(gone, [*keys, "row"], "left").withColumn("gone", F.coalesce("gone", F.array().cast(dict(gone.dtypes)["gone"])))
    chunks = written(chunked(rows, [*keys, "grp"], width, ["row", "y", *(["gone"] if span else [])], counts.select(*keys, "grp", "_n")), "chunks")
    starts, at = {}, len(scalars)
    for c, n in sizes.items():
        starts[c], at = at, at + n
    layout = {m: [(name, [[i] for i in range(len(scalars))] if name == "scalars" else [list(range(starts[f"{name}{i}"], starts[f"{name}{i}"] + sizes[f"{name}{i}"])) for i in range(len(views[name]))]) for name in dict.fromkeys(MODELS[m])] for m in models}
    done = _held_out(chunks, keys, width + 1, layout, lambdas)
    done = require(done, F.col("gap") <= 1e-7, "two solvers differ")
    return done.select(*keys, "model", F.col("grp").alias(group), F.col("row").alias(row_id), "truth", "prediction", "lambda", "gap", "train_n", "purged_n")


def _purged(rows: DataFrame, keys: list[str], span: tuple[str, str], bin_size: int) -> DataFrame:
    """(keys, row, gone): the other groups with a window that overlaps the row's; a row meets their merged windows."""
    merged_windows = interval_union(rows.select(*keys, F.col("grp").alias("outer"), F.col(span[0]).alias("_from"), F.col(span[1]).alias("_to")), [*keys, "outer"], "_from", "_to")
    met = overlap_join(rows.select(*keys, "grp", "row", *span), merged_windows, keys, span, ("_from", "_to"), bin_size).filter("grp <> outer")
    return met.groupBy(*keys, "row").agg(F.collect_set("outer").alias("gone"))


def _held_out(chunks: DataFrame, keys: list[str], width: int, layout: dict[str, list], lambdas: tuple[float, ...]) -> DataFrame:
    """All models' held-out predictions of all folds."""
    fields, grp_type = [k for k, _ in FIELDS], dict(chunks.dtypes)["grp"]
    each = moments(chunks, [*keys, "grp"], width, written)
    whole = written(merged(each, keys, ["grp"]), "whole")
    wholes = whole.select(*keys, *_picked(whole, "w_", fields))
    outer = each.select(*keys, F.col("grp").alias("outer"), F.lit(None).cast(grp_type).alias("inner"), *_picked(each, "o_", fields))
    empty = [F.lit(None).cast(t).alias(f"i_{k}") for k, t in FIELDS]
    inner = each.select(*keys, F.col("grp").alias("inner"), *_picked(each, "i_", fields))
    parts, ids = ["o_", "i_"], [*keys, "outer", "inner"]
    folds = outer.select("*", *empty).unionByName(outer.drop("inner").join(inner, keys).filter("inner <> outer").select(*ids, *[f"{p}{k}" for p in parts for k in fields]))
    kept = purged_n = None
    if "gone" in chunks.columns:
        touched = written(chunks.select(*keys, "grp", F.explode(F.array_distinct(F.flatten("gone"))).alias("outer")).distinct(), "touched")
        lost = moments(_masked(chunks, keys, touched, False), [*keys, "outer", "grp"], width, written)
        lost_all = written(merged(lost, [*keys, "outer"], ["grp"]), "lost")
        purged_n = lost_all.select(*keys, "outer", F.col("n").alias("purged_n"))
        # what the inner group lost to the purge is among what the outer fold lost already
        back = lost.select(*keys, "outer", F.col("grp").alias("inner"), *_picked(lost, "b_", fields))
        folds = folds.join(lost_all.select(*keys, "outer", *_picked(lost_all, "l_", fields)), [*keys, "outer"], "left").join(back, ids, "left")
        parts = ["o_", "l_", "i_"]
    folds = folds.join(wholes, keys)
    if "gone" in chunks.columns:
        folds = _less_returned(folds, ids, fields)
    checked = written(_risky(folds.select(*ids, *[f"{p}{k}" for p in ("w_", *parts) for k in fields if k != "c"]), ids, parts), "checked")
    # a group that is purged whole tunes nothing; one that is all there is to train on can't be held out of it
    usable = checked.filter(F.col("inner").isNull() | ((F.col("own") > 0) & (F.col("left") > 0)))
    sure = _same(folds, usable.filter("not risky").select(*ids), ids)
    fits = _fits(sure, ids, parts, layout, lambdas)
    if checked.filter("risky").take(1):
        again = usable.filter("risky").select(*ids)
        stay = again.join(each.select(*keys, "grp", *[k for k in fields if k != "var"]), keys).filter((F.col("grp") != F.col("outer")) & (F.col("inner").isNull() | (F.col("grp") != F.col("inner"))))
        if purged_n is not None:
            part = touched.join(again.select(*keys, "outer").distinct(), [*keys, "outer"], "left_semi")
            left = moments(_masked(chunks, keys, part, True), [*keys, "outer", "grp"], width, written)
            untouched = stay.join(touched, [*keys, "outer", "grp"], "left_anti")
            anew = again.join(left.select(*keys, "outer", "grp", *[k for k in fields if k != "var"]), [*keys, "outer"]).filter(F.col("inner").isNull() | (F.col("grp") != F.col("inner")))
            stay = untouched.unionByName(anew.select(*untouched.columns))
        exact = merged(stay, ids, ["grp"])
        fits = fits.unionByName(_fits(exact.select(*ids, *_picked(exact, "w_", fields)), ids, [], layout, lambdas))
    fits = written(fits, "fits")
    tuned = _judged(chunks, fits.filter("inner is not null"), keys)
    score = tuned.groupBy(*keys, "model", "outer", "at").agg(F.avg("mae").alias("score"))
    listed = score.groupBy(*keys, "model", "outer").agg(F.min("score").alias("best"), F.collect_list(F.struct("at", "score")).alias("all"))
    near = F.filter("all", lambda t: t["score"] <= F.col("best") + 1e-12)
    order = sorted(range(len(lambdas)), key=lambda i: lambdas[i])
    rank = F.array(*[F.lit(order.index(i)) for i in range(len(lambdas))])
    chosen = listed.select(*keys, "model", "outer", F.array_max(F.transform(near, lambda t: F.struct(F.get(rank, t["at"]), t["at"].alias("at"))))["at"].alias("at"))
    # without any inner fold to judge by, the strongest regularisation
    best = fits.filter("inner is null").join(chosen, [*keys, "model", "outer"], "left").withColumn("at", F.coalesce("at", F.lit(order[-1])))
    if purged_n is None:
        best = best.withColumn("purged_n", F.lit(0).cast("long"))
    else:
        best = best.join(purged_n, [*keys, "outer"], "left").withColumn("purged_n", F.coalesce("purged_n", F.lit(0).cast("long")))
    return _predicted(chunks, best, keys, lambdas)


def _same(df: DataFrame, chosen: DataFrame, ids: list[str]) -> DataFrame:
    """Rows of ``df`` whose ids ``chosen`` has; null is an id."""
    named = chosen.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(ids)])
    return df.join(named, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_c{i}")) for i, c in enumerate(ids)]), "left_semi")


def _less_returned(folds: DataFrame, ids: list[str], fields: list[str]) -> DataFrame:
    """Folds in whose inner group ``i_`` the rows that the outer fold purged already (``b_``) aren't counted again."""
    rest = [c for c in folds.columns if c not in ids and not c.startswith(("i_", "b_"))]
    own = [(f"i_{k}", t) for k, t in FIELDS]
    types = dict(folds.dtypes)
    text, schema = _schema(folds, ids, [*((c, types[c]) for c in rest), *own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                columns = [batch.column(c).slice(i, 1) for c in (*ids, *rest)]
                part, returned = read(batch, i, "i_"), read(batch, i, "b_")
                if part is None or returned is None:
                    last = [batch.column(c).slice(i, 1) for c, _ in own]
                else:
                    m = part.without(returned)
                    values = (int(round(m.n)), m.mean, m.low, m.high, np.diag(m.c), np.ascontiguousarray(m.c).tobytes())
                    last = [pa.array([v], schema.field(c).type) for (c, _), v in zip(own, values)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*columns, *last], schema)], schema=schema)

    return folds.mapInArrow(run, text)


def _lines(fits: list[dict], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A common centre, and about it the coefficients (fits, lambdas, columns) and constants (fits, lambdas)."""
    betas = np.stack([np.frombuffer(f["betas"]).reshape(-1, width) for f in fits])
    centres, levels = np.stack([np.frombuffer(f["centre"]) for f in fits]), np.array([f["level"] for f in fits])
    return centres[0], betas, levels[:, None] - np.einsum("flc,fc->fl", betas, centres - centres[0])


def _judged(chunks: DataFrame, fits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, model, outer, grp, at, mae): the mean error of each inner fold, for lambda number ``at``; purged rows don't judge."""
    types = dict(fits.dtypes)
    held = fits.groupBy(*keys, F.col("inner").alias("grp")).agg(F.collect_list(F.struct("model", "outer", "level", "centre", "betas")).alias("fits"))
    by = [*keys, "grp"]
    text, schema = _schema(chunks, by, [("model", "string"), ("outer", types["outer"]), ("total", "array<double>"), ("n", "long")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, key in enumerate(_keys(batch, by)):
                a, found = matrix(batch, i), batch.column("fits")[i].as_py()
                centre, betas, constant = _lines(found, a.shape[1] - 1)
                said = (a[:, :-1] - centre) @ betas.reshape(-1, a.shape[1] - 1).T + constant.ravel()
                wrong = np.abs(a[:, -1:] - said).reshape(len(a), len(found), -1)
                gone = [set(g) for g in batch.column("gone")[i].as_py()] if "gone" in batch.schema.names else None
                out = []
                for j, f in enumerate(found):
                    judged = slice(None) if gone is None else np.array([f["outer"] not in g for g in gone])
                    out.append((*key, f["model"], f["outer"], wrong[judged, j].sum(axis=0), len(wrong[judged, j])))
                yield _frame(schema, out)

    parts = chunks.join(held, by).mapInArrow(run, text).filter("n > 0").select(*by, "model", "outer", "n", F.posexplode("total").alias("at", "total"))
    return parts.groupBy(*by, "model", "outer", "at").agg((F.sum("total") / F.sum("n")).alias("mae"))


def _predicted(chunks: DataFrame, best: DataFrame, keys: list[str], lambdas: tuple[float, ...]) -> DataFrame:
    """(keys, model, grp, row, truth, prediction, lambda, gap, train_n, purged_n) of every row, by its own fold's fits."""
    by, types = [*keys, "grp"], dict(chunks.dtypes)
    held = best.groupBy(*keys, F.col("outer").alias("grp")).agg(F.collect_list(F.struct("model", "at", "level", "centre", "betas", "betas2", "train_n", "purged_n")).alias("fits"))
    row_type = types["row"].removeprefix("array<").removesuffix(">")
    text, schema = _schema(chunks, keys, [("model", "string"), ("grp", types["grp"]), ("row", row_type), ("truth", "double"), ("prediction", "double"), ("lambda", "double"), ("gap", "double"), ("train_n", "long"), ("purged_n", "long")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, key in enumerate(_keys(batch, by)):
                a, names = matrix(batch, i), batch.column("row")[i].values
                x, y = a[:, :-1], a[:, -1]
                for f in batch.column("fits")[i].as_py():
                    first, second = (f["level"] + (x - np.frombuffer(f["centre"])) @ np.frombuffer(f[b]).reshape(-1, x.shape[1])[f["at"]] for b in ("betas", "betas2"))
                    n = len(y)
                    same = [*[[k] * n for k in key[:-1]], [f["model"]] * n, [key[-1]] * n, names, y, first, [lambdas[f["at"]]] * n, np.abs(first - second), [f["train_n"]] * n, [f["purged_n"]] * n]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(same, schema.types)], schema=schema)

    return chunks.select(*by, "row", "x", "y").join(held, by).mapInArrow(run, text)


def paired_comparison(predictions: DataFrame, keys: list[str], group: str, base: str, added: str) -> DataFrame:
    """(keys, group, total, count): sums of |error of added| - |error of base|, the statistics of a paired bootstrap.

    A sum of differences is the difference of sums, so rows need not be paired up; both
    models must have as many rows in each group.
    """
    e, is_a, is_b = F.abs(F.col("prediction") - F.col("truth")), F.col("model") == added, F.col("model") == base
    out = predictions.filter(F.col("model").isin(base, added)).groupBy(*keys, group).agg(
        (F.sum(F.when(is_a, e)) - F.sum(F.when(is_b, e))).alias("total"), F.count_if(is_a).alias("count"), F.count_if(is_b).alias("_base")
    )
    return require(out, F.col("count") == F.col("_base"), "the models cover different rows").drop("_base")


def feature_frame(df: DataFrame, common: list[str], delta: str | None, reference: str | None, score: str | None) -> DataFrame:
    """Scalars of the models: the common ones, norms of the two vectors, and an outside score where there is one."""
    norms = {f"{v}_norm": norm(F.col(v)) for v in (delta, reference) if v}
    return df.withColumns({**norms, **{c: F.col(c).cast("double") for c in (*common, *([score] if score else []))}})


def point_contrasts(metrics: DataFrame, keys: list[str], side: str, added: str, base: str, names: list[str]) -> DataFrame:
    """Differences of each metric between two values of ``side`` (two models, or purged and ordinary folds), without intervals."""
    pick = lambda v, m: F.max(F.when(F.col(side) == v, F.col(m)))
    return metrics.groupBy(*keys).agg(*[(pick(added, m) - pick(base, m)).alias(f"delta_{m}") for m in names])
