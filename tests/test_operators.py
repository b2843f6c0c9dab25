"""Operators against brute force, and the models' invariants."""

import glob

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from helixframe.functions import spectral
from helixframe.functions import vectors as V
from helixframe.operators import aggregates as A, comoments, hashtrees, intervals, matching, ordinals, series
from helixframe.operators import joins, ordering, ranks, ridge
from helixframe import queries
from helixframe.quality import checks
from helixframe.queries import storing
from helixframe.streaming import progress
from tests.oracle import assert_same


def test_overlap_against_brute_force(spark):
    rng = np.random.default_rng(1)
    l = [(i, int(a), int(a + n)) for i, (a, n) in enumerate(zip(rng.integers(0, 400, 120), rng.integers(0, 40, 120)))]
    r = [(i, int(a), int(a + n)) for i, (a, n) in enumerate(zip(rng.integers(0, 400, 90), rng.integers(0, 90, 90)))]
    L, R = spark.createDataFrame([(1, *x) for x in l], "k int, i int, a int, b int"), spark.createDataFrame([(1, *x) for x in r], "k int, j int, c int, d int")
    want = {(x[0], y[0]) for x in l for y in r if x[1] <= y[2] and x[2] >= y[1]}
    got = joins.overlap_join(L, R, ["k"], ("a", "b"), ("c", "d"), 16).select("i", "j").collect()
    assert len(got) == len(want) and {tuple(x) for x in got} == want
    hit = {x["i"] for x in joins.overlap_exists(L, R.filter("j < 8"), ["k"], ["i"], ("a", "b"), ("c", "d"), 16).collect()}
    assert hit == {i for i, j in want if j < 8}
    miss = {x["i"] for x in joins.overlap_exists(L, R.filter("j < 8"), ["k"], ["i"], ("a", "b"), ("c", "d"), 16, keep=False).collect()}
    assert miss == {x[0] for x in l} - hit


def test_closed_interval_edges(spark):
    L = spark.createDataFrame([(1, 1, 10)], "k int, a int, b int")
    R = lambda c: spark.createDataFrame([(1, c, c + 9)], "k int, c int, d int")
    assert joins.overlap_join(L, R(10), ["k"], ("a", "b"), ("c", "d"), 10).count() == 1
    assert joins.overlap_join(L, R(11), ["k"], ("a", "b"), ("c", "d"), 10).count() == 0


def test_cardinality_is_checked(spark):
    a, b = spark.range(3), spark.createDataFrame([(0,), (0,), (1,)], "id long")
    with pytest.raises(joins.CardinalityError):
        joins.one_to_one(a, b, ["id"])
    with pytest.raises(joins.CardinalityError):
        joins.one_to_one(a, spark.range(2), ["id"])
    with pytest.raises(PySparkException):
        joins.aligned(a, spark.range(4), ["id"]).collect()
    with pytest.raises(PySparkException):
        checks.require(a, F.col("id") < 2, "too large").collect()


def test_spearman_of_a_constant_is_undefined(spark):
    df = spark.createDataFrame([("c", 1.0, float(i)) for i in range(4)] + [("v", float(i * i), -float(i)) for i in range(4)], "g string, x double, y double")
    got = {r["g"]: (r["spearman"], r["spearman_defined"]) for r in A.spearman(df, ["g"], "x", "y").collect()}
    assert got["c"] == (None, False) and got["v"][1] and abs(got["v"][0] + 1) < 1e-12


def test_nulls_do_not_rank_and_controls_are_used_once(spark):
    rows = [("a", "g", 1, 9.0), ("b", "g", 2, 8.5), ("c", "g", 1, 8.4), ("d", "g", 3, 8.3), ("e", "g", 4, None), ("f", "h", 4, 1.0)]
    df = spark.createDataFrame(rows, "id string, grp string, locus int, m double")
    assert {r["id"] for r in ordering.top_labels(df, "id", [("m", "top")], 9).collect()} == set("abcdf")
    top = df.filter("id in ('a', 'b')").withColumn("ordinal", F.when(F.col("id") == "a", 1).otherwise(2))
    got = {r["id"]: r["control"] for r in matching.matched_controls(top, df, "id", ["grp"], "locus", "m").collect()}
    assert got == {"a": "c", "b": "d"}  # c shares a's locus; it is gone when b's turn comes, and e has no metric


@pytest.mark.parametrize("seed, locus_of", [(1, 3), (3, 60)])
def test_matching_in_rounds_is_the_walk_in_turn(spark, seed, locus_of):
    """One hot group of two, loci that run out, rows that wander, equal metrics, null loci and metrics."""
    r = np.random.default_rng(seed)
    rows = [(i, "hot" if r.random() < 0.8 else "cold", None if r.random() < 0.05 else int(r.integers(0, locus_of)), None if r.random() < 0.05 else float(r.integers(0, 40))) for i in range(260)]
    names = [int(x) for x in r.permutation(260)[:110]]
    turn = {k: n // 2 for n, k in enumerate(names)}  # pairs of rows share an ordinal
    df = spark.createDataFrame(rows, "id long, grp string, locus int, m double")
    chosen = df.join(spark.createDataFrame(list(turn.items()), "id long, ordinal long"), "id")
    by, used, want = {x[0]: x for x in rows}, set(names), {}
    for k in sorted(names, key=lambda k: (turn[k], k)):
        free = [x for x in rows if x[0] not in used and x[1] == by[k][1] and x[3] is not None]
        if free:
            best = min(free, key=lambda x: (x[2] is None or x[2] != by[k][2], x[3], x[0]))
            want[k] = best[0]
            used.add(best[0])
    got = {x["id"]: x["control"] for x in matching.matched_controls(chosen, df, "id", ["grp"], "locus", "m", 8).collect()}
    assert got == want


def test_hash_trees_of_arrays(spark, tmp_path):
    r = np.random.default_rng(5)
    arrays = {k: r.normal(size=n).tolist() for k, n in enumerate((0, 1, 7, 64, 65, 300, 5000, 20))}
    other = {k: list(v) for k, v in arrays.items()} | {9: [1.0]}
    other[5][299] += 2.0
    for i in (17, 18, 4000):
        other[6][i] -= 0.5
    other[4] = other[4][:40]
    other[7][3], arrays[7][3] = -0.0, 0.0
    other[3][10] = arrays[3][10] = float("nan")
    arrays[2][1], other[2][1] = None, 1.0
    frames = [spark.createDataFrame([*x.items(), *extra], "k long, v array<double>") for x, extra in ((arrays, [(8, None)]), (other, [(8, [])]))]
    assert [hashtrees.write_tree(f, ["k"], "v", str(tmp_path / n), 8, 4, 16) for f, n in zip(frames, "ab")] == [6, 6]
    got = {x["k"]: tuple(x)[1:] for x in hashtrees.differences(spark, str(tmp_path / "a"), str(tmp_path / "b")).collect()}
    same = (0, None, None, 0)
    assert got == {0: same, 1: same, 2: (1, 1, pytest.approx(max(abs(x - y) for x, y in zip(arrays[2], other[2]) if x is not None), abs=1), 1), 3: same, 4: (25, 40, None, 4), 5: (1, 299, pytest.approx(2.0), 1), 6: (3, 17, pytest.approx(0.5), 2), 7: same, 8: same, 9: (1, 0, None, 1)}
    assert hashtrees.unequal_blocks(spark, str(tmp_path / "a"), str(tmp_path / "a")).count() == 0
    hashtrees.write_tree(frames[0], ["k"], "v", str(tmp_path / "c"), 16, 4, 16)
    with pytest.raises(ValueError):
        hashtrees.differences(spark, str(tmp_path / "a"), str(tmp_path / "c"))


def test_every_kth_over_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 3).alias("g"))
    assert sorted(r["g"] for r in ordering.every_kth(df, "g", 100).collect()) == [300 * i for i in range(10)]


def test_vector_edges(spark):
    df = spark.createDataFrame([([0.0, 0.0], [3.0, 4.0])], "z array<double>, v array<double>")
    r = df.select(V.unit_direction(F.col("z")).alias("z"), V.unit_direction(F.col("v")).alias("v"), V.relative_l2(F.col("v"), F.col("z")).alias("l"), V.first_change(F.col("v"), F.col("v")).alias("f"), V.cosine_distance(F.col("v"), F.col("z")).alias("c")).first()
    assert r["z"] == [0, 0] and r["v"] == [0.6, 0.8] and r["l"] == pytest.approx(5e30) and r["f"] is None and r["c"] == 1.0
    assert spectral.to_bfloat16(np.array([1.0, 1.00390625, 3.14159], np.float32)).tolist() == [1.0, 1.0, 3.140625]


def test_impulse_response(spark):
    taps = [float(x) for x in np.random.default_rng(2).normal(size=128)]
    df = spark.createDataFrame([([1.0] + [0.0] * 199,)], "u array<double>")
    r = df.select(V.direct_fir(F.col("u"), taps).alias("y"), spectral.fft_convolution(taps)("u").alias("z")).first()
    assert np.allclose(r["y"], taps + [0.0] * 72) and np.allclose(r["z"], r["y"])


# --- models -------------------------------------------------------------------------


def cohort(seed=1, groups=6, per=5):
    rng = np.random.default_rng(seed)
    n = groups * per
    return rng.normal(size=n), np.repeat(np.arange(groups), per), rng.normal(size=(n, 3)), rng.normal(size=(n, 16))


def features(blocks, train):
    """Centred, scaled and weighted features of all rows, written out from the definition; blocks are lists of matrices."""
    parts = []
    for block in blocks:
        views = []
        for x in block:
            x = x - x[train].mean(axis=0)
            size = np.sqrt((x[train] ** 2).sum(axis=1).mean())
            if size > 1e-9:
                views.append(x / size)
        if views:
            parts.append(np.hstack(views) / np.sqrt(len(views)))
    return np.hstack(parts) / np.sqrt(len(parts)) if parts else np.zeros((len(train), 0))


def dual(blocks, y, train, test, lam):
    f = features(blocks, train)
    a, b, mean = f[train], f[test], y[train].mean()
    return mean + b @ a.T @ np.linalg.solve(a @ a.T + lam * train.sum() * np.eye(train.sum()), y[train] - mean)


def plain_loeo(blocks, y, g, allowed=lambda fold: True):
    out, lams = np.zeros(len(y)), np.zeros(len(y))
    for fold in np.unique(g):
        train = (g != fold) & allowed(fold)
        scores = [np.mean([np.abs(dual(blocks, y, train & (g != i), train & (g == i), lam) - y[train & (g == i)]).mean() for i in np.unique(g[train])]) for lam in ridge.LAMBDAS]
        lam = max(v for v, s in zip(ridge.LAMBDAS, scores) if s <= min(scores) + 1e-12)
        out[g == fold], lams[g == fold] = dual(blocks, y, train, g == fold, lam), lam
    return out, lams


COHORT = "id int, g int, y double, x0 double, x1 double, x2 double, v array<double>, w array<double>, r array<double>, a int, b int"


def loeo(spark, y, g, s, v, models, w=None, r=None, vector=("v",), **more):
    start = np.arange(len(y)) * 4
    rows = [(i, int(g[i]), float(y[i]), *map(float, s[i]), v[i].tolist(), (v if w is None else w)[i].tolist(), (v if r is None else r)[i].tolist(), int(start[i]), int(start[i] + 9)) for i in range(len(y))]
    found = ridge.nested_loeo(spark.createDataFrame(rows, COHORT), [], "g", "id", "y", ["x0", "x1", "x2"], list(vector), ["r"], models=models, **more)
    return {(x["model"], x["id"]): x for x in found.collect()}


@pytest.mark.parametrize("most", [512, 4])
def test_models_equal_their_definition(spark, most, monkeypatch):
    monkeypatch.setattr(ridge, "MOST_COLUMNS", most)  # 4: by way of coordinates
    y, g, s, v = cohort()
    w, r = np.random.default_rng(3).normal(size=(2, *v.shape))
    v, s = v + 1e4, s * [1, 1, 0] + [1e6, 0, 5]  # far from zero; a column without range
    y = y + 3 * s[:, 1] + v[:, 0] - 1e4
    cols, unit = [s[:, [i]] for i in range(3)], lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {"scalar": [cols], "signed": [cols, [v, w]], "reference": [cols, [r]], "unit_direction": [cols, [unit(v), unit(w)]], "vector_only": [[v, w]]}
    got = loeo(spark, y, g, s, v, tuple(want), w, r, ("v", "w"))
    for model, blocks in want.items():
        p, lam = plain_loeo(blocks, y, g)
        for i in range(len(y)):
            row = got[model, i]
            assert row["prediction"] == pytest.approx(p[i], abs=2e-5 if model == "unit_direction" else 1e-6) and row["lambda"] == lam[i] and row["gap"] <= 1e-7 and row["train_n"] == (g != g[i]).sum(), (model, i)


def test_duplicate_is_exact_and_held_out_rows_do_not_leak(spark):
    y, g, s, v = cohort()
    base = loeo(spark, y, g, s, v, ("scalar", "duplicate_scalar", "signed"))
    n = len(y)
    assert all(base["scalar", i]["prediction"] == base["duplicate_scalar", i]["prediction"] for i in range(n))
    moved = y.copy()
    moved[g == 2] += 100
    again = loeo(spark, moved, g, s, v, ("signed",))
    assert all(base["signed", i]["prediction"] == pytest.approx(again["signed", i]["prediction"], abs=1e-9) and base["signed", i]["lambda"] == again["signed", i]["lambda"] for i in np.flatnonzero(g == 2))
    with pytest.raises(Exception, match="finite"):
        loeo(spark, np.where(g == 1, np.nan, y), g, s, v, ("scalar",))
    with pytest.raises(Exception, match="no training rows"):
        loeo(spark, y, g * 0, s, v, ("scalar",))
    with pytest.raises(ValueError, match="at most 10 rows"):
        ridge.coordinates(spark.range(11).select(F.lit(1).alias("k"), "id", F.array(F.lit(1.0)).alias("v")), ["k"], "id", ["v"], 10)


def test_constant_features_are_inactive(spark):
    y, g, s, v = cohort(4)
    got = loeo(spark, y, g, np.ones_like(s), v * 0 + 2.0, ("signed",))
    for i in range(len(y)):
        assert got["signed", i]["prediction"] == pytest.approx(y[g != g[i]].mean(), abs=1e-9)


def test_purged_rows_do_not_train(spark):
    y, g, s, v = cohort(5)
    start = np.arange(len(y)) * 4

    def allowed(fold):
        held = g == fold
        return ~((start[:, None] <= start[held] + 9) & (start[:, None] + 9 >= start[held])).any(axis=1)

    run = lambda y, s, v: loeo(spark, y, g, s, v, ("signed",), span=("a", "b"), bin_size=16)
    base = run(y, s, v)
    p, lam = plain_loeo([[s[:, [i]] for i in range(3)], [v]], y, g, allowed)
    for i in range(len(y)):
        row = base["signed", i]
        assert row["prediction"] == pytest.approx(p[i], abs=1e-8) and row["lambda"] == lam[i] and row["purged_n"] == ((g != g[i]) & ~allowed(g[i])).sum() > 0
    lost = (g != 2) & ~allowed(2)
    again = run(np.where(lost, 50.0, y), np.where(lost[:, None], -9.0, s), np.where(lost[:, None], 7.0, v))
    assert all(base["signed", i]["prediction"] == pytest.approx(again["signed", i]["prediction"], abs=1e-6) for i in np.flatnonzero(g == 2))


def test_units_and_shifts_change_nothing(spark):
    y, g, s, v = cohort(7)
    base = loeo(spark, y, g, s, v, ("signed", "scalar"))
    for scale, shift in ((1e-7, 0.0), (1e-12, 0.0), (1e9, 0.0), (1.0, 1e8)):
        got = loeo(spark, y, g, s * scale + shift, v * scale + shift, ("signed", "scalar"))
        for k, row in got.items():
            assert row["prediction"] == pytest.approx(base[k]["prediction"], abs=1e-5 if shift else 1e-9) and row["lambda"] == base[k]["lambda"]


@pytest.mark.parametrize("purge", [False, True])
def test_a_group_that_holds_nearly_all_energy(spark, purge):
    y, g, s, v = cohort(8)
    s, v, y = s.copy(), v.copy(), y.copy()
    s[g == 2] *= 1e7  # folds that hold group 2 out keep a 1e-14th
    v[g == 2] += 1e8
    s[g != 4, 1], v[:, 3] = 6.0, 2.0  # without range where group 4 is held out, and without any
    start = np.arange(len(y)) * 4

    def allowed(fold):
        held = g == fold
        return ~((start[:, None] <= start[held] + 9) & (start[:, None] + 9 >= start[held])).any(axis=1) if purge else True

    got = loeo(spark, y, g, s, v, ("signed", "scalar"), **({"span": ("a", "b"), "bin_size": 16} if purge else {}))
    cols = [s[:, [i]] for i in range(3)]
    for model, blocks in {"signed": [cols, [v]], "scalar": [cols]}.items():
        p, lam = plain_loeo(blocks, y, g, allowed)
        for i in np.flatnonzero(g != 2):  # the far group's own predictions are far as well
            assert got[model, i]["prediction"] == pytest.approx(p[i], abs=1e-5) and got[model, i]["lambda"] == lam[i], (model, i)


def test_blocks_of_columns_and_of_rows(spark, monkeypatch):
    y, g, s, v = cohort(11, per=9)
    want = loeo(spark, y, g, s, v, ("signed",))
    for name, value in (("BLOCK", 6), ("CHUNK_ROWS", 2), ("TOGETHER", 2)):
        monkeypatch.setattr(comoments, name, value)
    got = loeo(spark, y, g, s, v, ("signed",))
    assert all(got[k]["prediction"] == pytest.approx(want[k]["prediction"], abs=1e-10) for k in want)
    monkeypatch.setattr(ridge, "MOST_COLUMNS", 10)
    monkeypatch.setattr(ridge, "CHUNK_BYTES", 8 * len(y) * 3)  # Gram matrix from blocks of three columns
    got = loeo(spark, y, g, s, v, ("signed",))
    assert all(got[k]["prediction"] == pytest.approx(want[k]["prediction"], abs=1e-8) for k in want)


def test_interval_union(spark):
    r = np.random.default_rng(2)
    rows = [(k, int(a), int(a + n)) for k in ("a", "b", None) for a, n in zip(r.integers(0, 900, 70), r.integers(-2, 14, 70))] + [("a", None, 5), ("c", 3, 3), ("c", 3, 3), ("c", 4, 4)]
    df = spark.createDataFrame(rows, "k string, s long, e long").repartition(5)
    got = sorted(map(tuple, intervals.interval_union(df, ["k"], "s", "e").collect()), key=repr)
    want = []
    for k in ("a", "b", "c", None):
        last = None
        for s, e in sorted((s, e) for q, s, e in rows if q == k and s is not None and s <= e):
            if last and s <= last[2]:
                last[2] = max(last[2], e)
            else:
                want.append(last := [k, s, e])
    assert got == sorted(map(tuple, want), key=repr)


def test_one_feature_of_any_unit(spark):
    y, g, s, _ = cohort(9)
    x = s[:, 0].copy()
    x[g == 3] *= 1e7
    frame = lambda x: spark.createDataFrame([(i, int(g[i]), float(x[i]), float(y[i])) for i in range(len(y))], "id int, g int, x double, y double")
    run = lambda x: {r["id"]: (r["prediction"], r["lambda"]) for r in ridge.loeo_one_feature(frame(x), [], "g", "x", "y").collect()}
    p, lam = plain_loeo([[x[:, None]]], y, g)
    first, small = run(x), run(x * 1e-12)
    assert all(first[i][0] == pytest.approx(p[i], abs=1e-6 * max(1, abs(p[i]))) and first[i][1] == lam[i] == small[i][1] for i in range(len(y)))
    assert all(small[i][0] == pytest.approx(first[i][0], rel=1e-9, abs=1e-9) for i in range(len(y)))


def test_one_feature_closed_form_equals_the_definition(spark):
    y, g, s, _ = cohort(9)
    df = spark.createDataFrame([(i, int(g[i]), float(s[i, 0] + 50), float(y[i])) for i in range(len(y))], "id int, g int, x double, y double")
    closed = {r["id"]: (r["prediction"], r["lambda"]) for r in ridge.loeo_one_feature(df, [], "g", "x", "y").collect()}
    p, lam = plain_loeo([[s[:, :1] + 50]], y, g)
    assert all(closed[i][0] == pytest.approx(p[i], abs=1e-9) and closed[i][1] == lam[i] for i in range(len(y)))


def test_bootstrap_matches_a_plain_loop(spark):
    stats = [("k", i, float(i * i - 3), i + 1) for i in range(5)]
    d = ordering.draws(5, 200, 7)
    draws = spark.createDataFrame([(i, j, int(x)) for i, row in enumerate(d) for j, x in enumerate(row)], "draw int, slot int, group_idx int")
    got = ordering.bootstrap_interval(spark.createDataFrame(stats, "key string, group_idx int, total double, count long"), draws, ["key"]).first()
    t, c = np.array([s[2] for s in stats]), np.array([s[3] for s in stats])
    macro, weighted = (t / c)[d].mean(1), t[d].sum(1) / c[d].sum(1)
    assert np.allclose([got["macro_low"], got["macro_high"]], np.quantile(macro, [0.025, 0.975])) and np.allclose([got["weighted_low"], got["weighted_high"]], np.quantile(weighted, [0.025, 0.975]))


@pytest.mark.parametrize("local", [True, False])
def test_protocols(spark, tmp_path, local, monkeypatch):
    if local:
        monkeypatch.setattr(checks, "_store", lambda path: None)
    p = str(tmp_path / "protocol.json")
    assert checks.read_json(p) is None and checks.write_json_atomic(str(tmp_path / "x.json"), {"é": 1}) and checks.write_json_atomic(str(tmp_path / "x.json"), [2]) and checks.read_json(str(tmp_path / "x.json")) == [2]
    assert not checks.write_json_atomic(str(tmp_path / "x.json"), 3, replace=False) and checks.read_json(str(tmp_path / "x.json")) == [2]
    checks.freeze(p, {"b": 1, "a": [1, 2]})
    checks.freeze(p, {"a": [1, 2], "b": 1})
    with pytest.raises(ValueError):
        checks.freeze(p, {"a": [1], "b": 1})
    with pytest.raises(ValueError):
        checks.write_json_atomic(p, {"x": float("nan")})
    with pytest.raises(ValueError):
        checks.compatible({"a": 1}, {"a": 2}, ["a"])
    assert checks.fingerprint({"a": 1, "b": 2}) == checks.fingerprint({"b": 2, "a": 1})


def test_recompute_audit(spark):
    a = spark.createDataFrame([("x", 1.0, float("nan")), ("y", 2.0, None)], "k string, m double, n double")
    b = spark.createDataFrame([("x", 1.0 + 1e-12, float("nan")), ("y", 2.1, None)], "k string, m double, n double")
    got = {(r["k"], r["metric"]): r["agrees"] for r in checks.recompute_audit(a, b, ["k"], ["m", "n"]).collect()}
    assert got == {("x", "m"): True, ("x", "n"): True, ("y", "m"): False, ("y", "n"): True}


def test_percentiles_and_ranks_against_brute_force(spark):
    rng = np.random.default_rng(12)
    rows = [(k, None if rng.random() < 0.05 else float(x)) for k, n in (("a", 700), ("b", 3), (None, 90), ("c", 1)) for x in rng.choice(np.concatenate((rng.normal(size=40), [1.5] * 20)), n)]
    rows += [("d", None), ("d", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, k string, v double")
    there = {k: [v for q, v in rows if q == k and v is not None] for k in ("a", "b", None, "c", "d")}
    for bins in (4, 512):
        got = {r["k"]: r for r in ranks.percentiles(df, ["k"], "v", [0.0, 0.5, 0.9, 1.0], ["lo", "mid", "p90", "hi"], bins).collect()}
        assert set(got) == {k for k, v in there.items() if v}
        for k, r in got.items():
            assert np.allclose([r["lo"], r["mid"], r["p90"], r["hi"]], np.quantile(there[k], [0, 0.5, 0.9, 1]), atol=1e-12, rtol=0)
        for r in ranks.below(df, ["k"], "v", bins).collect():
            v = there[r["k"]]
            assert (r["_n"], r["_below"], r["_all"]) == (v.count(r["v"]), sum(x < r["v"] for x in v), len(v))
    d = {r["k"]: r for r in A.describe(df, "v", ["k"]).collect()}
    assert d["d"]["n"] == 0 and d["d"]["median"] is None and d["a"]["median"] == pytest.approx(np.median(there["a"]))
    assert A.describe(df, "v").first()["median"] == pytest.approx(np.median([v for _, v in rows if v is not None]))
    e = {r["id"]: r["ecdf"] for r in A.ecdf(df, ["k"], "v", ["id"]).collect()}
    for i, (k, v) in enumerate(rows):
        if v is not None:
            assert e[i] == pytest.approx(sum((x, j) <= (v, i) for j, (q, x) in enumerate(rows) if q == k and x is not None) / len(there[k]))
    at = {r["k"]: r["place"] for r in ranks.places(df, "k", 2).collect()}
    assert at == {None: 0, "a": 1, "b": 2, "c": 3, "d": 4}


@pytest.mark.parametrize("size", [3, 1000])
def test_counts_and_nearest_sites_over_bins(spark, size):
    rng = np.random.default_rng(7)
    spans = [(int(g), i, int(a), int(a + rng.integers(-2, 9))) for i, (g, a) in enumerate(zip(rng.integers(0, 3, 80), rng.integers(-40, 60, 80)))]
    l = spark.createDataFrame(spans[:40], "g int, i int, a int, b int")
    r = spark.createDataFrame([(g, a, b) for g, _, a, b in spans[40:]], "g int, c int, d int")
    want = {}
    for g, _, a, b in spans[:40]:
        n = sum(h == g and c <= b and d >= a for h, _, c, d in spans[40:] if c <= d) if a <= b else 0
        want[g] = want.get(g, 0) + n
    assert {x["g"]: x["overlap_pairs"] for x in joins.overlap_count(l, r, ["g"], ("a", "b"), ("c", "d"), size, ["g"]).collect()} == {g: n for g, n in want.items() if n}
    near = {x["i"]: (x["distance"], x["t"], x["s"]) for x in joins.nearest_site(l.select("g", "i", "a"), spark.createDataFrame([(g, a, i) for g, i, a, _ in spans[40:]], "g int, s int, t int"), ["g"], "a", "s", ["t"], size).collect()}
    assert near == {i: min((abs(a - c), t, c) for h, t, c, _ in spans[40:] if h == g) for g, i, a, _ in spans[:40]}


def test_lookups_of_exactly_one_row(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "k string, v int")
    assert joins.exactly_one(df, k="a", v=2).collect() == [("a", 2)] and joins.exactly_one(df, k=None).first()["v"] == 3
    for odd in ({"k": "a"}, {"k": "b"}):
        with pytest.raises(joins.CardinalityError):
            joins.exactly_one(df, **odd)


def test_forbidden_reads_are_refused(spark, tmp_path):
    for name in ("open", "closed"):
        spark.range(3).write.parquet(str(tmp_path / name))
    a, b = (spark.read.parquet(str(tmp_path / name)) for name in ("open", "closed"))
    assert checks.reads_only(a, [str(tmp_path / "open")]).count() == 3
    with pytest.raises(ValueError, match="closed"):
        checks.reads_only(a.join(b, "id"), [f"file://{tmp_path}/open"])


def test_blocked_convolution_equals_the_direct_sum(spark):
    r = np.random.default_rng(3)
    lengths, filters = {"a": 1000, "b": 65, "c": 64, "d": 1}, {"a": r.normal(size=150), "b": r.normal(size=70), "c": r.normal(size=1), "d": r.normal(size=9)}
    values = {k: r.normal(size=n) for k, n in lengths.items()}
    rows = spark.createDataFrame([(k, i, float(v)) for k, x in values.items() for i, v in enumerate(x)] + [("no filter", 0, 1.0)], "channel string, position long, value double").repartition(5)
    taps = spark.createDataFrame([(k, t.tolist()) for k, t in filters.items()], "channel string, taps array<double>")
    made = series.blocked_convolution(series.blocks_of(rows, ["channel"], "position", "value", 64), ["channel"], taps, ["channel"], 64)
    got = {(x["channel"], x["position"]): x["value"] for x in series.rows_of(made, ["channel"], size=64).collect()}
    assert len(got) == sum(lengths.values())
    for k, x in values.items():
        want = np.convolve(x, filters[k])[: len(x)]
        assert max(abs(got[k, i] - w) for i, w in enumerate(want)) < 1e-9


def test_a_million_positions(spark):
    n, taps = 1_000_000, [0.5**k for k in range(128)]
    rows = spark.range(n).select(F.lit("s").alias("channel"), F.col("id").alias("position"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0).alias("value"))
    made = series.blocked_convolution(series.blocks_of(rows, ["channel"], "position", "value"), ["channel"], spark.createDataFrame([("s", taps)], "channel string, taps array<double>"), ["channel"])
    out = series.rows_of(made, ["channel"])
    assert out.count() == n
    ends = [0, 1, 4095, 4096, 4097, 500_000, n - 1]
    near = {x["position"]: x["value"] for x in rows.filter(F.col("position").isin([e - k for e in ends for k in range(128)])).collect()}
    for x in out.filter(F.col("position").isin(ends)).collect():
        assert x["value"] == pytest.approx(sum(h * near.get(x["position"] - k, 0.0) for k, h in enumerate(taps)), abs=1e-9)


def test_ordinals_of_a_hot_key_and_of_ties(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 == 0, "b").alias("k"), (F.col("id") % 5).alias("v"), "id")
    rows = ordinals.with_ordinals(df, ["k"], ["v", "id"], total="n").collect()
    for k in ("hot", "b", None):
        mine = sorted((r for r in rows if r["k"] == k), key=lambda r: r["ordinal"])
        assert [r["ordinal"] for r in mine] == list(range(len(mine))) and [(r["v"], r["id"]) for r in mine] == sorted((r["v"], r["id"]) for r in mine) and {r["n"] for r in mine} == {len(mine)}
    same = ordinals.with_ordinals(spark.range(500).select(F.lit(1).alias("v")), [], ["v"]).collect()
    assert sorted(r["ordinal"] for r in same) == list(range(500)) and ordinals.with_ordinals(df.limit(0), ["k"], ["v"]).count() == 0
    blocks = ordinals.in_blocks(df, ["k"], ["id"], 4, 10)
    assert blocks.filter("not _halo").count() == 3000 and blocks.filter("_halo").count() == sum(4 * (n // 10) + max(0, n % 10 - 6) for n in (2000, 500, 500))


def test_rows_that_share_a_span_meet_once(spark, monkeypatch):
    monkeypatch.setattr(joins, "PACK", 7)
    rng = np.random.default_rng(4)
    l = [(int(k), i, int(a), int(a + n)) for i, (k, a, n) in enumerate(zip(rng.integers(0, 3, 80), rng.integers(-40, 60, 80), rng.integers(-2, 25, 80)))]
    r = [(int(k), j, f"x{j % 5}", int(a), int(a + n)) for j, (k, a, n) in enumerate(zip(rng.integers(0, 3, 300), rng.integers(-3, 3, 300) * 9, rng.integers(-1, 3, 300) * 10))]
    L = spark.createDataFrame([*l, (None, 900, 0, 50)], "k int, i int, a int, b int")
    R = spark.createDataFrame([*r, (None, 900, "y", 0, 50), (1, 901, None, None, 50)], "k int, j int, t string, c int, d int").repartition(3)
    want = sorted((*x, *y[1:]) for x in l for y in r if x[0] == y[0] and x[2] <= x[3] and y[3] <= y[4] and x[2] <= y[4] and x[3] >= y[3])
    got = joins.overlap_join(L, R, ["k"], ("a", "b"), ("c", "d"), 8, shared=True)
    assert got.columns == joins.overlap_join(L, R, ["k"], ("a", "b"), ("c", "d"), 8).columns
    assert sorted(tuple(x) for x in got.collect()) == want and len(want) > 1000
    lists = joins._packed(R, ["k"], ("c", "d"), "rows").select(F.size("rows").alias("n")).collect()
    assert sum(x["n"] for x in lists) == len([y for y in r if y[3] <= y[4]]) + 1 and max(x["n"] for x in lists) <= 7 and len(lists) < 120
    bare = joins.overlap_join(L.select("k", "a", "b"), R.select("k", "c", "d"), ["k"], ("a", "b"), ("c", "d"), 8, shared=True)
    assert bare.columns == ["k", "a", "b", "c", "d"] and bare.count() == len(want)


def test_pairs_of_two_shared_spans_stand_together(spark, monkeypatch):
    monkeypatch.setattr(joins, "PACK", 50)
    l = [(i % 2, i, (i % 7) * 5, (i % 7) * 5 + 12) for i in range(400)]
    r = [(j % 2, j, (j % 5) * 10, (j % 5) * 10 + 4) for j in range(300)]
    L, R = spark.createDataFrame(l, "k int, i int, a int, b int").repartition(4), spark.createDataFrame(r, "k int, j int, c int, d int").repartition(3)
    got = [tuple(x) for x in joins.overlap_join(L, R, ["k"], ("a", "b"), ("c", "d"), 16, shared=True).select("k", "a", "c", "i", "j").collect()]
    assert sorted(x[3:] for x in got) == sorted((x[1], y[1]) for x in l for y in r if x[0] == y[0] and x[2] <= y[3] and x[3] >= y[2])
    spans = len({x[:3] for x in got})
    # a block for each two lists and not for each left row and list, and in it a run for each left row
    assert sum(x[:3] != y[:3] for x, y in zip(got, got[1:])) < 3 * spans < 400
    assert sum(x[3] != y[3] for x, y in zip(got, got[1:])) < len(got) / 10



def test_rows_of_few_groups_are_not_dealt_by_group(spark):
    df = spark.range(4000).select("id", (F.col("id") % 4).alias("g"), (F.col("id") % 17).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("y"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = ridge.loeo_one_feature(df, [], "g", "x", "y")
        assert out.count() == 4000
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.index("BroadcastHashJoin") < plan.index("Range (0, 4000")
        # the last join: rows against the lines of their groups
        assert "SortMergeJoin" not in plan[: plan.index("BroadcastHashJoin")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_slowest_timings_of_the_last_steps():
    rng = np.random.default_rng(2)
    tail, seen = {}, {}
    for _ in range(6):
        steps, seconds = rng.integers(0, 40, 15), rng.random(15)
        for a, b in zip(steps.tolist(), seconds.tolist()):
            seen[a] = max(b, seen.get(a, b))
        tail = progress.slowest(tail, steps, seconds, 100)
        assert tail == seen and list(progress.slowest(tail, steps[:0], seconds[:0], 9)) == sorted(seen)[-9:]
    assert progress.slowest({}, steps[:0], seconds[:0], 9) == {}


def test_markers_go_to_more_files_as_they_grow(spark, monkeypatch):
    monkeypatch.setattr(storing, "FILE_ROWS", 300)
    files = []
    keep = progress.keep_progress
    monkeypatch.setattr(progress, "keep_progress", lambda stream, out, state: (files.extend(glob.glob(out.replace("-progress-", "-markers-").rsplit("-", 1)[0] + "-*/*.parquet")), keep(stream, out, state)))
    assert_same(spark, "/root/testdata/sf0.001", storing.stateful_progress, queries.SQL["stateful_progress"])
    assert len(files) >= 9
