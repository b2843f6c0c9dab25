"""Leave-one-group-out models and their comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions import vectors as V
from helixframe.operators import aggregates as A
from helixframe.operators import ordering as O
from helixframe.operators import ridge
from helixframe.queries import query
from helixframe.queries.summarising import rounded
from helixframe.session import table


def _cohort(spark, d):
    l = table(spark, d, "lineitem")
    return l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), (F.col("l_suppkey") % 8).alias("grp"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))


_LOEO = """z AS (SELECT l_orderkey * 10 + l_linenumber AS row_id, l_suppkey % 8 AS g, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem),
  lam AS (SELECT unnest(CAST([0.0001, 0.001, 0.01, 0.1, 1.0, 10.0] AS DOUBLE[])) AS strength), gs AS (SELECT DISTINCT g FROM z),
  inn AS (SELECT o.g AS og, i.g AS ig, avg(z.x) AS mx, avg(z.y) AS my, covar_pop(z.x, z.y) / var_pop(z.x) AS b FROM gs o JOIN gs i ON o.g <> i.g JOIN z ON z.g <> o.g AND z.g <> i.g GROUP BY 1, 2),
  sc AS (SELECT og, ig, strength, avg(abs(z.y - (my + (z.x - mx) * b / (1 + strength)))) AS mae FROM inn JOIN z ON z.g = ig CROSS JOIN lam GROUP BY 1, 2, 3),
  s2 AS (SELECT og, strength, avg(mae) AS score FROM sc GROUP BY 1, 2), ch AS (SELECT og, max(strength) AS strength FROM (SELECT *, min(score) OVER (PARTITION BY og) AS best FROM s2) WHERE score <= best + 1e-12 GROUP BY 1),
  fit AS (SELECT o.g AS og, avg(z.x) AS mx, avg(z.y) AS my, covar_pop(z.x, z.y) / var_pop(z.x) AS b FROM gs o JOIN z ON z.g <> o.g GROUP BY 1),
  pr AS (SELECT z.row_id, z.g, z.y, strength, my + (z.x - mx) * b / (1 + strength) AS prediction, my AS constant FROM z JOIN fit ON fit.og = z.g JOIN ch ON ch.og = z.g)"""


@query(f"WITH {_LOEO} SELECT row_id, g AS grp, strength, round(prediction, 5) AS prediction FROM pr")
def loeo_single_feature(spark, d):
    return rounded(ridge.loeo_one_feature(_cohort(spark, d), [], "grp", "x", "y").select("row_id", "grp", F.col("lambda").alias("strength"), "prediction"), ["prediction"], 5)


_GAP = "g2 AS (SELECT g, sum(abs(prediction - y) - abs(constant - y)) AS total, count(*) AS cnt FROM pr GROUP BY 1)"


@query(f"""WITH {_LOEO}, {_GAP}, dr AS (SELECT d.i AS draw, CAST((d.i * 7919 + s.j * 104729 + (d.i * s.j) % 101) % 8 AS INTEGER) AS g FROM (SELECT unnest(generate_series(0, 499)) AS i) d, (SELECT unnest(generate_series(0, 7)) AS j) s),
  e AS (SELECT draw, avg(total / cnt) AS macro, sum(total) / sum(cnt) AS weighted FROM g2 JOIN dr USING (g) GROUP BY 1),
  q AS (SELECT count(*) AS draws, quantile_cont(macro, 0.025) AS ml, quantile_cont(macro, 0.975) AS mh, quantile_cont(weighted, 0.025) AS wl, quantile_cont(weighted, 0.975) AS wh FROM e)
  SELECT draws, round(ml, 5) AS macro_low, round(mh, 5) AS macro_high, round(wl, 5) AS weighted_low, round(wh, 5) AS weighted_high, round((SELECT avg(total / cnt) FROM g2), 5) AS delta_macro,
  CASE WHEN mh < 0 THEN 'below zero' WHEN ml > 0 THEN 'above zero' ELSE 'includes zero' END AS interpretation FROM q""")
def paired_comparison_ci(spark, d):
    base = ridge.loeo_one_feature(_cohort(spark, d), [], "grp", "x", "y").select("row_id", "grp", F.col("y").alias("truth"), "prediction")
    sums = base.groupBy("grp").agg(F.sum("truth").alias("s"), F.count("*").alias("n"))
    whole = sums.agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    constant = sums.crossJoin(F.broadcast(whole)).select("grp", ((F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n"))).alias("constant"))
    flat = base.join(F.broadcast(constant), "grp").select("row_id", "grp", "truth", F.col("constant").alias("prediction"))  # eight groups
    both = base.withColumn("model", F.lit("added")).unionByName(flat.withColumn("model", F.lit("base")))
    stats = ridge.paired_comparison(both, [], "grp", "base", "added").withColumnRenamed("grp", "group_idx").withColumn("cohort", F.lit(1))
    i, j = F.col("draw"), F.col("slot")
    draws = spark.range(500).withColumnRenamed("id", "draw").withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("group_idx", (i * 7919 + j * 104729 + (i * j) % 101) % 8)
    ci = O.bootstrap_interval(stats, draws, ["cohort"])
    delta = stats.groupBy("cohort").agg(F.avg(F.col("total") / F.col("count")).alias("delta_macro"))
    out = ci.join(delta, "cohort").drop("cohort").withColumn("interpretation", O.interpretation(F.col("macro_low"), F.col("macro_high")))
    return rounded(out, ["macro_low", "macro_high", "weighted_low", "weighted_high", "delta_macro"], 5)


def _embedded(spark, d):
    v = V.wide(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", "label", V.norm(F.slice(v, 1, 32)).alias("norm"), V.mean(v).alias("level"), v.alias("v"), (10 * F.get(v, F.lit(0)) + 3 * F.get(v, F.lit(5))).alias("y"), (F.col("vec_id") * 3).alias("a"), (F.col("vec_id") * 3 + 4).alias("b"))


@query()
def loeo_multi_feature(spark, d):
    """Scalar, duplicate and signed models over the embeddings' labels: metrics of each model and the largest solver gap."""
    p = ridge.nested_loeo(_embedded(spark, d), [], "label", "vec_id", "y", ["norm", "level"], ["v"], models=("scalar", "duplicate_scalar", "signed", "unit_direction"))
    m = A.metric_bundle(p, ["model"], "label", "truth", "prediction").join(p.groupBy("model").agg(F.max("gap").alias("max_gap")), "model")
    return rounded(m, ["mae", "macro_mae", "rmse"], 6).select("model", "n", "mae", "macro_mae", "rmse", (F.col("max_gap") < 1e-7).alias("solvers_agree"))


def _two_scalars(purged: bool) -> str:
    """The scalar model of two standardised features in closed form: (R + 2 strength I) u = c for correlations R and slopes c."""
    far = "AND NOT EXISTS (SELECT 1 FROM z h WHERE h.g = {o} AND z.a <= h.b AND z.b >= h.a)" if purged else ""
    stats = "avg(p) AS mp, avg(q) AS mq, avg(y) AS my, stddev_pop(p) AS sp, stddev_pop(q) AS sq, corr(p, q) AS r, covar_pop(p, y) / stddev_pop(p) AS cp, covar_pop(q, y) / stddev_pop(q) AS cq, count(*) AS n"
    line = "my + (p - mp) / sp * ((1 + 2 * strength) * cp - r * cq) / ((1 + 2 * strength) ** 2 - r * r) + (q - mq) / sq * ((1 + 2 * strength) * cq - r * cp) / ((1 + 2 * strength) ** 2 - r * r)"
    return f"""WITH e AS (SELECT vec_id, label AS g, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
      z AS (SELECT vec_id, g, sqrt(list_sum(list_transform(v[1:32], lambda x: x * x))) AS p, list_avg(v) AS q, 10 * v[1] + 3 * v[6] AS y, vec_id * 3 AS a, vec_id * 3 + 4 AS b FROM e),
      lam AS (SELECT unnest(CAST([0.0001, 0.001, 0.01, 0.1, 1.0, 10.0] AS DOUBLE[])) AS strength), gs AS (SELECT DISTINCT g FROM z),
      t AS (SELECT o.g AS og, z.* FROM gs o JOIN z ON z.g <> o.g {far.format(o="o.g")}),
      inn AS (SELECT og, i.g AS ig, {stats} FROM t JOIN gs i ON i.g <> t.og AND i.g <> t.g GROUP BY 1, 2),
      sc AS (SELECT og, ig, strength, avg(abs(t.y - ({line}))) AS mae FROM inn JOIN t USING (og) CROSS JOIN lam WHERE t.g = ig GROUP BY 1, 2, 3),
      s2 AS (SELECT og, strength, avg(mae) AS score FROM sc GROUP BY 1, 2), ch AS (SELECT og, max(strength) AS strength FROM (SELECT *, min(score) OVER (PARTITION BY og) AS best FROM s2) WHERE score <= best + 1e-12 GROUP BY 1),
      fit AS (SELECT og, {stats} FROM t GROUP BY 1), al AS (SELECT o.g AS og, count(*) AS every FROM gs o JOIN z ON z.g <> o.g GROUP BY 1)
      SELECT z.vec_id, z.g AS label, strength, round({line}, 5) AS prediction, n AS train_n, every - n AS purged_n FROM z JOIN fit ON fit.og = z.g JOIN ch ON ch.og = z.g JOIN al ON al.og = z.g"""


def _scalar_model(spark, d, **more):
    p = ridge.nested_loeo(_embedded(spark, d), [], "label", "vec_id", "y", ["norm", "level"], models=("scalar",), **more)
    return rounded(p, ["prediction"], 5).select("vec_id", "label", F.col("lambda").alias("strength"), "prediction", "train_n", "purged_n")


@query(_two_scalars(False))
def loeo_scalar_model(spark, d):
    """Held-out predictions of the scalar model of two features, and the strength each fold chose."""
    return _scalar_model(spark, d)


@query(_two_scalars(True))
def context_purged_folds(spark, d):
    """The same with rows purged from training whose window overlaps one of the held-out label."""
    return _scalar_model(spark, d, span=("a", "b"), bin_size=1 << 10)


def _three_features() -> str:
    """Models of one scalar and a vector of two dimensions in closed form, by Cramer's rule on (W C W + strength I) f = W c."""
    stats = ", ".join(["count(*) AS n", *[f"avg({x}) AS m{x}" for x in "pqry"], *[f"covar_pop({a}, {b}) AS {a}{b}" for a, b in ("pp", "pq", "pr", "qq", "qr", "rr", "py", "qy", "ry")]])
    w1, w2 = "CASE model WHEN 'scalar' THEN 1 / sqrt(pp) WHEN 'signed' THEN sqrt(0.5 / pp) ELSE 0 END", "CASE model WHEN 'signed' THEN sqrt(0.5 / (qq + rr)) WHEN 'vector_only' THEN sqrt(1 / (qq + rr)) ELSE 0 END"
    cells = "w1 * w1 * pp + s AS a, w1 * w2 * pq AS b, w1 * w2 * pr AS c, w2 * w2 * qq + s AS e, w2 * w2 * qr AS f, w2 * w2 * rr + s AS i, w1 * py AS u, w2 * qy AS v, w2 * ry AS w"
    solved = "w1 * (u * (e * i - f * f) - b * (v * i - f * w) + c * (v * f - e * w)) / det AS k1, w2 * (a * (v * i - f * w) - u * (b * i - f * c) + c * (b * w - v * c)) / det AS k2, w2 * (a * (e * w - v * f) - b * (b * w - v * c) + u * (b * f - e * c)) / det AS k3"
    fits = lambda name, of: f"{name} AS (SELECT *, {solved} FROM (SELECT *, a * (e * i - f * f) - b * (b * i - f * c) + c * (b * f - e * c) AS det FROM (SELECT *, {cells} FROM (SELECT *, {w1} AS w1, {w2} AS w2 FROM {of}, lam, models))))"
    said = "my + k1 * (z.p - mp) + k2 * (z.q - mq) + k3 * (z.r - mr)"
    return f"""WITH v AS (SELECT vec_id, label AS g, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
      z AS (SELECT vec_id, g, list_max(v) AS p, list_avg(v[1:len(v) // 2]) AS q, list_avg(v[len(v) // 2 + 1:]) AS r, 10 * v[1] + 3 * v[6] AS y FROM v),
      lam AS (SELECT unnest(CAST([0.0001, 0.001, 0.01, 0.1, 1.0, 10.0] AS DOUBLE[])) AS s), models AS (SELECT unnest(['scalar', 'signed', 'vector_only']) AS model), gs AS (SELECT DISTINCT g FROM z),
      i0 AS (SELECT o.g AS og, n.g AS ig, {stats} FROM gs o JOIN gs n ON n.g <> o.g JOIN z ON z.g <> o.g AND z.g <> n.g GROUP BY 1, 2), o0 AS (SELECT o.g AS og, {stats} FROM gs o JOIN z ON z.g <> o.g GROUP BY 1),
      {fits("inn", "i0")}, {fits("fit", "o0")},
      sc AS (SELECT model, og, ig, s, avg(abs(z.y - ({said}))) AS mae FROM inn JOIN z ON z.g = ig GROUP BY ALL), s2 AS (SELECT model, og, s, avg(mae) AS score FROM sc GROUP BY ALL),
      ch AS (SELECT model, og, max(s) AS s FROM (SELECT *, min(score) OVER (PARTITION BY model, og) AS best FROM s2) WHERE score <= best + 1e-12 GROUP BY ALL)
      SELECT model, z.vec_id, z.g AS label, s AS strength, round({said}, 5) AS prediction, n AS train_n FROM fit JOIN ch USING (model, og, s) JOIN z ON z.g = og"""


@query(_three_features())
def signed_models_of_any_unit(spark, d):
    """Scalar, signed and vector models of the whole embedding's maximum and halves' means; the scalar is measured from another zero and the vector in a unit 10^-7 as large, which changes no prediction."""
    v = V.wide(F.col("embedding"))
    half = F.floor(F.size("embedding") / 2).cast("int")
    e = table(spark, d, "embeddings").select("vec_id", "label", (F.array_max(v) + 1e4).alias("peak"), F.transform(F.array(V.mean(F.slice(v, F.lit(1), half)), V.mean(F.slice(v, half + 1, F.size("embedding") - half))), lambda x: x * 1e-7).alias("v"), (10 * F.get(v, F.lit(0)) + 3 * F.get(v, F.lit(5))).alias("y"))
    p = ridge.nested_loeo(e, [], "label", "vec_id", "y", ["peak"], ["v"], models=("scalar", "signed", "vector_only"))
    return rounded(p, ["prediction"], 5).select("model", "vec_id", "label", F.col("lambda").alias("strength"), "prediction", "train_n")
