"""Vector metrics, slices of series, pooling, filters and exact differences on array columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from helixframe.functions import spectral
from helixframe.functions import vectors as V
from helixframe.operators import hashtrees, joins
from helixframe.operators import series as S
from helixframe.operators.ordinals import with_ordinals
from helixframe.plugins import layers
from helixframe.queries import query
from helixframe.queries.summarising import rounded
from helixframe.session import kept, scratch, table

_PAIR = "p AS (SELECT vec_id, label, CAST(r AS DOUBLE[]) AS r, CAST(a AS DOUBLE[]) AS a FROM (SELECT vec_id, label, embedding AS r, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS a FROM embeddings) WHERE a IS NOT NULL)"
_D = "list_transform(list_zip(a, r), lambda z: z[1] - z[2])"
_NORM = "sqrt(list_sum(list_transform({0}, lambda x: x * x)))"


def pairs(spark, d):
    """Each vector (REF) beside its successor of the same label (ALT), in double."""
    e = table(spark, d, "embeddings").select("vec_id", "label", V.wide(F.col("embedding")).alias("v"))
    return joins.adjacent(e, ["label"], [F.col("vec_id")], ["v"]).select("vec_id", "label", F.col("v").alias("r"), F.col("next_v").alias("a"))


@query(f"""WITH {_PAIR}, m AS (SELECT *, {_D} AS dif FROM p)
  SELECT vec_id, round({_NORM.format('dif')} / greatest({_NORM.format('r')}, 1e-30), 6) AS relative_l2, round({_NORM.format('dif')} / sqrt(len(r)), 6) AS rms_difference,
  round(greatest(0, least(2, 1 - list_sum(list_transform(list_zip(a, r), lambda z: z[1] * z[2])) / greatest({_NORM.format('r')} * {_NORM.format('a')}, 1e-30))), 6) AS cosine_distance,
  round(list_max(list_transform(dif, lambda x: abs(x))), 6) AS max_abs_difference, round(len(list_filter(dif, lambda x: x <> 0)) / len(r), 6) AS changed_dimension_fraction, round({_NORM.format('r')}, 6) AS reference_l2 FROM m""")
def pair_vector_metrics(spark, d):
    m = V.position_metrics(F.col("a"), F.col("r"))
    return rounded(pairs(spark, d).select("vec_id", *[c.alias(k) for k, c in m.items()]), list(m))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
  SELECT vec_id, round(list_avg(v), 6) AS whole_mean, round(list_avg(v[1:32]), 6) AS pre_mean, round(list_avg(v[33:]), 6) AS post_mean, round(list_avg(v[13:53]), 6) AS around_mean, round(list_avg(v[33:]), 6) AS ahead_mean,
  round(list_max(v), 6) AS maximum, list_position(v, list_max(v)) - 1 AS argmax, list_position(v, list_max(v)) - 33 AS max_offset, len(list_filter(v, lambda x: x <> 0)) AS nonzero, round(list_median(v), 6) AS median FROM v""")
def series_slices(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", V.wide(F.col("embedding")).alias("v"))
    s = V.series_slices(F.col("v"), 32)
    whole = {"argmax", "max_offset", "nonzero"}
    return e.select("vec_id", *[c.cast("long").alias(k) if k in whole else F.round(c, 6).alias(k) for k, c in s.items()])


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, CAST(vec_id % 64 AS INTEGER) AS c FROM embeddings)
  SELECT vec_id, c AS centre, CASE WHEN c - 5 >= 0 AND c + 6 <= len(v) THEN round(list_avg(v[c - 4:c + 6]), 6) END AS region_mean FROM v""")
def region_mean_complete(spark, d):
    c = (F.col("vec_id") % 64).cast("int")
    return table(spark, d, "embeddings").select("vec_id", c.alias("centre"), F.round(V.region_mean(F.col("embedding"), c, 5), 6).alias("region_mean"))


@query("""WITH x AS (SELECT label, i - 1 AS position, CAST(embedding[i] AS DOUBLE) AS v, vec_id % 2 AS alt FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS i)),
  g AS (SELECT * FROM (VALUES ('near', 28, 36), ('left', 0, 28), ('right', 36, 64), ('window', 12, 52), ('all', 0, 64)) t(region, s, e))
  SELECT label, region, round(avg(v) FILTER (WHERE alt = 0), 6) AS ref_mean, round(avg(v) FILTER (WHERE alt = 1), 6) AS alt_mean, round(avg(v) FILTER (WHERE alt = 1) - avg(v) FILTER (WHERE alt = 0), 6) AS delta
  FROM x JOIN g ON position >= s AND position < e GROUP BY 1, 2""")
def region_pooled_delta(spark, d):
    regions = [("near", 28, 36), ("left", 0, 28), ("right", 36, 64), ("window", 12, 52), ("all", 0, 64)]
    sums = [F.struct(F.lit(n).alias("region"), V.total(F.slice(V.wide(F.col("embedding")), a + 1, b - a)).alias("s"), F.lit(b - a).alias("n")) for n, a, b in regions]
    e = table(spark, d, "embeddings").select("label", (F.col("vec_id") % 2).alias("alt"), F.explode(F.array(*sums)).alias("x"))
    # sums of slices are combined before the shuffle, so positions never become rows
    mean = lambda k: F.sum(F.when(F.col("alt") == k, F.col("x.s"))) / F.sum(F.when(F.col("alt") == k, F.col("x.n")))
    g = e.groupBy("label", "x.region").agg(mean(0).alias("ref_mean"), mean(1).alias("alt_mean"))
    return rounded(g.withColumn("delta", F.col("alt_mean") - F.col("ref_mean")), ["ref_mean", "alt_mean", "delta"])


@query(f"""WITH {_PAIR} SELECT vec_id, round(list_sum(list_transform(list_zip(a, r), lambda z: CAST(z[1] - z[2] AS FLOAT))), 4) AS delta_sum, round({_NORM.format(_D)}, 5) AS delta_norm FROM p""")
def pooled_delta_norms(spark, d):
    x = pairs(spark, d).select("vec_id", V.pooled_delta(F.col("a"), F.col("r")).alias("delta"))
    return x.select("vec_id", F.round(V.total(V.wide(F.col("delta"))), 4).alias("delta_sum"), F.round(V.norm(F.col("delta")), 5).alias("delta_norm"))


@query(f"""WITH v AS (SELECT vec_id, CASE WHEN vec_id % 50 = 0 THEN list_transform(embedding, lambda x: CAST(0 AS DOUBLE)) ELSE CAST(embedding AS DOUBLE[]) END AS v FROM embeddings), n AS (SELECT vec_id, v, {_NORM.format('v')} AS nrm FROM v)
  SELECT vec_id, round(CASE WHEN nrm = 0 THEN v[1] ELSE v[1] / nrm END, 6) AS first, round(CASE WHEN nrm = 0 THEN 0 ELSE {_NORM.format('list_transform(v, lambda x: x / nrm)')} END, 6) AS unit_norm FROM n""")
def unit_direction(spark, d):
    zero = F.transform(V.wide(F.col("embedding")), lambda x: F.lit(0.0))
    e = table(spark, d, "embeddings").select("vec_id", F.when(F.col("vec_id") % 50 == 0, zero).otherwise(V.wide(F.col("embedding"))).alias("v"))
    u = e.select("vec_id", V.unit_direction(F.col("v")).alias("u"))
    return u.select("vec_id", F.round(F.get("u", F.lit(0)), 6).alias("first"), F.round(V.norm(F.col("u")), 6).alias("unit_norm"))


@query("""WITH v AS (SELECT vec_id, embedding AS a, CASE WHEN vec_id % 3 = 0 THEN embedding ELSE list_concat(embedding[1:CAST(vec_id % 64 AS INTEGER)], [CAST(embedding[CAST(vec_id % 64 AS INTEGER) + 1] + 1 AS FLOAT)], embedding[CAST(vec_id % 64 AS INTEGER) + 2:]) END AS b FROM embeddings)
  SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 0 ELSE 1 END AS changed, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE CAST(vec_id % 64 AS BIGINT) END AS first_position FROM v""")
def exact_diff_first(spark, d):
    at, v = (F.col("vec_id") % 64).cast("int"), F.col("embedding")
    bumped = F.transform(v, lambda x, i: F.when(i == at, (x + 1).cast("float")).otherwise(x))
    e = table(spark, d, "embeddings").select("vec_id", v.alias("a"), F.when(F.col("vec_id") % 3 == 0, v).otherwise(bumped).alias("b"))
    return e.select("vec_id", V.changed_count(F.col("a"), F.col("b")).alias("changed"), V.first_change(F.col("a"), F.col("b")).cast("long").alias("first_position"))


@query("""WITH v AS (SELECT vec_id, embedding AS a, CASE WHEN vec_id % 3 = 0 THEN embedding ELSE list_concat(embedding[1:CAST(vec_id % 64 AS INTEGER)], [CAST(embedding[CAST(vec_id % 64 AS INTEGER) + 1] + 1 AS FLOAT)], embedding[CAST(vec_id % 64 AS INTEGER) + 2:]) END AS b FROM embeddings),
  d AS (SELECT vec_id, list_transform(list_zip(a, b), lambda z: abs(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE))) AS g FROM v)
  SELECT vec_id, CAST(len(list_filter(g, lambda x: x <> 0)) AS BIGINT) AS changed, CASE WHEN list_max(g) > 0 THEN CAST(list_position(g, list_filter(g, lambda x: x <> 0)[1]) - 1 AS BIGINT) END AS first_position,
    CASE WHEN list_max(g) > 0 THEN round(list_max(g), 6) END AS max_abs, CAST(CASE WHEN list_max(g) > 0 THEN 1 ELSE 0 END AS BIGINT) AS blocks FROM d""")
def hash_tree_differences(spark, d):
    """Two runs of all vectors written with hash trees; of a vector only the block whose hash differs is read again."""
    at, v = (F.col("vec_id") % 64).cast("int"), F.col("embedding")
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    bumped = e.select("vec_id", F.when(F.col("vec_id") % 3 == 0, v).otherwise(F.transform(v, lambda x, i: F.when(i == at, (x + 1).cast("float")).otherwise(x))).alias("embedding"))
    left, right = (kept(scratch(spark, "hash-tree")) for _ in range(2))
    for run, folder in ((e, left), (bumped, right)):
        hashtrees.write_tree(run, ["vec_id"], "embedding", folder, size=8, fan=4, shards=16)
    return rounded(hashtrees.differences(spark, left, right), ["max_abs"])


TAPS = [0.5, 0.25, -0.125, 0.0625]


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), y AS (SELECT vec_id, list_transform(generate_series(1, len(v)), lambda t: 0.5 * v[t] + CASE WHEN t > 1 THEN 0.25 * v[t - 1] ELSE 0 END
  + CASE WHEN t > 2 THEN -0.125 * v[t - 2] ELSE 0 END + CASE WHEN t > 3 THEN 0.0625 * v[t - 3] ELSE 0 END) AS y FROM v)
  SELECT vec_id, round(y[1], 6) AS y_first, round(y[64], 6) AS y_last, round(list_sum(list_transform(y, lambda x: x * x)), 5) AS energy FROM y""")
def direct_fir(spark, d):
    y = table(spark, d, "embeddings").select("vec_id", V.direct_fir(F.col("embedding"), TAPS).alias("y"))
    return y.select("vec_id", F.round(F.get("y", F.lit(0)), 6).alias("y_first"), F.round(F.get("y", F.lit(63)), 6).alias("y_last"), F.round(V.dot(F.col("y"), F.col("y")), 5).alias("energy"))


@query("SELECT vec_id, true AS same FROM embeddings")
def fft_equals_direct_fir(spark, d):
    fft = spectral.fft_convolution(TAPS)
    e = table(spark, d, "embeddings").select("vec_id", V.direct_fir(F.col("embedding"), TAPS).alias("y"), fft(F.col("embedding").cast("array<double>")).alias("z"))
    return e.select("vec_id", (V.max_abs_difference(F.col("y"), F.col("z")) < 1e-9).alias("same"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding[1:4], lambda x: exp(CAST(x AS DOUBLE))) AS e FROM embeddings) SELECT vec_id, round(e[1] / list_sum(e), 6) AS a, round(e[2] / list_sum(e), 6) AS c, round(e[3] / list_sum(e), 6) AS g, round(e[4] / list_sum(e), 6) AS t FROM v""")
def softmax_subset(spark, d):
    p = table(spark, d, "embeddings").select("vec_id", V.softmax(F.slice("embedding", 1, 4)).alias("p"))
    return p.select("vec_id", *[F.round(F.get("p", F.lit(i)), 6).alias(b) for i, b in enumerate("acgt")])


@query(f"""WITH {_PAIR} SELECT vec_id, round(list_sum(list_transform(list_zip(a, r), lambda z: (z[1] + z[2] * 0.3) * z[2])), 5) AS total, round(list_avg(a) - list_avg(r), 6) AS delta_score FROM p""")
def gated_skip_and_score_delta(spark, d):
    x = pairs(spark, d)
    g = V.gated_skip(F.col("a"), F.col("r"), 0.3, F.col("r"))
    return x.select("vec_id", F.round(V.total(g), 5).alias("total"), F.round(V.mean_log_probability(F.col("a")) - V.mean_log_probability(F.col("r")), 6).alias("delta_score"))


@query("""SELECT vec_id, i - 1 AS position, round(CAST(embedding[i] AS DOUBLE), 6) AS forward, round(CAST(embedding[65 - i] AS DOUBLE), 6) AS backward FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS i)""")
def zipped_position_rows(spark, d):
    e = table(spark, d, "embeddings")
    z = joins.zipped_positions(e, ["vec_id"], {"forward": V.wide(F.col("embedding")), "backward": F.reverse(V.wide(F.col("embedding")))})
    return rounded(z.withColumn("position", F.col("position").cast("long")), ["forward", "backward"])


@query("""WITH e AS (SELECT vec_id, label, CASE WHEN vec_id % 120 = 7 THEN embedding[1:63] WHEN vec_id % 150 = 3 THEN list_transform(embedding, lambda x: x * 1000) ELSE embedding END AS v FROM embeddings)
  SELECT label, count(*) AS n, count(*) FILTER (WHERE len(v) = 64) AS right_length, bool_and(len(v) = 64 AND list_min(v) >= -1 AND list_max(v) <= 1) AS all_valid FROM e GROUP BY 1""")
def array_schema_audit(spark, d):
    v, k = F.col("embedding"), F.col("vec_id")
    odd = F.when(k % 120 == 7, F.slice(v, 1, 63)).when(k % 150 == 3, F.transform(v, lambda x: (x * 1000).cast("float"))).otherwise(v)
    ok = V.valid_series(F.col("v"), 64, low=-1.0, high=1.0)
    e = table(spark, d, "embeddings").select("label", odd.alias("v"))
    return e.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.size("v") == 64).alias("right_length"), F.bool_and(ok).alias("all_valid"))


@query("""WITH p AS (SELECT label, i - 1 AS position, corr(CAST(a[i] AS DOUBLE), CAST(r[i] AS DOUBLE)) AS c FROM (SELECT label, embedding AS r, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS a FROM embeddings), (SELECT unnest(generate_series(1, 64)) AS i) WHERE a IS NOT NULL GROUP BY 1, 2)
  SELECT label, count(*) AS positions, round(avg(c), 6) AS mean_correlation FROM p GROUP BY 1""")
def position_correlations(spark, d):
    from helixframe.operators.aggregates import safe_corr

    z = joins.zipped_positions(pairs(spark, d), ["label"], {"a": F.col("a"), "r": F.col("r")})
    c = z.groupBy("label", "position").agg(safe_corr(F.col("a"), F.col("r")).alias("c"))
    return rounded(c.groupBy("label").agg(F.count("*").alias("positions"), F.avg("c").alias("mean_correlation")), ["mean_correlation"])


@query(f"""WITH {_PAIR}, q AS (SELECT vec_id, a[17:32] AS a, r[17:32] AS r FROM p)
  SELECT vec_id, a = r AS equal, len(list_filter({_D}, lambda x: x <> 0)) AS unequal, round(list_max(list_transform({_D}, lambda x: abs(x))), 6) AS max_abs, round({_NORM.format(_D)} / greatest({_NORM.format('r')}, 1e-30), 6) AS relative_l2 FROM q""")
def tensor_comparison(spark, d):
    p = pairs(spark, d).select("vec_id", V.edge_slices(F.col("a"), 32, 16)["before"].alias("a"), V.edge_slices(F.col("r"), 32, 16)["before"].alias("r"))
    c = V.comparison(F.col("a"), F.col("r"))
    return rounded(p.select("vec_id", *[x.alias(k) for k, x in c.items()]).withColumn("unequal", F.col("unequal").cast("long")), ["max_abs", "relative_l2"])


_TAPS = {"click": [1.0, 0.5, -0.25], "view": [0.2 * 0.9**k for k in range(40)], "purchase": [1.0] * 25, "error": [0.0, 1.0]}


@query(f"""WITH e AS (SELECT event_type AS channel, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS t, event_id, CAST(value AS DOUBLE) AS u FROM events),
  f AS (SELECT channel, unnest(taps) AS h, generate_subscripts(taps, 1) - 1 AS k FROM (VALUES {", ".join(f"('{c}', CAST({t} AS DOUBLE[]))" for c, t in _TAPS.items())}) v(channel, taps))
  SELECT a.event_id, a.channel, round(sum(h * coalesce(b.u, 0)), 6) AS filtered FROM e a JOIN f USING (channel) LEFT JOIN e b ON b.channel = a.channel AND b.t = a.t - k GROUP BY 1, 2""")
def blocked_filter(spark, d):
    """Causal filters of channels of events, one for each event type, over series in blocks shorter than the longest filter."""
    e = table(spark, d, "events").select(F.col("event_type").alias("channel"), "ts", "event_id", "value")
    placed = with_ordinals(e, ["channel"], ["ts", "event_id"], "position")
    filters = spark.createDataFrame(list(_TAPS.items()), "channel string, taps array<double>")
    made = S.blocked_convolution(S.blocks_of(placed, ["channel"], "position", "value", 32), ["channel"], filters, ["channel"], 32)
    out = S.rows_of(made, ["channel"], "filtered", 32).join(placed.select("channel", "position", "event_id"), ["channel", "position"])
    return rounded(out.select("event_id", "channel", "filtered"), ["filtered"])


@query("""WITH e AS (SELECT label, vec_id % 2 AS alt, row_number() OVER (PARTITION BY label, vec_id % 2 ORDER BY vec_id) - 1 AS t, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  n AS (SELECT label, alt, count(*) AS n FROM e GROUP BY 1, 2), g AS (SELECT * FROM (VALUES ('head', 0, 3), ('middle', 1, 9), ('all', 0, 0), ('beyond', 5, 100000)) r(region, a, b)),
  q AS (SELECT label, alt, region, view, n, CASE WHEN view = 'forward' THEN a ELSE n - e END AS s, CASE WHEN view = 'forward' THEN e ELSE n - a END AS e
    FROM (SELECT *, CASE WHEN b = 0 THEN n ELSE b END AS e FROM n, g), (VALUES ('forward'), ('reverse')) w(view)),
  x AS (SELECT label, alt, t, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e),
  m AS (SELECT q.label, q.alt, region, view, i, avg(x) AS m FROM q JOIN x ON x.label = q.label AND x.alt = q.alt AND t >= s AND t < q.e WHERE s >= 0 AND q.e <= n GROUP BY ALL)
  SELECT q.label, q.alt, q.region, q.view, round(max(CASE WHEN i = 1 THEN m END), 6) AS first_dimension, round(sqrt(sum(m * m)), 6) AS pooled_norm FROM q LEFT JOIN m ON m.label = q.label AND m.alt = q.alt AND m.region = q.region AND m.view = q.view GROUP BY ALL""")
def pooled_regions(spark, d):
    """Mean vectors of regions of stacked embeddings by label and side, forward and counted from the end, from prefix sums; regions past the end have none."""
    keys = ["label", "alt"]
    e = table(spark, d, "embeddings").select("label", (F.col("vec_id") % 2).alias("alt"), "vec_id", "embedding")
    placed = with_ordinals(e, keys, ["vec_id"], "position", total="n")
    sums = S.prefix_sums(placed, keys, "position", "embedding", 16)
    named = spark.createDataFrame([("head", 0, 3), ("middle", 1, 9), ("all", 0, 0), ("beyond", 5, 100000)], "region string, a long, b long")
    last = F.when(F.col("b") == 0, F.col("n")).otherwise(F.col("b"))
    back = S.reversed_region(F.col("a"), last, F.col("n"))
    sides = F.explode(F.array(F.struct(F.lit("forward").alias("view"), F.col("a").alias("start"), last.alias("end")), F.struct(F.lit("reverse").alias("view"), back[0].alias("start"), back[1].alias("end"))))
    regions = placed.select(*keys, "n").distinct().join(F.broadcast(named)).select(*keys, "region", sides.alias("_r")).select(*keys, "region", "_r.*")
    out = S.region_means(sums, keys, regions, size=16)
    return rounded(out.select(*keys, "region", "view", F.get("mean", F.lit(0)).alias("first_dimension"), F.sqrt(F.aggregate("mean", F.lit(0.0), lambda a, x: a + x * x)).alias("pooled_norm")), ["first_dimension", "pooled_norm"])


class LetterLayers:
    """Two layers of a text: whether a position, and the one before it, is a vowel, a digit, a blank; in blocks of positions."""

    def __init__(self, size: int = 512):
        self.size, self.classes = size, np.zeros((0x110000, 3))
        for i, letters in enumerate(("aeiou", "0123456789", " ")):
            self.classes[[ord(c) for c in letters], i] = 1

    def layers(self, sequence):
        codes = np.frombuffer(sequence.encode("utf-32-le", "surrogatepass"), "<u4")
        for a in range(0, len(codes), self.size):
            yield "here", a, self.classes[codes[a : a + self.size]]
            before = self.classes[codes[max(0, a - 1) : a + self.size - 1][: len(codes) - a]]
            yield "before", a, before if a else np.concatenate([np.zeros((1, 3)), before])[: min(self.size, len(codes))]


_SPANS = (("head", 0, 100), ("far", 1000, 3000), ("tail", -100, 0), ("all", 0, 0))


@query(f"""WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL AND length(text) > 0), r AS (SELECT * FROM (VALUES {", ".join(map(str, _SPANS))}) v(region, a, b)),
  p AS (SELECT doc_id, text, region, layer, n, CASE WHEN a < 0 THEN n + a ELSE a END AS s, CASE WHEN b <= 0 THEN n + b ELSE b END AS e FROM d, r, (VALUES ('here'), ('before')) l(layer)),
  t AS (SELECT *, s >= 0 AND e <= n AND e > s AS ok, CASE WHEN layer = 'here' THEN substr(text, s + 1, e - s) ELSE substr(text, greatest(s, 1), e - s - CASE WHEN s = 0 THEN 1 ELSE 0 END) END AS x FROM p)
  SELECT doc_id, layer, region, {", ".join(f"CASE WHEN ok THEN round(CAST(length(x) - length(regexp_replace(x, '[{c}]', '', 'g')) AS DOUBLE) / (e - s), 6) END AS {name}" for name, c in (("vowels", "aeiou"), ("digits", "0-9"), ("blanks", " ")))} FROM t""")
def pooled_layer_stream(spark, d):
    """Mean vectors of regions of two layers of every text, from layers that come block by block."""
    docs = table(spark, d, "documents").filter(F.length("text") > 0)
    n = F.length("text").cast("long")
    regions = F.array(*[F.struct(F.lit(name).alias("region"), (n + a if a < 0 else F.lit(a).cast("long")).alias("start"), (n + b if b <= 0 else F.lit(b).cast("long")).alias("end")) for name, a, b in _SPANS])
    got = layers.pooled_layers(docs.select("doc_id", "text", regions.alias("regions")), ["doc_id"], "text", "regions", LetterLayers)
    return got.select("doc_id", "layer", "region", *[F.round(F.get("mean", F.lit(i)), 6).alias(c) for i, c in enumerate(("vowels", "digits", "blanks"))])
