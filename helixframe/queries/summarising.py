"""Distributions, ranks, windows, top-k, paging and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import aggregates as A
from helixframe.operators import matching, reshape
from helixframe.operators import ordering as O
from helixframe.quality import checks
from helixframe.queries import query
from helixframe.session import table

METRICS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LONG = " UNION ALL ".join(f"SELECT l_returnflag, l_linestatus, '{m}' AS metric, {m} AS v FROM lineitem" for m in METRICS)


def rounded(df, columns, places=6):
    return df.withColumns({c: F.round(c, places) for c in columns})


@query(f"""SELECT l_returnflag, l_linestatus, metric, count(v) AS n, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.9), 6) AS p90, round(quantile_cont(v, 0.99), 6) AS p99, round(max(v), 6) AS maximum
  FROM ({_LONG}) WHERE v IS NOT NULL GROUP BY ALL""")
def distribution_summary(spark, d):
    return rounded(A.distribution_summary(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], METRICS), ["median", "p90", "p99", "maximum"])


@query("""SELECT o_orderpriority, count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean, round(quantile_cont(o_totalprice, 0.5), 4) AS median, min(o_totalprice) AS minimum, max(o_totalprice) AS maximum FROM orders GROUP BY 1""")
def describe_by_group(spark, d):
    return rounded(A.describe(table(spark, d, "orders"), "o_totalprice", ["o_orderpriority"]), ["mean", "median"], 4)


@query("""SELECT o_orderstatus || '_' || o_orderpriority AS label, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 150000) AS dear, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1995-01-01') AS late FROM orders GROUP BY 1""")
def conditional_counts(spark, d):
    conditions = {"dear": F.col("o_totalprice") > 150000, "late": F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp")}
    return A.counts_by_label(table(spark, d, "orders"), F.concat_ws("_", "o_orderstatus", "o_orderpriority"), conditions)


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1")
def distinct_counts(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct("l_orderkey").alias("orders"))


@query("""SELECT n_regionkey, count(*) AS n_nations, bool_and(total > 0) AS all_positive, bool_or(total > 1000000) AS any_large, round(max(abs(total - mean_total)), 3) AS max_abs_difference FROM
  (SELECT n_regionkey, n_nationkey, sum(s_acctbal) AS total, avg(sum(s_acctbal)) OVER (PARTITION BY n_regionkey) AS mean_total FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2) GROUP BY 1""")
def gate_reductions(spark, d):
    from pyspark.sql import Window

    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    t = s.groupBy("n_regionkey", "n_nationkey").agg(F.sum("s_acctbal").alias("total")).withColumn("m", F.avg("total").over(Window.partitionBy("n_regionkey")))
    return t.groupBy("n_regionkey").agg(
        F.count("*").alias("n_nations"), F.bool_and(F.col("total") > 0).alias("all_positive"), F.bool_or(F.col("total") > 1000000).alias("any_large"), F.round(F.max(F.abs(F.col("total") - F.col("m"))), 3).alias("max_abs_difference")
    )


@query("""WITH e AS (SELECT l_returnflag, l_suppkey % 25 AS grp, l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem), g AS (SELECT l_returnflag, grp, count(*) AS n, sum(abs(p - y)) AS a, sum((p - y) * (p - y)) AS s FROM e GROUP BY 1, 2)
  SELECT l_returnflag, CAST(sum(n) AS BIGINT) AS n, round(sum(a) / sum(n), 4) AS mae, round(avg(a / n), 4) AS macro_mae, round(sqrt(sum(s) / sum(n)), 4) AS rmse FROM g GROUP BY 1""")
def macro_metric(spark, d):
    l = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_suppkey") % 25).alias("grp"), F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p"))
    return rounded(A.metric_bundle(l, ["l_returnflag"], "grp", "y", "p"), ["mae", "macro_mae", "rmse"], 4)


@query("""WITH l AS (SELECT l_returnflag, CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE l_quantity END AS q, l_extendedprice AS p FROM lineitem),
  r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY q) + (count(*) OVER (PARTITION BY l_returnflag, q) - 1) / 2 AS rx, rank() OVER (PARTITION BY l_returnflag ORDER BY p) + (count(*) OVER (PARTITION BY l_returnflag, p) - 1) / 2 AS ry FROM l)
  SELECT l_returnflag, count(*) AS n, CASE WHEN min(rx) < max(rx) AND min(ry) < max(ry) THEN round(corr(rx, ry), 9) END AS spearman, min(rx) < max(rx) AND min(ry) < max(ry) AS spearman_defined FROM r GROUP BY 1""")
def spearman_avg_rank(spark, d):
    """Rank correlation by group, undefined where a side is constant."""
    l = table(spark, d, "lineitem").select("l_returnflag", F.when(F.col("l_returnflag") == "N", 1.0).otherwise(F.col("l_quantity")).alias("q"), "l_extendedprice")
    return rounded(A.spearman(l, ["l_returnflag"], "q", "l_extendedprice"), ["spearman"], 9)


@query("SELECT c_mktsegment, count(*) AS n, round(corr(c_acctbal, c_custkey), 9) AS pearson FROM customer GROUP BY 1")
def pearson_guarded(spark, d):
    c = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), A.safe_corr(F.col("c_acctbal"), F.col("c_custkey").cast("double")).alias("pearson"))
    return rounded(c, ["pearson"], 9)


@query("SELECT o_orderstatus, o_orderkey, o_totalprice, round(CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS DOUBLE) / count(*) OVER (PARTITION BY o_orderstatus), 9) AS ecdf FROM orders")
def ecdf_points(spark, d):
    return rounded(A.ecdf(table(spark, d, "orders"), ["o_orderstatus"], "o_totalprice", ["o_orderkey"]), ["ecdf"], 9)


@query("SELECT event_id, user_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 9) AS mean_100 FROM events")
def trailing_mean_100(spark, d):
    e = A.trailing_mean(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value", 100, "mean_100")
    return rounded(e.select("event_id", "user_id", "mean_100"), ["mean_100"], 9)


@query("""SELECT o_custkey, any_value(n) AS n, min(CASE WHEN o_totalprice > 250000 THEN o_orderkey END) AS o_orderkey, arg_min(o_totalprice, CASE WHEN o_totalprice > 250000 THEN o_orderkey END) AS o_totalprice
  FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) GROUP BY o_custkey""")
def first_satisfying(spark, d):
    o = table(spark, d, "orders")
    found = A.first_where(o, ["o_custkey"], "o_orderkey", F.col("o_totalprice") > 250000, ["o_totalprice"])
    return o.groupBy("o_custkey").agg(F.count("*").alias("n")).join(found, "o_custkey")


@query("SELECT l_suppkey, max(l_extendedprice) AS maximum, arg_max(l_orderkey * 10 + l_linenumber, (l_extendedprice, -(l_orderkey * 10 + l_linenumber))) AS argmax FROM lineitem GROUP BY 1")
def argmax_first_hit(spark, d):
    l = table(spark, d, "lineitem").withColumn("position", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return A.argmax_row(l, ["l_suppkey"], "l_extendedprice", "position")


@query("""SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey LIMIT 500""")
def priority_sort_limit(spark, d):
    o = table(spark, d, "orders")
    return O.first_rows(o, [O.by_priority(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"]), F.desc("o_totalprice"), F.col("o_orderkey")], 500).select("o_orderkey", "o_orderpriority")


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY l_partkey ORDER BY min(l_orderkey * 10 + l_linenumber) LIMIT 50 OFFSET 25)""")
def distinct_paging(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"))
    return O.page_of_keys(l, ["l_partkey"], "ordinal", 25, 50).drop("ordinal")


@query("""SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END DESC, -CAST(left(o_orderpriority, 1) AS INTEGER) DESC, o_orderkey) AS n FROM orders) WHERE n = 1""")
def best_per_group_first_wins(spark, d):
    priority = [(F.col("o_orderstatus") == "F").cast("int"), -F.left("o_orderpriority", F.lit(1)).cast("int")]
    return O.best_of_group(table(spark, d, "orders"), ["o_custkey"], priority, "o_orderkey").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")


@query("""SELECT p_partkey, p_type, p_brand FROM part WHERE (p_type, p_brand) IN (SELECT (p_type, p_brand) FROM (SELECT p_type, p_brand, row_number() OVER (PARTITION BY p_type ORDER BY CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER), p_brand) AS n FROM (SELECT DISTINCT p_type, p_brand FROM part)) WHERE n <= 2)""")
def head_groups_natural_order(spark, d):
    return O.head_groups(table(spark, d, "part"), ["p_type"], "p_brand", 2).select("p_partkey", "p_type", "p_brand")


@query("""SELECT p_partkey, string_agg(label, ';' ORDER BY i) AS labels FROM (
  (SELECT p_partkey, 0 AS i, 'top_price' AS label FROM part WHERE p_retailprice IS NOT NULL ORDER BY p_retailprice DESC, p_partkey LIMIT 25) UNION ALL
  (SELECT p_partkey, 1, 'top_size' FROM part WHERE p_size IS NOT NULL ORDER BY p_size DESC, p_partkey LIMIT 25)) GROUP BY 1""")
def two_metric_topk_labels(spark, d):
    return O.top_labels(table(spark, d, "part"), "p_partkey", [("p_retailprice", "top_price"), ("p_size", "top_size")], 25)


@query("""WITH RECURSIVE top AS (SELECT p_partkey, p_brand, p_size, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY rnk) AS i FROM (SELECT *, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rnk FROM part) WHERE rnk <= 40),
  pool AS (SELECT * FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM top)),
  step AS (SELECT CAST(0 AS BIGINT) AS i, p_brand, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS p_partkey, CAST(NULL AS BIGINT) AS control FROM (SELECT DISTINCT p_brand FROM top)
    UNION ALL SELECT t.i, t.p_brand, list_append(s.used, pick.k), t.p_partkey, pick.k FROM step s JOIN top t ON t.p_brand = s.p_brand AND t.i = s.i + 1,
    LATERAL (SELECT arg_min(p.p_partkey, (CASE WHEN p.p_size = t.p_size THEN 0 ELSE 1 END, p.p_retailprice, p.p_partkey)) AS k FROM pool p WHERE p.p_brand = t.p_brand AND NOT list_contains(s.used, p.p_partkey)) pick)
  SELECT p_partkey, control FROM step WHERE i > 0 AND control IS NOT NULL""")
def greedy_matched_controls(spark, d):
    p = table(spark, d, "part")
    top = O.first_rows(p, [F.desc("p_retailprice"), F.col("p_partkey")], 40)
    from pyspark.sql import Window

    top = top.withColumn("ordinal", F.row_number().over(Window.orderBy(F.desc("p_retailprice"), "p_partkey")))  # 40 rows
    return matching.matched_controls(top, p, "p_partkey", ["p_brand"], "p_size", "p_retailprice")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM (SELECT o_custkey, row_number() OVER (ORDER BY o_custkey) - 1 AS n FROM (SELECT DISTINCT o_custkey FROM orders)) WHERE n % 100 = 0)")
def every_kth_control(spark, d):
    return O.every_kth(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 100)


@query("""WITH g AS (SELECT c_mktsegment, CAST(c_nationkey AS INTEGER) AS group_idx, sum(c_acctbal) AS total, count(*) AS cnt FROM customer GROUP BY 1, 2),
  dr AS (SELECT d.i AS draw, s.j AS slot, CAST((d.i * 7919 + s.j * 104729 + (d.i * s.j) % 101) % 25 AS INTEGER) AS group_idx FROM (SELECT unnest(generate_series(0, 999)) AS i) d, (SELECT unnest(generate_series(0, 24)) AS j) s),
  e AS (SELECT c_mktsegment, draw, avg(total / cnt) AS macro, sum(total) / sum(cnt) AS weighted FROM g JOIN dr USING (group_idx) GROUP BY 1, 2)
  SELECT c_mktsegment, count(*) AS draws, round(quantile_cont(macro, 0.025), 6) AS macro_low, round(quantile_cont(macro, 0.975), 6) AS macro_high, round(quantile_cont(weighted, 0.025), 6) AS weighted_low, round(quantile_cont(weighted, 0.975), 6) AS weighted_high FROM e GROUP BY 1""")
def bootstrap_shared_draws(spark, d):
    stats = table(spark, d, "customer").groupBy("c_mktsegment", F.col("c_nationkey").alias("group_idx")).agg(F.sum("c_acctbal").alias("total"), F.count("*").alias("count"))
    i, j = F.col("draw"), F.col("slot")
    dr = spark.range(1000).withColumnRenamed("id", "draw").withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(24)))).withColumn("group_idx", ((i * 7919 + j * 104729 + (i * j) % 101) % 25).cast("int"))
    return rounded(O.bootstrap_interval(stats, dr, ["c_mktsegment"]), ["macro_low", "macro_high", "weighted_low", "weighted_high"])


@query("""SELECT l_returnflag, round(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END), 2) AS F, round(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END), 2) AS O FROM lineitem GROUP BY 1""")
def pivot_heatmap(spark, d):
    return rounded(reshape.heat_map(table(spark, d, "lineitem"), ["l_returnflag"], "l_linestatus", ["F", "O"], F.sum("l_quantity")), ["F", "O"], 2)


@query(f"SELECT metric, count(v) AS n, round(sum(v), 2) AS total FROM ({_LONG}) GROUP BY 1")
def unpivot_metrics(spark, d):
    long = A.unpivot(table(spark, d, "lineitem"), ["l_orderkey"], METRICS)
    return rounded(long.groupBy("metric").agg(F.count("value").alias("n"), F.sum("value").alias("total")), ["total"], 2)


@query("""SELECT l_returnflag, 'n' AS metric, CAST(count(*) AS DOUBLE) AS stored, CAST(count(*) AS DOUBLE) AS recomputed, true AS agrees FROM lineitem GROUP BY 1
  UNION ALL SELECT l_returnflag, 'mean', round(avg(l_quantity), 9), round(sum(l_quantity) / count(*), 9), true FROM lineitem GROUP BY 1""")
def metric_recompute_audit(spark, d):
    l = table(spark, d, "lineitem")
    stored = l.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("mean"))
    again = l.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("s")).groupBy("l_returnflag").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean"))
    return rounded(checks.recompute_audit(stored, again, ["l_returnflag"], ["n", "mean"]), ["stored", "recomputed"], 9)


@query("""SELECT count(*) AS forwards, CAST(sum(n_chars) AS BIGINT) AS total_chars, round(sum(n_chars) / 1048576.0, 6) AS mib, min(CASE WHEN n_chars > 4000 THEN n_chars END) AS min_failing, max(CASE WHEN n_chars <= 4000 THEN n_chars END) AS max_passing FROM documents""")
def storage_and_length_boundary(spark, d):
    n = F.col("n_chars")
    return table(spark, d, "documents").agg(
        F.count("*").alias("forwards"), F.sum(n).alias("total_chars"), F.round(F.sum(n) / 1048576.0, 6).alias("mib"), F.min(F.when(n > 4000, n)).alias("min_failing"), F.max(F.when(n <= 4000, n)).alias("max_passing")
    )


@query("""WITH c AS (SELECT DISTINCT o_orderstatus, o_custkey FROM orders), k AS (SELECT o_orderstatus, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey) AS n FROM c) WHERE n <= 16)
  SELECT o_orderstatus, o_custkey, o_orderkey FROM (SELECT o.*, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey, o_orderkey) AS n FROM orders o SEMI JOIN k USING (o_orderstatus, o_custkey)) WHERE n <= 40""")
def capped_channel_points(spark, d):
    o = table(spark, d, "orders").select("o_orderstatus", "o_custkey", "o_orderkey")
    return O.capped_points(o, ["o_orderstatus"], "o_custkey", "o_orderkey", 16, 40)


@query("""SELECT l_returnflag, round(max(CASE WHEN l_linestatus = 'O' THEN m END) - max(CASE WHEN l_linestatus = 'F' THEN m END), 6) AS delta_m FROM (SELECT l_returnflag, l_linestatus, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def point_contrast(spark, d):
    from helixframe.operators.ridge import point_contrasts

    m = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.avg("l_extendedprice").alias("m"))
    return rounded(point_contrasts(m, ["l_returnflag"], "l_linestatus", "O", "F", ["m"]), ["delta_m"])


@query("""SELECT event_id, user_id, round(mean_100 * greatest(1000 - n, 0), 6) AS remaining FROM (SELECT event_id, user_id, row_number() OVER w AS n, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS mean_100 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""")
def remaining_time(spark, d):
    e = A.trailing_mean(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value", 100, "mean_100", "n")
    out = e.select("event_id", "user_id", A.remaining_seconds(F.col("mean_100"), F.col("n"), F.lit(1000)).alias("remaining"))
    return rounded(out, ["remaining"])


@query("""WITH e AS (SELECT l_returnflag, l_suppkey % 25 AS grp, l_extendedprice AS y, CASE WHEN l_returnflag = 'R' THEN 30000.0 ELSE l_quantity * 1500 END AS p FROM lineitem), g AS (SELECT l_returnflag, grp, count(*) AS n, sum(abs(p - y)) AS a, sum((p - y) * (p - y)) AS s FROM e GROUP BY 1, 2),
  b AS (SELECT l_returnflag, CAST(sum(n) AS BIGINT) AS n, round(sum(a) / sum(n), 4) AS mae, round(avg(a / n), 4) AS macro_mae, round(sqrt(sum(s) / sum(n)), 4) AS rmse FROM g GROUP BY 1),
  r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY p) + (count(*) OVER (PARTITION BY l_returnflag, p) - 1) / 2 AS rx, rank() OVER (PARTITION BY l_returnflag ORDER BY y) + (count(*) OVER (PARTITION BY l_returnflag, y) - 1) / 2 AS ry FROM e),
  c AS (SELECT l_returnflag, CASE WHEN min(rx) < max(rx) AND min(ry) < max(ry) THEN round(corr(rx, ry), 9) END AS spearman, min(rx) < max(rx) AND min(ry) < max(ry) AS spearman_defined FROM r GROUP BY 1) SELECT * FROM b JOIN c USING (l_returnflag)""")
def ranked_metric_bundle(spark, d):
    """Errors and rank correlation by flag; one flag's prediction is constant, so its correlation isn't defined."""
    p = F.when(F.col("l_returnflag") == "R", 30000.0).otherwise(F.col("l_quantity") * 1500)
    l = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_suppkey") % 25).alias("grp"), F.col("l_extendedprice").alias("y"), p.alias("p"))
    return rounded(rounded(A.metric_bundle(l, ["l_returnflag"], "grp", "y", "p", ranked=True), ["mae", "macro_mae", "rmse"], 4), ["spearman"], 9)
