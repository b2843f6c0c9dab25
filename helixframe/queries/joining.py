"""Overlap, nearness, radius and membership joins; joins with checked cardinality; integrity of keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import joins, reshape
from helixframe.quality import checks
from helixframe.queries import query
from helixframe.session import table

DAY = 86_400


def _days(c: str):
    return F.datediff(F.col(c).cast("date"), F.lit("1992-01-01").cast("date")).cast("long")


def _seconds(c: str):
    return F.unix_timestamp(F.col(c))


@query("""WITH c AS (SELECT c_custkey, c_nationkey, c_custkey % 2000 AS gene_start, c_custkey % 2000 + 30 AS gene_end FROM customer),
  o AS (SELECT o_orderkey, CAST(o_custkey % 25 AS INTEGER) AS c_nationkey, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS pos, o_orderkey % 5 + 1 AS ref_len FROM orders)
  SELECT o_orderkey, c_custkey FROM o JOIN c USING (c_nationkey) WHERE pos <= gene_end AND pos + ref_len - 1 >= gene_start""")
def interval_gene_overlap(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", (F.col("c_custkey") % 2000).alias("gene_start"), (F.col("c_custkey") % 2000 + 30).alias("gene_end"))
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 25).cast("int").alias("c_nationkey"), _days("o_orderdate").alias("pos"), (_days("o_orderdate") + F.col("o_orderkey") % 5).alias("pos_end"))
    return joins.overlap_join(o, c, ["c_nationkey"], ("pos", "pos_end"), ("gene_start", "gene_end"), 64, shared=True).select("o_orderkey", "c_custkey")


@query("""SELECT user_id, event_id, next_event_id, next_event_type, (epoch_us(next_ts) // 1000000) - (epoch_us(ts) // 1000000) AS gap FROM (SELECT user_id, event_id, ts,
  lead(event_id) OVER w AS next_event_id, lead(event_type) OVER w AS next_event_type, lead(ts) OVER w AS next_ts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE next_event_id IS NOT NULL""")
def adjacent_pairs(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts", _seconds("ts").alias("s"))
    pairs = joins.adjacent(e, ["user_id"], [F.col("ts"), F.col("event_id")], ["event_id", "event_type", "s"])
    return pairs.select("user_id", "event_id", "next_event_id", "next_event_type", (F.col("next_s") - F.col("s")).alias("gap"))


@query("""WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000000 AS s FROM events), p AS (SELECT event_id AS site_id, user_id, s AS site FROM e WHERE event_type = 'purchase')
  SELECT event_id, user_id, site_id, site, distance, CASE WHEN s - site = 0 THEN 0 ELSE s - site END AS signed_offset FROM (SELECT e.event_id, e.user_id, e.s, p.site_id, p.site, abs(e.s - p.site) AS distance,
  row_number() OVER (PARTITION BY e.event_id ORDER BY abs(e.s - p.site), p.site_id) AS n FROM e JOIN p USING (user_id)) WHERE n = 1""")
def nearest_boundary(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", _seconds("ts").alias("s"))
    sites = e.filter("event_type = 'purchase'").select("user_id", F.col("s").alias("site"), F.col("event_id").alias("site_id"))
    near = joins.nearest_site(e.select("event_id", "user_id", "s"), sites, ["user_id"], "s", "site", ["site_id"])
    return near.select("event_id", "user_id", "site_id", "site", "distance", (F.col("s") - F.col("site")).alias("signed_offset"))


@query("""WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000000 AS s FROM events)
  SELECT a.event_id, b.event_id AS error_id, a.s - b.s AS signed_offset FROM e a JOIN e b ON a.user_id = b.user_id AND abs(a.s - b.s) <= 7200 WHERE b.event_type = 'error'""")
def radius_pairs(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", _seconds("ts").alias("s"))
    sites = e.filter("event_type = 'error'").select("user_id", F.col("s").alias("site"), F.col("event_id").alias("error_id"))
    return joins.radius_join(e, sites, ["user_id"], "s", "site", 7200).select("event_id", "error_id", (F.col("s") - F.col("site")).alias("signed_offset"))


@query("""WITH e AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS s, event_type FROM events), w AS (SELECT event_id AS window_id, user_id, s - 43200 AS ws, s + 43199 AS we FROM e WHERE event_type = 'purchase')
  SELECT window_id, count(e.event_id) AS n_inside, coalesce(string_agg(CAST(e.s - ws AS VARCHAR) || ':' || CAST(e.event_id AS VARCHAR), ',' ORDER BY e.s, e.event_id), '') AS inside
  FROM w LEFT JOIN e ON w.user_id = e.user_id AND e.s BETWEEN ws AND we GROUP BY window_id""")
def points_in_window_collect(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", _seconds("ts").alias("s"))
    w = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("window_id"), "user_id", (F.col("s") - 43200).alias("ws"), (F.col("s") + 43199).alias("we"))
    found = joins.points_in_windows(w, e.select("user_id", "s", "event_id"), ["user_id"], ("ws", "we"), "s", ["window_id"], ["s", "event_id"], "points")
    text = F.array_join(F.transform("points", lambda p: F.concat_ws(":", p["s"] - F.col("ws"), p["event_id"])), ",")
    return found.select("window_id", F.size("points").cast("long").alias("n_inside"), text.alias("inside"))


@query("""SELECT o_orderkey, count(l_orderkey) AS n_lines, coalesce(string_agg(CAST(l_linenumber AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey), '') AS lines
  FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def windows_collect(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    l = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    found = joins.with_lists(o, l, ["o_orderkey"], ["l_linenumber", "l_partkey"], "lines")
    return found.select("o_orderkey", F.size("lines").cast("long").alias("n_lines"), F.array_join(F.transform("lines", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"])), ",").alias("lines"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def semi_existing(spark, d):
    l = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").join(l, "o_orderkey", "left_semi")


@query("SELECT doc_id, lang, source FROM documents WHERE NOT (doc_id IN (SELECT doc_id FROM labels) AND doc_id IN (SELECT doc_id FROM documents WHERE n_chars > 500))")
def anti_pending(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return joins.pending(docs, [table(spark, d, "labels"), docs.filter("n_chars > 500")], ["doc_id"]).select("doc_id", "lang", "source")


@query("SELECT l.doc_id, l.quality, l.toxic, d.source, d.n_chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id")
def validated_one_to_one(spark, d):
    labels = table(spark, d, "labels")
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars").join(labels.select("doc_id"), "doc_id", "left_semi")
    return joins.one_to_one(labels, docs, ["doc_id"]).select("doc_id", "quality", "toxic", "source", "n_chars")


@query("SELECT a.o_orderkey, a.o_totalprice AS o_totalprice_left, b.o_totalprice AS o_totalprice_right FROM orders a JOIN orders b ON a.o_orderkey = b.o_orderkey")
def aligned_frames(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return joins.aligned(o, o, ["o_orderkey"])


@query("""WITH e AS (SELECT event_id, user_id % 12 AS grp, (epoch_us(ts) // 60000000) - 60 AS ws, (epoch_us(ts) // 60000000) + 59 AS we FROM events WHERE event_type IN ('purchase', 'error')),
  f AS (SELECT DISTINCT grp AS outer_grp FROM e),
  t AS (SELECT f.outer_grp, e.* FROM f JOIN e ON e.grp = f.outer_grp), r AS (SELECT f.outer_grp, e.* FROM f JOIN e ON e.grp <> f.outer_grp)
  SELECT r.outer_grp, count(*) AS initial_train_n, count(*) FILTER (WHERE hit) AS excluded_overlap_n, count(*) FILTER (WHERE NOT hit) AS retained_train_n, CAST(sum(pairs) AS BIGINT) AS overlap_pairs FROM
  (SELECT r.outer_grp, r.event_id, count(t.event_id) > 0 AS hit, count(t.event_id) AS pairs FROM r LEFT JOIN t ON r.outer_grp = t.outer_grp AND r.ws <= t.we AND r.we >= t.ws GROUP BY ALL) r GROUP BY r.outer_grp""")
def purged_training_set(spark, d):
    e = table(spark, d, "events").filter("event_type in ('purchase', 'error')")
    minute = F.floor(_seconds("ts") / 60)
    e = e.select("event_id", (F.col("user_id") % 12).alias("grp"), (minute - 60).alias("ws"), (minute + 59).alias("we"))
    return joins.purge_counts(e, "grp", "event_id", ("ws", "we"), 120).withColumnRenamed("grp", "outer_grp")


@query("""SELECT o.o_orderkey, o.o_custkey, s.n_orders, s.total FROM orders o JOIN (SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey) s USING (o_custkey)""")
def reference_reuse(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    score = lambda keys: o.join(keys, "o_custkey").groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return joins.scored_once(o.drop("o_totalprice"), ["o_custkey"], score).select("o_orderkey", "o_custkey", "n_orders", "total")


@query("""SELECT r_name, n_name, m.model FROM region, nation, (SELECT unnest(['scalar', 'signed', 'reference']) AS model) m""")
def scope_cross(spark, d):
    models = spark.createDataFrame([("scalar",), ("signed",), ("reference",)], "model string")
    return table(spark, d, "region").select("r_name").crossJoin(table(spark, d, "nation").select("n_name")).crossJoin(models)


@query("""SELECT count(*) FILTER (WHERE l AND NOT r) AS left_only, count(*) FILTER (WHERE r AND NOT l) AS right_only, count(*) FILTER (WHERE l AND r) AS "both",
  count(*) FILTER (WHERE l <> r) = 0 AS equal, count(*) FILTER (WHERE l AND r) = 0 AS disjoint, count(*) FILTER (WHERE l AND NOT r) = 0 AS left_in_right
  FROM (SELECT k, bool_or(s = 1) AS l, bool_or(s = 2) AS r FROM (SELECT l_orderkey AS k, 1 AS s FROM lineitem UNION ALL SELECT o_orderkey, 2 FROM orders) GROUP BY k)""")
def set_equality_audit(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"))
    return reshape.set_comparison(l, table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), ["k"])


@query("""SELECT o_custkey, count(*) AS n, sha256('[' || string_agg('"' || id || '"', ',' ORDER BY id) || ']') AS membership_sha256 FROM (SELECT o_custkey, CAST(o_orderkey AS VARCHAR) AS id FROM orders) GROUP BY o_custkey""")
def membership_hash(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").cast("string").alias("id"))
    return checks.membership_hash(o, ["o_custkey"], "id")


@query("""SELECT l_orderkey, count(*) AS n_rows, count(DISTINCT o_custkey || '/' || o_orderstatus) AS n_variants, count(DISTINCT o_custkey || '/' || o_orderstatus) = 1 AS consistent
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey""")
def group_consistency(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "o_custkey", "o_orderstatus")
    return checks.group_consistency(j, ["l_orderkey"], ["o_custkey", "o_orderstatus"])


@query("""SELECT 'doc_id unique' AS expectation, count(*) = count(DISTINCT doc_id) AS passed, count(*) - count(DISTINCT doc_id) AS failures FROM documents
  UNION ALL SELECT 'text present', count(*) FILTER (WHERE text IS NULL) = 0, count(*) FILTER (WHERE text IS NULL) FROM documents
  UNION ALL SELECT 'n_chars matches', count(*) FILTER (WHERE n_chars <> length(text)) = 0, count(*) FILTER (WHERE n_chars <> length(text)) FROM documents
  UNION ALL SELECT 'known language', count(*) FILTER (WHERE lang NOT IN ('en', 'fr', 'de', 'es')) = 0, count(*) FILTER (WHERE lang NOT IN ('en', 'fr', 'de', 'es')) FROM documents""")
def expectations(spark, d):
    rules = {"text present": F.col("text").isNotNull(), "n_chars matches": F.col("n_chars") == F.length("text"), "known language": F.col("lang").isin("en", "fr", "de", "es")}
    return checks.expectations(table(spark, d, "documents"), rules, unique={"doc_id unique": ["doc_id"]})


@query("""SELECT o_orderstatus, count(*) AS n, count(*) FILTER (WHERE ok) AS passed, CASE WHEN count(*) FILTER (WHERE ok) = count(*) THEN 'PASS' WHEN count(*) FILTER (WHERE ok) = 0 THEN 'FAIL' ELSE 'PARTIAL_PASS' END AS status
  FROM (SELECT o_orderstatus, o_totalprice > 1000 AND o_orderkey % 7 <> 0 AS ok FROM orders) GROUP BY o_orderstatus""")
def audit_status(spark, d):
    o = table(spark, d, "orders").select("o_orderstatus", ((F.col("o_totalprice") > 1000) & (F.col("o_orderkey") % 7 != 0)).alias("ok"))
    return checks.audit_status(o, ["o_orderstatus"], F.col("ok"))
