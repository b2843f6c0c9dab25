"""Filters, ordered rules, string windows and explosions."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions import sequences as S
from helixframe.operators import classify, reshape
from helixframe.queries import query
from helixframe.session import table


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice > 1000")
def filter_group_slice(spark, d):
    o = table(spark, d, "orders")
    eligible = (F.col("o_orderstatus") == "F") & classify.accepted(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"]) & (F.col("o_totalprice") > 1000)
    return o.filter(eligible).select("o_orderkey", "o_custkey", "o_totalprice")


@query("""SELECT p_partkey, CASE WHEN p_size <= 10 AND p_retailprice < 1000 THEN 'small_cheap' WHEN p_size <= 10 THEN 'small'
  WHEN p_retailprice >= 1500 THEN 'dear' WHEN p_type LIKE '%STEEL%' THEN 'steel' ELSE 'other' END AS part_class FROM part""")
def ordered_rule_classify(spark, d):
    size, price = F.col("p_size"), F.col("p_retailprice")
    rules = [((size <= 10) & (price < 1000), "small_cheap"), (size <= 10, "small"), (price >= 1500, "dear"), (F.col("p_type").like("%STEEL%"), "steel")]
    return table(spark, d, "part").select("p_partkey", classify.ordered_rules(rules, "other").alias("part_class"))


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, repeat(translate(l_returnflag, 'ANR', 'ACG'), CAST(1 + l_linenumber % 2 AS BIGINT)) AS ref,
  repeat(CASE WHEN l_tax = 0 THEN '*' ELSE translate(l_linestatus, 'OF', 'TC') END, CAST(1 + l_partkey % 3 AS BIGINT)) AS alt FROM lineitem)
  SELECT l_orderkey, l_linenumber, CASE WHEN regexp_full_match(ref, '[ACGT]') AND regexp_full_match(alt, '[ACGT]') AND ref <> alt THEN 'SNV'
  WHEN length(ref) = length(alt) AND regexp_full_match(ref, '[A-Za-z]+') AND regexp_full_match(alt, '[A-Za-z]+') THEN 'MNV'
  WHEN length(alt) > length(ref) THEN 'insertion' WHEN length(alt) < length(ref) THEN 'deletion' ELSE 'other' END AS variant_class FROM v""")
def variant_class_rules(spark, d):
    ref = F.repeat(F.translate("l_returnflag", "ANR", "ACG"), (1 + F.col("l_linenumber") % 2).cast("int"))
    alt = F.repeat(F.when(F.col("l_tax") == 0, "*").otherwise(F.translate("l_linestatus", "OF", "TC")), (1 + F.col("l_partkey") % 3).cast("int"))
    v = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ref.alias("ref"), alt.alias("alt"))
    return v.select("l_orderkey", "l_linenumber", classify.variant_class(F.col("ref"), F.col("alt")).alias("variant_class"))


@query("""SELECT event_id, CASE WHEN (event_id % 2 = 0 AND off IN (1, 2)) OR (event_id % 2 = 1 AND off IN (-1, -2)) THEN 'canonical_intronic' WHEN off = 0 THEN 'exonic_boundary' WHEN abs(off) <= 20 THEN 'nearby' ELSE 'distant' END AS site_category
  FROM (SELECT event_id, CAST(event_id % 61 AS INTEGER) - 30 AS off FROM events)""")
def site_category_rules(spark, d):
    e = table(spark, d, "events").select("event_id", ((F.col("event_id") % 61).cast("int") - 30).alias("off"), F.when(F.col("event_id") % 2 == 0, "donor").otherwise("acceptor").alias("kind"))
    return e.select("event_id", classify.site_category(F.col("kind"), F.col("off")).alias("site_category"))


@query("SELECT p_partkey, list_contains(string_split(p_type, ' '), split_part(p_type, ' ', 1)) AS has_first, list_contains(string_split(p_type, ' '), 'STEEL') AS has_steel FROM part")
def delimited_membership(spark, d):
    t = F.col("p_type")
    return table(spark, d, "part").select("p_partkey", classify.in_list(t, F.split_part(t, F.lit(" "), F.lit(1)), " ").alias("has_first"), classify.in_list(t, "STEEL", " ").alias("has_steel"))


@query("""SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 200000) THEN 'urgent'
  WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 'filled' ELSE 'other' END AS priority_class FROM customer""")
def priority_class_semijoin(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    sets = [("urgent", o.filter("o_orderpriority = '1-URGENT' and o_totalprice > 200000")), ("filled", o.filter("o_orderstatus = 'F'"))]
    return classify.priority_by_membership(table(spark, d, "customer").select("c_custkey"), ["c_custkey"], sets, "other")


_SEQ_SQL = "SELECT doc_id, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'BDEFHIJKLMOPQRSUVWXYZ', 'ACGTACGTACGTACGTACGTA') AS seq FROM documents"


def sequences(spark, d):
    """Every whole text as a nucleotide string: its letters, dealt to the alphabet."""
    seq = F.translate(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), "BDEFHIJKLMOPQRSUVWXYZ", "ACGTACGTACGTACGTACGTA")
    return table(spark, d, "documents").select("doc_id", seq.alias("seq"))


@query(f"""WITH s AS ({_SEQ_SQL})
  SELECT doc_id, sha256(reverse(translate(seq, 'ACGTN', 'TGCAN'))) AS rc_sha256, sha256(translate(seq, 'ACGTN', 'TGCAN')) AS complement_sha256,
  reverse(translate(reverse(translate(seq, 'ACGTN', 'TGCAN')), 'ACGTN', 'TGCAN')) = seq AS round_trip FROM s""")
def reverse_complement_text(spark, d):
    s = sequences(spark, d)
    rc = S.reverse_complement(F.col("seq"))
    return s.select("doc_id", F.sha2(rc, 256).alias("rc_sha256"), F.sha2(S.complement(F.col("seq")), 256).alias("complement_sha256"), (S.reverse_complement(rc) == F.col("seq")).alias("round_trip"))


@query("""WITH s AS (SELECT doc_id, text, 1 + CAST(doc_id * 37 % 900 AS INTEGER) AS pos FROM documents),
  w AS (SELECT doc_id, pos, CASE WHEN pos - 32 >= 1 AND pos + 31 <= length(text) THEN substr(text, pos - 32, 64) END AS win FROM s)
  SELECT doc_id, pos, win AS window_text, left(win, 32) || '*' || substr(win, 34) AS alt_text, CASE WHEN win IS NULL THEN NULL ELSE CASE WHEN substr(win, 33, 1) = '*' THEN 0 ELSE 1 END END AS n_differences FROM w""")
def window_slice_bounds(spark, d):
    s = table(spark, d, "documents").select("doc_id", "text", (1 + F.col("doc_id") * 37 % 900).cast("int").alias("pos"))
    w = s.select("doc_id", "pos", S.window_around(F.col("text"), F.col("pos"), 64).alias("window_text"))
    w = w.withColumn("alt_text", S.with_centre(F.col("window_text"), F.lit("*"), 64))
    return w.withColumn("n_differences", S.differences(F.col("window_text"), F.col("alt_text")))


@query("""SELECT r_regionkey, r_name, p.position AS position, b.alt FROM region, (SELECT unnest(generate_series(-20, 20)) AS position) p, (SELECT unnest(['A','C','G','T']) AS alt) b
  WHERE b.alt <> substr('ACGT', 1 + CAST(((r_regionkey + p.position) % 4 + 4) % 4 AS INTEGER), 1)""")
def explode_alternatives(spark, d):
    r = table(spark, d, "region").select("r_regionkey", "r_name")
    at = reshape.positions_around(r.withColumn("centre", F.lit(0)), "centre", 20)
    ref = F.substring(F.lit("ACGT"), 1 + F.pmod(F.col("r_regionkey") + F.col("position"), F.lit(4)).cast("int"), F.lit(1))
    return reshape.alternative_bases(at.withColumn("ref", ref), "ref").select("r_regionkey", "r_name", F.col("position").cast("long").alias("position"), "alt")


@query("SELECT p_partkey, u.w AS word, u.i AS place FROM part, LATERAL (SELECT unnest(string_split(p_type, ' ')) AS w, unnest(generate_series(1, len(string_split(p_type, ' ')))) AS i) u")
def explode_delimited(spark, d):
    return reshape.split_rows(table(spark, d, "part").select("p_partkey", "p_type"), "p_type", " ", "word", "place").select("p_partkey", "word", F.col("place").cast("long").alias("place"))


@query("""SELECT o_orderkey, 1000 - (o_orderkey % 500 + 40) AS rc_start, 1000 - (o_orderkey % 500) AS rc_end, 'v_' || o_orderkey || '_' || o_custkey AS run_id FROM orders""")
def reversed_intervals(spark, d):
    start = F.col("o_orderkey") % 500
    a, b = S.reversed_interval(start, start + 40, 1000)
    return table(spark, d, "orders").select("o_orderkey", a.alias("rc_start"), b.alias("rc_end"), S.variant_key("v", F.col("o_orderkey"), F.col("o_custkey")).alias("run_id"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE value IS NOT NULL AND isfinite(value) AND event_type = 'purchase'""")
def finite_event_properties(spark, d):
    e = table(spark, d, "events").filter((F.col("event_type") == "purchase") & F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""SELECT l_returnflag, l_linestatus, l_shipmonth, n FROM (SELECT l_returnflag, l_linestatus, date_trunc('month', l_shipdate)::DATE AS l_shipmonth, count(*) AS n FROM lineitem
  WHERE l_quantity BETWEEN 10 AND 20 AND l_discount > 0.02 GROUP BY 1, 2, 3)""")
def range_containment(spark, d):
    l = table(spark, d, "lineitem").filter(F.col("l_quantity").between(10, 20) & (F.col("l_discount") > 0.02))
    return l.groupBy("l_returnflag", "l_linestatus", F.trunc("l_shipdate", "month").alias("l_shipmonth")).agg(F.count("*").alias("n"))


@query("SELECT 'orders' AS dataset, o_orderkey AS id, o_totalprice AS price, NULL AS status_of_line FROM orders UNION ALL SELECT 'lineitem', l_orderkey, l_extendedprice, l_linestatus FROM lineitem")
def union_with_dataset_tag(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_extendedprice").alias("price"), F.col("l_linestatus").alias("status_of_line"))
    return reshape.tagged_union({"orders": o, "lineitem": l}).select("dataset", "id", "price", "status_of_line")


@query(f"""WITH s AS ({_SEQ_SQL}), w AS (SELECT doc_id, seq, length(seq) // 2 AS i FROM s)
  SELECT doc_id, 'forward' AS view, sha256(seq) AS seq_sha256, i AS variant_index_0based FROM w UNION ALL SELECT doc_id, 'rc', sha256(reverse(translate(seq, 'ACGTN', 'TGCAN'))), length(seq) - 1 - i FROM w""")
def orientation_pairs(spark, d):
    n = F.length("seq").cast("long")
    pairs = S.orientation_pair(F.col("seq"), F.floor(n / 2), n)
    return sequences(spark, d).select("doc_id", F.explode(pairs).alias("v")).select("doc_id", "v.view", F.sha2("v.sequence", 256).alias("seq_sha256"), "v.variant_index_0based")
