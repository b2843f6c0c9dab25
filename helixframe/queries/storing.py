"""Readers, writers, run stores and checks, each over tables written by the query itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions import sequences as S
from helixframe.operators import joins
from helixframe.operators.ordinals import with_ordinals
from helixframe.plans import screen
from helixframe.quality import checks
from helixframe.queries import query
from helixframe.queries.vectorial import pairs
from helixframe.session import kept, scratch, table
from helixframe.sinks import tables as K
from helixframe.sources import genomics as G
from helixframe.sources import tables as T
from helixframe.streaming import progress


#: Events for which a third of the markers goes to a file more.
FILE_ROWS = 1_000_000


def kept_scratch(spark, name):
    """A scratch path that goes with ``session.clear`` or the process."""
    return kept(scratch(spark, name))



@query("SELECT s_suppkey, s_acctbal, s_acctbal > 0 AS in_credit FROM supplier")
def csv_whitelist(spark, d):
    """A typed CSV table of which only the listed columns leave the reader."""
    path = kept_scratch(spark, "csv")
    s = table(spark, d, "supplier").withColumn("in_credit", F.when(F.col("s_acctbal") > 0, "True").otherwise("False"))
    K.write_csv(s, path, ["s_suppkey", "s_name", "s_acctbal", "in_credit"])
    got = T.read_csv(spark, path, "s_suppkey long, s_name string, s_acctbal double, in_credit string", ["s_suppkey", "s_acctbal", "in_credit"])
    return got.withColumn("in_credit", T.truth(F.col("in_credit")))


@query("SELECT r_regionkey AS key, r_name AS region, NULL AS nation FROM region UNION ALL SELECT n_nationkey, NULL, n_name FROM nation")
def csv_union_header(spark, d):
    """Two frames of different columns under one header."""
    path = kept_scratch(spark, "union")
    a = table(spark, d, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("region"))
    header = K.write_csv_union([a, table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("nation"))], path)
    return T.read_csv(spark, path, "key int, region string, nation string", header)


@query("""SELECT 'all' AS output, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders UNION ALL SELECT 'urgent', count(*), round(sum(o_totalprice), 2) FROM orders WHERE o_orderpriority LIKE '1%'
  UNION ALL SELECT 'large', count(*), round(sum(o_totalprice), 2) FROM orders WHERE o_totalprice > 200000""")
def multi_sink(spark, d):
    """Several filtered tables from one pass, read back one by one."""
    path = kept_scratch(spark, "outputs")
    names = {"all": F.lit(True), "urgent": F.col("o_orderpriority").startswith("1"), "large": F.col("o_totalprice") > 200000}
    K.write_many(table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority"), {k: (c, ["o_totalprice"]) for k, c in names.items()}, path)
    one = lambda k: K.read_output(spark, path, k, ["o_totalprice"]).agg(F.lit(k).alias("output"), F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return one("all").unionByName(one("urgent")).unionByName(one("large"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS run_id, CASE WHEN o_orderkey % 3 = 0 THEN 'planned' WHEN o_totalprice > 50000 THEN 'complete' ELSE 'quarantined' END AS status FROM orders""")
def run_store_status(spark, d):
    """A resumable run: committed rows by two commits, the second overlapping the first, rows in quarantine, and what is left to do."""
    store = K.RunStore(spark, kept_scratch(spark, "runs"))
    plan = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("run_id"), "o_totalprice", (F.col("o_orderkey") % 3).alias("third"))
    ok = F.col("o_totalprice") > 50000
    store.commit(plan.filter("third = 1"), ok, "config")
    store.commit(plan.filter("third > 0"), ok, "config")
    done = store.results("config").select("run_id", F.lit("complete").alias("status"))
    bad = store.quarantined().select("run_id").distinct().withColumn("status", F.lit("quarantined"))
    rest = store.pending(plan, "config").join(bad, "run_id", "left_anti").select("run_id", F.lit("planned").alias("status"))
    return done.unionByName(bad).unionByName(rest)


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def staged_table(spark, d):
    """The second of two staged writes is what a reader finds."""
    path, n = kept_scratch(spark, "staged"), table(spark, d, "nation")
    K.write_staged(n, path)
    K.write_staged(n.filter("n_regionkey = 1").select("n_nationkey", "n_name"), path)
    return spark.read.parquet(path)


@query("SELECT 'txt' AS extension, CAST(length(t) AS BIGINT) AS bytes, sha256(t) AS sha256 FROM (SELECT string_agg(r_name, chr(10) ORDER BY r_regionkey) || chr(10) AS t FROM region)")
def file_manifest(spark, d):
    """Name, size and content hash of the files below a folder."""
    path = kept_scratch(spark, "files")
    table(spark, d, "region").orderBy("r_regionkey").coalesce(1).select("r_name").write.text(path)
    listed = K.manifest(spark, path).filter("name like 'part-%'")
    return listed.select(F.regexp_extract("name", r"\.([^.]*)$", 1).alias("extension"), "bytes", "sha256")


_BASES = "translate(md5({}), '0123456789abcdef', 'ACGTACGTACGTACGT')"


@query(f"SELECT 's' || p_partkey AS name, repeat({_BASES.format('p_name')}, 5) AS sequence FROM part")
def fasta_round_trip(spark, d):
    """Records written and read again, lower case raised."""
    path = kept_scratch(spark, "fasta")
    K.write_fasta(table(spark, d, "part").select(F.concat(F.lit("s"), "p_partkey").alias("name"), F.lower(_bases("p_name")).alias("sequence")), path, "name", "sequence")
    return G.read_fasta(spark, path).select("name", "sequence")


def _bases(column: str, times: int = 5):
    return F.repeat(F.translate(F.md5(F.col(column).cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT"), F.lit(times))


@query("""SELECT CAST(p_size % 3 AS VARCHAR) AS chromosome, p_partkey + 1 AS position_1based, 'v' || p_partkey AS id, 'A' AS ref, alt, alt_index, p_type AS kind, CASE WHEN p_size > 25 THEN 'true' END AS large
  FROM part, (VALUES ('C', 0), ('GT', 1)) a(alt, alt_index) WHERE p_size % 3 <> 2""")
def vcf_alternatives(spark, d):
    """Variants of two chromosomes, one row for each alternative, with a flag and a repeated key in INFO."""
    path, tab = kept_scratch(spark, "vcf"), "\t"
    flag = F.when(F.col("p_size") > 25, ";LARGE").otherwise("")
    info = F.concat(F.lit("KIND=none;KIND="), F.col("p_type"), flag)
    line = F.concat_ws(tab, F.concat(F.lit("chr"), (F.col("p_size") % 3).cast("string")), (F.col("p_partkey") + 1).cast("string"), F.concat(F.lit("v"), "p_partkey"), F.lit("A"), F.lit("C,GT"), F.lit("."), F.lit("PASS"), info)
    table(spark, d, "part").select(line).write.text(path)
    v = G.read_vcf(spark, path, ["0", "chr1"])
    return v.select("chromosome", "position_1based", "id", "ref", "alt", "alt_index", F.try_element_at("info", F.lit("KIND")).alias("kind"), F.try_element_at("info", F.lit("LARGE")).alias("large"))


@query("""SELECT CAST(n_regionkey AS VARCHAR) AS chromosome, 'exon' AS feature, CAST(n_nationkey * 10 + 1 AS BIGINT) AS start_1based, CAST(n_nationkey * 10 + 9 AS BIGINT) AS end_1based, n_name AS gene, n_nationkey AS exon_number, n_nationkey % 2 = 0 AS tagged FROM nation""")
def gtf_features(spark, d):
    """Annotation lines with attributes in any order and repeated tags."""
    path, tab = kept_scratch(spark, "gtf"), "\t"
    tag = F.when(F.col("n_nationkey") % 2 == 0, ' tag "basic"; tag "MANE_Select";').otherwise(' tag "basic";')
    attributes = F.concat(F.lit('exon_number "'), F.col("n_nationkey").cast("string"), F.lit('";'), tag, F.lit(' gene_name "'), F.col("n_name"), F.lit('";'))
    first, last = (F.col("n_nationkey") * 10 + 1).cast("string"), (F.col("n_nationkey") * 10 + 9).cast("string")
    line = F.concat_ws(tab, F.concat(F.lit("chr"), F.col("n_regionkey").cast("string")), F.lit("src"), F.lit("exon"), first, last, F.lit("."), F.lit("+"), F.lit("."), attributes)
    table(spark, d, "nation").select(line).write.text(path)
    g = G.read_gtf(spark, path)
    return g.select("chromosome", "feature", "start_1based", "end_1based", "gene", "exon_number", F.array_contains("tags", "MANE_Select").alias("tagged"))


@query("SELECT r_regionkey AS region, r_name AS name FROM region")
def json_documents(spark, d):
    """One row for each file, however many lines it has."""
    path = kept_scratch(spark, "json")
    r = table(spark, d, "region")
    body = F.concat(F.lit('{\n "region": '), F.col("r_regionkey").cast("string"), F.lit(',\n "name": "'), F.col("r_name"), F.lit('"\n}'))
    r.select(F.col("r_regionkey").alias("k"), body.alias("value")).repartition("k").write.partitionBy("k").text(path)
    return T.read_json_documents(spark, f"{path}/k=*", "region int, name string")


@query("SELECT vec_id, vec_id % 7 <> 0 AND vec_id % 11 <> 0 AS valid FROM embeddings")
def series_validation(spark, d):
    """Rows of a table of arrays that have the right length and finite values, and those that don't."""
    path = kept_scratch(spark, "series")
    v = F.transform(F.col("embedding"), lambda x: F.abs(x))
    short = F.when(F.col("vec_id") % 7 == 0, F.slice(v, 1, 60)).otherwise(v)
    broken = F.when(F.col("vec_id") % 11 == 0, F.concat(F.slice(v, 1, 63), F.array(F.lit(float("nan")).cast("float")))).otherwise(short)
    table(spark, d, "embeddings").select("vec_id", broken.alias("relative_l2")).write.parquet(path)
    good, bad = T.read_series(spark, path, "vec_id", ["relative_l2"], 64)
    return good.select("vec_id", F.lit(True).alias("valid")).unionByName(bad.withColumn("valid", F.lit(False)))


@query("SELECT k, v FROM (VALUES ('a', 1), ('a', 2), ('b', 3)) t(k, v)")
def literal_relation(spark, d):
    return T.literal(spark, [("a", [1, 2]), ("b", [3])], "k string, v array<int>", "v")


@query(f"""WITH s AS (SELECT n_nationkey AS k, repeat({_BASES.format('n_name')}, 20) AS q FROM nation)
  SELECT p_partkey, CAST(p_partkey % 25 AS VARCHAR) AS chromosome, p_partkey * 7 % 700 + 1 AS position_1based, length(substr(q, p_partkey * 7 % 700 + 1, p_size % 5 + 1)) = p_size % 5 + 1 AND substr(q, p_partkey * 7 % 700 + 1, p_size % 5 + 1) = substr('ACGTA', 1, p_size % 5 + 1) AS ref_matches FROM part JOIN s ON s.k = p_partkey % 25""")
def reference_base_match(spark, d):
    """The reference allele against the genome, fetched from its chunk."""
    genome = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("name"), _bases("n_name", 20).alias("sequence"))
    n = F.col("p_size") % 5 + 1
    v = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 25).cast("string").alias("chromosome"), (F.col("p_partkey") * 7 % 700 + 1).alias("position_1based"), F.substring(F.lit("ACGTA"), F.lit(1), n).alias("ref"))
    got = G.with_bases(v, G.chunked(genome, 128, 4), "position_1based", F.length("ref"), "bases", 128)
    return got.select("p_partkey", "chromosome", "position_1based", F.coalesce(S.matches_reference(F.col("bases"), F.lit(1), F.col("ref")), F.lit(False)).alias("ref_matches"))


@query("SELECT l_orderkey, l_linenumber, (l_partkey - (l_partkey - l_partkey % 64)) AS forward_index, 63 - (l_partkey % 64) AS reverse_index FROM lineitem")
def window_indexes(spark, d):
    """0-based index in a window of a genomic position, on either strand."""
    l = table(spark, d, "lineitem").withColumn("window_start", F.col("l_partkey") - F.col("l_partkey") % 64)
    at = S.input_index(F.col("l_partkey"), F.col("window_start"))
    first, _ = S.reversed_interval(at, at + 1, 64)
    return l.select("l_orderkey", "l_linenumber", at.alias("forward_index"), first.alias("reverse_index"))


@query("SELECT ordinal, o_orderkey, o_totalprice FROM (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS ordinal FROM orders) WHERE ordinal <= 50")
def lookup_in_order(spark, d):
    """Rows for a list of ids, with the list's own order, and each id exactly once."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    ids = o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey")
    listed = [r["o_orderkey"] for r in ids.collect()]  # fifty of them
    asked = spark.createDataFrame([(k, i + 1) for i, k in enumerate(listed)], "o_orderkey long, ordinal long")
    joins.assert_unique(o, ["o_orderkey"], "orders")
    return joins.in_order_of(asked, o, ["o_orderkey"]).select("ordinal", "o_orderkey", "o_totalprice")


@query("""SELECT 'cv_' || o_orderkey || '_' || (o_custkey + 1000) || '_A_C' AS run_id, g AS screen_group, n <= 5 AS retain_raw FROM (SELECT *, row_number() OVER (ORDER BY p, o_custkey, o_orderkey) AS n FROM
  (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 300000 THEN 0 WHEN o_totalprice > 250000 THEN 1 ELSE 2 END AS p, CASE p WHEN 0 THEN 'splice_dinucleotide' WHEN 1 THEN 'splice_nearby_20bp' ELSE 'other_snv' END AS g FROM orders WHERE o_orderkey % 5 = 0))""")
def first_flagged(spark, d):
    """A screen plan in order of priority, of which the first rows keep their raw arrays."""
    o = table(spark, d, "orders").filter("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") + 1000).alias("position_1based"), F.lit("A").alias("ref"), F.lit("C").alias("alt"), "o_totalprice", "o_orderstatus")
    plan = screen.run_plan(o.withColumn("alt", F.lit("C")), o.filter("o_totalprice > 250000"), o.filter("o_orderstatus = 'F' and o_totalprice > 300000"), ["id"], 64, retain=5)
    return plan.select("run_id", "screen_group", "retain_raw")


@query("""WITH p AS (SELECT vec_id, CAST(r AS DOUBLE[]) AS r, CAST(a AS DOUBLE[]) AS a FROM (SELECT vec_id, embedding AS r, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS a FROM embeddings) WHERE a IS NOT NULL)
  SELECT vec_id, round(list_avg(r[1:32]), 6) AS native_pre, round(list_avg(r[33:64]), 6) AS native_post, round(list_avg(a[1:32]), 6) AS corrected_pre, round(list_avg(a[33:64]), 6) AS corrected_post,
  round(list_avg(a[1:32]) - list_avg(r[1:32]), 6) AS pre_change, round(list_avg(a[33:64]) - list_avg(r[33:64]), 6) AS post_change FROM p""")
def native_versus_corrected(spark, d):
    """Means before and after the centre of two runs of the same rows, and how they differ."""
    p = pairs(spark, d)
    side = lambda c: p.select("vec_id", F.col(c).alias("relative_l2"))
    both = screen.native_versus_corrected(side("r"), side("a"), ["vec_id"], 32)
    return both.select("vec_id", *[F.round(c, 6).alias(c) for c in ("native_pre", "native_post", "corrected_pre", "corrected_post", "pre_change", "post_change")])


@query("""SELECT l_orderkey, count(*) AS n_rows, count(*) = 4 AS whole FROM lineitem GROUP BY 1""")
def group_size_check(spark, d):
    """Groups that have as many rows as they should."""
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_rows")).withColumn("whole", F.col("n_rows") == 4)


@query("""WITH p AS (SELECT vec_id, r, CASE WHEN vec_id % 3 = 0 THEN r ELSE a END AS a FROM (SELECT vec_id, embedding AS r, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS a FROM embeddings) WHERE a IS NOT NULL),
  q AS (SELECT vec_id, list_filter(generate_series(1, 64), lambda i: a[i] <> r[i]) AS pos FROM p)
  SELECT vec_id, len(pos) = 0 AS equal, CAST(len(pos) AS INTEGER) AS changed, CASE WHEN len(pos) > 0 THEN CAST(pos[1] - 1 AS INTEGER) END AS first_position FROM q""")
def repeat_control(spark, d):
    """Two runs of one input: whether they are equal, how many positions differ and the first of them."""
    p = pairs(spark, d)
    second = p.select("vec_id", F.when(F.col("vec_id") % 3 == 0, F.col("r")).otherwise(F.col("a")).alias("series"))
    got = checks.repeat_control(p.select("vec_id", F.col("r").alias("series")), second, ["vec_id"], "series")
    return got.select("vec_id", "equal", F.col("changed").cast("int").alias("changed"), F.col("first_position").cast("int").alias("first_position"))


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = 7")
def exactly_one_row(spark, d):
    """The only row with given values, from a table that reads nothing but its own file."""
    c = checks.reads_only(table(spark, d, "customer"), [d])
    return joins.exactly_one(c, c_custkey=7).select("c_custkey", "c_name", "c_mktsegment")


@query(f"""SELECT 's' || (p_partkey % 7) AS name, CAST(c AS INTEGER) AS chunk, c * 500 + 1 AS start_1based, substring(q, CAST(c * 500 + 1 AS BIGINT), 520) AS bases
  FROM (SELECT p_partkey % 7 AS k, min(p_partkey) AS p_partkey, string_agg(repeat({_BASES.format("p_name")}, 5), '' ORDER BY p_partkey) AS q FROM part GROUP BY 1), unnest(generate_series(0, CAST((length(q) - 1) // 500 AS BIGINT))) u(c)""")
def genome_chunks(spark, d):
    """Overlapping chunks of long sequences, straight from the lines of a file: no task sees a sequence."""
    path = kept_scratch(spark, "genome")
    p = table(spark, d, "part").select((F.col("p_partkey") % 7).alias("k"), "p_partkey", F.lower(_bases("p_name")).alias("line"))
    heads = p.groupBy("k").agg(F.lit(-1).cast("long").alias("p_partkey"), F.concat(F.lit(">s"), F.col("k").cast("string"), F.lit(" made")).alias("line"))
    p.select("k", F.col("p_partkey").cast("long").alias("p_partkey"), "line").unionByName(heads.select("k", "p_partkey", "line")).orderBy("k", "p_partkey").coalesce(1).select("line").write.text(path)
    return G.fasta_chunks(spark, path, 500, 20)


@query("""WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step, count(*) OVER (PARTITION BY user_id) AS n, value FROM events),
  g AS (SELECT user_id, max(n) + CASE WHEN user_id % 3 = 0 THEN 10 ELSE 0 END AS planned, count(*) AS completed FROM s GROUP BY 1),
  m AS (SELECT user_id, avg(value) AS mean_seconds FROM s WHERE step >= n - 100 GROUP BY 1)
  SELECT CAST(user_id AS VARCHAR) AS run, completed, planned, round(mean_seconds, 6) AS mean_seconds, round(mean_seconds * (planned - completed), 6) AS remaining_seconds, planned = completed AS complete FROM g JOIN m USING (user_id)""")
def stateful_progress(spark, d):
    """Events as step markers of a run for each user, streamed from shuffled files with every third marker sent again."""
    e = with_ordinals(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "step", total="n")
    planned = F.col("n") + F.when(F.col("user_id") % 3 == 0, 10).otherwise(0)
    m = e.select(F.col("user_id").cast("string").alias("run"), "step", F.col("value").alias("seconds"), planned.alias("planned"), F.explode(F.when(F.col("event_id") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again"))
    sent, out, state = (kept_scratch(spark, x) for x in ("markers", "progress", "progress-state"))
    # two thirds of the files come first, however many there are
    files = 3 * max(1, -(-e.count() // FILE_ROWS))
    m.repartition(files, F.xxhash64("step", "again", "run")).drop("again").write.parquet(sent)
    stream = spark.readStream.schema(progress.STEP).option("maxFilesPerTrigger", files * 2 // 3).parquet(sent)
    progress.keep_progress(progress.progress_stream(stream), out, state)
    p = progress.latest_progress(spark, out)
    return p.select("run", "completed", "planned", *[F.round(c, 6).alias(c) for c in ("mean_seconds", "remaining_seconds")], (F.col("status") == "complete").alias("complete"))
