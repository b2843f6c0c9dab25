"""One query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import frames, language, licenses, merkle, mixing, packing, parsing, quality, repeats, secrets, simhash, substring, tokens
from helixframe.llm.storage import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.suffix_sums(tokens.length_histogram(tokens.token_counts(table(spark, sf_dir, "documents"))))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.neighbour_fingerprints(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.scanned(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    return rows.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(secrets.joined_spans(base), 256).alias("base_sha256"), secrets.joined_spans(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
        *[F.coalesce(F.array_max(f"spans.{c}"), F.lit(0)).cast("long").alias(f"max_{c}") for c in ("owners", "repos")],
    )


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.with_probabilities(table(spark, sf_dir, "documents"), keep=["doc_id", "source", "lang"])
    return found.select("doc_id", "source", "lang", "topic", "n_tokens", "probability", "sampled")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring.without_duplicates(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.filter(~language.held_out()))
    return language.predict(docs, model).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "token-files")
    frames.write_ids(table(spark, sf_dir, "documents"), folder)
    return frames.read_ids(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(repeats.periodic_runs(table(spark, sf_dir, "documents"), repeat_tails=True))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


_ANY_CASE = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
#: kind, order, pattern, group of the value, its least length
_SECRET_KINDS = (
    ("assign", 0, rf"""({_ANY_CASE})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", 1, secrets.ACCESS, 0, 0), ("hex", 2, secrets.HEX, 0, 0), ("token", 3, secrets.TOKEN, 0, 0),
)


def _secrets_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    kinds = " UNION ALL ".join(
        f"SELECT doc_id, source, '{kind}' AS kind, {order} AS ord, {least} AS least, regexp_extract_all(t, {quoted(pattern)}) AS ms, regexp_extract_all(t, {quoted(pattern)}, {group}) AS vs, regexp_split_to_array(t, {quoted(pattern)}) AS gaps FROM d"
        for kind, order, pattern, group, least in _SECRET_KINDS
    )
    return f"""WITH d AS (SELECT doc_id, coalesce(source, chr(1)) AS source, coalesce(text, '') AS t FROM documents), m AS ({kinds}),
      s AS (SELECT doc_id, source, kind, ord, vs[i] AS v, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS st, length(ms[i]) AS n
        FROM (SELECT *, unnest(generate_series(1, len(ms))) AS i FROM m) WHERE length(vs[i]) >= least),
      own AS (SELECT v, count(DISTINCT source) <= {secrets.MAX_OWNERS} AS live, count(DISTINCT source) AS owners, count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), '')) AS repos FROM s GROUP BY v),
      f AS (SELECT s.*, live, owners, repos, kind || ':' || st || ':' || (st + n) AS span FROM s JOIN own USING (v) WHERE kind <> 'token' OR live)
      SELECT d.doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
        sha256(coalesce(string_agg(span, ',' ORDER BY st, ord) FILTER (WHERE kind <> 'token'), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY st, ord), '') AS spans, count(*) FILTER (WHERE live) AS n_live, coalesce(max(owners), 0) AS max_owners, coalesce(max(repos), 0) AS max_repos
      FROM d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id"""


_SUBSTRING_SQL = r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
  win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 12)) AS i FROM w)),
  first AS (SELECT k, min(doc_id) AS f FROM win GROUP BY k), hit AS (SELECT doc_id, i FROM win JOIN first USING (k) WHERE f < doc_id),
  gone AS (SELECT DISTINCT doc_id, i + j AS p FROM hit, (SELECT unnest(generate_series(0, 12)) AS j)),
  word AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS p FROM w),
  kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""


_MERKLE_SQL = """WITH RECURSIVE
  tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
  docs AS (SELECT *, coalesce(n_chars + CAST(xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 7 = 0 AS INT), n_chars) AS changed FROM documents, tab),
  leaf AS (SELECT doc_id, lang, sha256(f1 || f2 || f3 || f4 || f5) AS leaf, sha256(f1 || f2 || f3 || f6 || f5) AS tampered FROM (SELECT doc_id, lang, FIELDS FROM docs)),
  placed AS (SELECT *, row_number() OVER (ORDER BY lang NULLS FIRST, doc_id NULLS FIRST, leaf) AS id, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaf),
  up AS (SELECT lang, 0 AS lev, pos, leaf AS h, n FROM placed
    UNION ALL SELECT lang, lev + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM up WHERE n > 1 GROUP BY lang, lev, pos // 2, n),
  sub AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
  top AS (SELECT 0 AS lev, pos, h, n FROM sub UNION ALL SELECT lev + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY lev, pos // 2, n),
  f AS (SELECT id, lang, 0 AS lev, pos, n, tampered AS h, '' AS proof FROM placed
    UNION ALL SELECT f.id, f.lang, f.lev + 1, f.pos // 2, (f.n + 1) // 2, sha256(CASE WHEN f.pos % 2 = 1 THEN u.h || f.h ELSE f.h || coalesce(u.h, '') END), f.proof || coalesce(u.h, '')
      FROM f LEFT JOIN up u ON u.lang IS NOT DISTINCT FROM f.lang AND u.lev = f.lev AND u.pos = xor(f.pos, 1) WHERE f.n > 1),
  g AS (SELECT f.id, 0 AS lev, sub.pos, sub.n, f.h, f.proof FROM f JOIN sub ON sub.lang IS NOT DISTINCT FROM f.lang WHERE f.n = 1
    UNION ALL SELECT g.id, g.lev + 1, g.pos // 2, (g.n + 1) // 2, sha256(CASE WHEN g.pos % 2 = 1 THEN u.h || g.h ELSE g.h || coalesce(u.h, '') END), g.proof || coalesce(u.h, '')
      FROM g LEFT JOIN top u ON u.lev = g.lev AND u.pos = xor(g.pos, 1) WHERE g.n > 1)
  SELECT p.doc_id, p.leaf, sub.h AS subroot, top.h AS root, sha256(g.proof) AS proof_sha256, g.h AS folded_root, g.h = top.h AS verified
  FROM placed p JOIN sub ON sub.lang IS NOT DISTINCT FROM p.lang JOIN g ON g.id = p.id AND g.n = 1, top WHERE top.n = 1""".replace(
    "FIELDS", ", ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END AS f{i}" for i, c in enumerate(("doc_id", "source", "lang", "n_chars", "text", "changed"), 1))
)


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express in whole."""
    return {"op7_secret_scans": _secrets_sql(), "op9_substring_dedup": _SUBSTRING_SQL, "op12_merkle_manifest": _MERKLE_SQL}
