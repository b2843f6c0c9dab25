"""The pipeline's stages, each judged on its own input by a plain version."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from helixframe.llm import mixing, quality, secrets
from helixframe.llm.storage import written
from tests.llm.test_operators import alike, base_counts, base_spans, plain_raking, union

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, before, FOLDER), name)
        seen[name] = (before, after)
        before = after
    return seen


def texts(df):
    return {r["doc_id"]: r["text"] or "" for r in df.collect()}


def test_columns_and_order(stages):
    assert list(stages) == ["quality_rules", "simhash_near_dedup", "secret_scans", "source_mixing", "best_fit_packing"]
    for name, (before, after) in stages.items():
        if name != "best_fit_packing":
            assert after.columns == list(corpus_pipeline.COLUMNS)
            assert after.count() <= before.count() and after.select("doc_id").distinct().count() == after.count()


def test_quality_rules(spark, stages):
    before, after = stages["quality_rules"]
    t, kept = texts(before), set(texts(after))
    passed = {k for k, x in t.items() if base_counts(x)[0] >= 20 and 100 * base_counts(x)[4] <= 30 * base_counts(x)[0]}
    found, rules = quality.judged(before, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    rows = {r["doc_id"]: r for r in found.collect()}
    # the learned list, evaluated row by row outside Spark
    holds = lambda r, c: r[c.feature] >= c.threshold if c.at_least else r[c.feature] < c.threshold
    assert kept == {k for k in passed if not any(all(holds(rows[k], c) for c in rule) for rule in rules.rules)}
    good = {r["doc_id"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").filter("quality = 1").collect()} & passed
    assert len(good & kept) >= 0.95 * len(good)


def test_near_duplicates(stages):
    before, after = stages["simhash_near_dedup"]
    t = texts(before)
    comp = union([(a, b) for a in t for b in t if a < b and alike(t[a], t[b])], t)
    assert set(texts(after)) == set(comp.values())


def test_secrets(spark, stages):
    before, after = stages["secret_scans"]
    a, b = texts(before), texts(after)
    assert set(a) == set(b)
    spans = {r["doc_id"]: r["spans"] for r in secrets.scanned(before).collect()}
    for k, t in a.items():
        out, at = [], 0
        assert [(s["start"], s["order"], s["kind"], s["end"]) for s in spans[k] if s["base"]] == base_spans(t)
        for s in spans[k]:
            if s["start"] >= at:
                out += [t[at : s["start"]], "[secret]"]
            at = max(at, s["end"])
        assert b[k] == "".join([*out, t[at:]])
    assert after.filter(F.length("text") != F.col("n_chars")).count() == 0


def test_mixing(stages):
    before, after = stages["source_mixing"]
    rows = mixing.with_probabilities(before).collect()
    weights = {}
    for r in rows:
        k = r["source"], r["lang"], r["topic"]
        weights[k] = weights.get(k, 0) + r["n_tokens"]
    kept, expected = set(texts(after)), sum(r["n_tokens"] * r["probability"] for r in rows)
    assert expected == pytest.approx(0.8 * sum(weights.values())) and kept == {r["doc_id"] for r in rows if r["sampled"]}
    want = plain_raking(weights, 0.8)
    reached = lambda p, d: {v: sum(w * p[k] for k, w in weights.items() if k[d] == v) for v in {k[d] for k in weights}}
    got = {(r["source"], r["lang"], r["topic"]): r["probability"] for r in rows}
    assert all(reached(got, d)[v] == pytest.approx(x, rel=0.1, abs=0.01 * expected) for d in (1, 2) for v, x in reached(want, d).items())


def test_packing(stages):
    before, after = stages["best_fit_packing"]
    assert set(texts(before)) == {r["doc_id"] for r in after.select("doc_id").collect()}
    assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0


def test_empty_tables_and_columns_named_alike(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), FOLDER).count() == 0, name
    more = docs.limit(40).withColumns({c: F.lit(1) for c in ("row", "comp", "_spans", "topic", "length", "kept", "set")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, more, FOLDER).columns == list(corpus_pipeline.COLUMNS), name


def test_run_is_its_stages(spark, stages):
    got, want = corpus_pipeline.run(spark, FOLDER), stages["best_fit_packing"][1]
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
