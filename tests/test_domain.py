"""The domain tier on tiny hand-written files."""

import gzip
import json
import zlib
import struct
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.sources.blocked import read_blocked_lines
from helixframe.plans import catalog, screen
from helixframe.plugins import layers, scorer
from helixframe.sinks import tables as K
from helixframe.sources import genomics as G
from helixframe.sources import tables as T
from helixframe.streaming import markers, progress

rng = np.random.default_rng(3)
SEQ = "".join(rng.choice(list("ACGT"), 3000))
# gene A (+): exons 101-200, 301-400, 501-600; gene B (-): exons 1501-1600, 1301-1400
GTF = "\n".join(
    ["#!genome"]
    + [
        f'chr7\tsrc\t{feature}\t{a}\t{b}\t.\t{strand}\t.\tgene_id "{g}"; transcript_id "{t}"; exon_number "{n}"; gene_name "{g}"; tag "basic"; tag "MANE_Select";'
        for feature, a, b, strand, g, t, n in [
            ("gene", 101, 600, "+", "A", "", ""), ("transcript", 101, 600, "+", "A", "TA", ""), ("exon", 101, 200, "+", "A", "TA", 1), ("exon", 301, 400, "+", "A", "TA", 2), ("exon", 501, 600, "+", "A", "TA", 3),
            ("gene", 1301, 1600, "-", "B", "", ""), ("transcript", 1301, 1600, "-", "B", "TB", ""), ("exon", 1501, 1600, "-", "B", "TB", 1), ("exon", 1301, 1400, "-", "B", "TB", 2),
        ]
    ]
)


def other(p):
    return next(b for b in "ACGT" if b != SEQ[p - 1])


VCF_ROWS = [
    f"7\t201\tv1\t{SEQ[200]}\t{other(201)},{SEQ[200]}A\t.\tPASS\tGENEINFO=A:1|Z:2;FLAG;CLNSIG=Benign;CLNSIG=Pathogenic",
    f"7\t250\tv2\t{SEQ[249]}\t{other(250)}\t.\tPASS\tGENEINFO=A:1",  # between donor 200 and acceptor 301, nearer the donor
    f"7\t1398\tv3\t{SEQ[1397]}\t{other(1398)}\t.\tPASS\tGENEINFO=B:9",
    f"7\t350\tv4\t{SEQ[349:351]}\tTT\t.\t.\tGENEINFO=AB:1",
    f"7\t352\tv5\t{other(352)}\t{SEQ[351]}\t.\t.\tGENEINFO=A:1",  # reference mismatch
    f"8\t150\tv6\tA\tC\t.\t.\tGENEINFO=A:1",
    f"7\t99\tv7\t{SEQ[98:102]}\t{SEQ[98]}\t.\t.\tGENEINFO=A:1",  # a deletion that reaches into the gene
]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("genome")
    with gzip.open(d / "v.vcf.gz", "wt") as f:
        f.write("##fileDate=2024-01-01\n##reference=G\n#CHROM\tPOS\n" + "\n".join(VCF_ROWS) + "\n")
    with gzip.open(d / "a.gtf.gz", "wt") as f:
        f.write(GTF + "\n")
    with gzip.open(d / "g.fa.gz", "wt") as f:
        body = "\n".join(SEQ[i : i + 60].lower() if i % 120 else SEQ[i : i + 60] for i in range(0, len(SEQ), 60))
        f.write(f">chr7 test\n{body}\n>chr8\nACGTN\n")
    return d


@pytest.fixture(scope="module")
def built(spark, files):
    gtf, genome = G.read_gtf(spark, str(files / "a.gtf.gz")), G.read_fasta(spark, str(files / "g.fa.gz"))
    genes = catalog.genes(gtf, ["A", "B"])
    j = catalog.junctions(catalog.exons(gtf, genes), genome)
    v = catalog.annotated_variants(G.read_vcf(spark, str(files / "v.vcf.gz")), genes, j, genome)
    return genome, genes, j, v


def test_readers(spark, files):
    fa = {r["name"]: r["sequence"] for r in G.read_fasta(spark, str(files / "g.fa.gz")).collect()}
    assert fa == {"chr7": SEQ, "chr8": "ACGTN"}
    assert {r["key"]: r["value"] for r in G.vcf_headers(spark, str(files / "v.vcf.gz")).collect()} == {"fileDate": "2024-01-01", "reference": "G"}
    v = G.read_vcf(spark, str(files / "v.vcf.gz"), ["chr7"]).collect()
    assert len(v) == 7 and {r["chromosome"] for r in v} == {"7"}
    first = next(r for r in v if r["id"] == "v1" and r["alt_index"] == 0)
    assert first["info"] == {"GENEINFO": "A:1|Z:2", "FLAG": "true", "CLNSIG": "Pathogenic"}


def test_junctions(built):
    j = {(r["gene"], r["junction_id"]): r for r in built[2].collect()}
    assert set(j) == {("A", "A_J01"), ("A", "A_J02"), ("B", "B_J01")}
    a, b = j["A", "A_J01"], j["B", "B_J01"]
    assert (a["intron_start_1based"], a["intron_end_1based"], a["donor_exonic_base_1based"], a["acceptor_exonic_base_1based"]) == (201, 300, 200, 301)
    assert a["donor_dinucleotide"] == SEQ[200:202] and a["acceptor_dinucleotide"] == SEQ[298:300]
    assert (b["donor_exonic_base_1based"], b["acceptor_exonic_base_1based"]) == (1501, 1400)
    swap = str.maketrans("ACGT", "TGCA")
    assert b["donor_dinucleotide"] == (SEQ[1499] + SEQ[1498]).translate(swap) and b["acceptor_dinucleotide"] == (SEQ[1401] + SEQ[1400]).translate(swap)


def test_catalog(built):
    v = {(r["id"], r["alt_index"]): r for r in built[3].collect()}
    assert set(v) == {("v1", 0), ("v1", 1), ("v2", 0), ("v3", 0), ("v4", 0), ("v5", 0), ("v7", 0)}
    one = v["v1", 0]
    assert (one["variant_class"], one["site_type"], one["offset_in_transcript"], one["site_category"]) == ("SNV", "donor", 1, "canonical_intronic")
    assert v["v1", 1]["variant_class"] == "insertion" and v["v1", 1]["site_1based"] is None
    assert v["v4", 0]["variant_class"] == "MNV" and not v["v4", 0]["geneinfo_matches_gene"]
    assert v["v5", 0]["ref_matches_genome"] is False and v["v7", 0]["variant_class"] == "deletion" and v["v7", 0]["within_transcript"] is False
    assert v["v2", 0]["junction_id"] == "A_J01" and v["v2", 0]["distance"] == 50 and v["v2", 0]["site_type"] == "donor"
    assert v["v3", 0]["site_type"] == "acceptor" and v["v3", 0]["offset_in_transcript"] == 2
    near = {(r["id"], r["near_site_type"]) for r in catalog.nearby_sites(built[3], built[2]).collect()}
    assert near == {("v1", "donor"), ("v3", "acceptor")}


def test_equidistant_site_takes_acceptor(spark):
    from helixframe.operators.joins import nearest_site

    points = spark.createDataFrame([("g", 15), ("g", 3), ("h", 1)], "gene string, pos long")
    sites = spark.createDataFrame([("g", 10, "J01", "donor"), ("g", 20, "J01", "acceptor"), ("g", 10, "J01", "acceptor")], "gene string, site long, junction_id string, site_type string")
    got = {r["pos"]: (r["site_type"], r["distance"]) for r in nearest_site(points, sites, ["gene"], "pos", "site", ["junction_id", "site_type"]).collect()}
    assert got == {15: ("acceptor", 5), 3: ("acceptor", 7)}


def test_saturation(built):
    genome, _, j, v = built
    every, fresh = catalog.saturation(j, genome, v, 20)
    n = every.count()
    spans = [range(s - 20, s + 21) for s in (200, 301, 400, 501)] + [range(s - 20, s + 21) for s in (1501, 1400)]
    assert n == 3 * len({p for s in spans for p in s})
    assert n - fresh.count() == 2  # v1 and v3 are known


def test_windows_from_chunks(spark, built):
    chunks = G.chunked(built[0], 256, overlap=64)
    v = spark.createDataFrame([("7", p) for p in (5, 33, 256, 257, 1000, 2968, 2969)], "chromosome string, position_1based long")
    got = {r["position_1based"]: r["window"] for r in G.with_windows(v, chunks, 64, 256).collect()}
    for p, w in got.items():
        assert w == (SEQ[p - 33 : p + 31] if p - 33 >= 0 and p + 31 <= len(SEQ) else None), p


def test_bases_across_chunks(spark, built):
    for size, length in ((7, 20), (256, 3), (5000, 1)):
        v = spark.createDataFrame([("7", p) for p in (0, 1, 6, 7, 8, 255, 256, 257, 2990, 2998, 3000, 3001)] + [("9", 1)], "chromosome string, p long")
        for r in G.with_bases(v, G.chunked(built[0], size, length - 1), "p", length, "b", size).collect():
            ok = r["chromosome"] == "7" and r["p"] >= 1 and r["p"] - 1 + length <= len(SEQ)
            assert r["b"] == (SEQ[r["p"] - 1 : r["p"] - 1 + length] if ok else None), (size, r["p"])


def test_catalog_on_small_chunks(spark, files, built, monkeypatch):
    monkeypatch.setattr(catalog, "CHUNK", 64)
    genome, genes, j, v = built
    again = catalog.junctions(catalog.exons(G.read_gtf(spark, str(files / "a.gtf.gz")), genes), genome)
    assert sorted(map(str, again.collect())) == sorted(map(str, j.collect()))
    w = catalog.annotated_variants(G.read_vcf(spark, str(files / "v.vcf.gz")), genes, again, genome)
    assert sorted(map(str, w.collect())) == sorted(map(str, v.collect()))


def test_plan_score_and_summary(spark, built):
    _, _, _, v = built
    e = v.filter(catalog.eligible())
    plan = screen.run_plan(e, e.filter("abs(offset_in_transcript) <= 20"), e.filter("site_category = 'canonical_intronic'"), ["id"], 64, retain=1)
    rows = {r["id"]: r for r in plan.collect()}
    assert {k: r["screen_group"] for k, r in rows.items()} == {"v1": "splice_dinucleotide", "v2": "other_snv", "v3": "splice_nearby_20bp"}
    assert [k for k, r in rows.items() if r["retain_raw"]] == ["v1"]
    pairs = spark.createDataFrame([(1, "ACGTACGT", "ACGAACGT"), (2, "ACGTACGT", "ACGCACGT")], "k long, r string, a string")
    fx = {r["k"]: r for r in scorer.allele_effects(pairs, "r", "a", ["k"]).collect()}
    assert fx[1]["ref_score"] == fx[2]["ref_score"] and fx[1]["delta_score"] == pytest.approx(fx[1]["alt_score"] - fx[1]["ref_score"])
    series = spark.createDataFrame([("x", "g", [float(i) for i in range(100)], c) for c in (-1, 19, 20, 79, 80, 100)], "run_id string, screen_group string, relative_l2 array<double>, site_index int")
    got = {r["site_index"]: r["nearest_site_mean_relative_l2"] for r in screen.summarise_variant(series, 50).collect()}
    assert got == {-1: None, 19: None, 20: 20.0, 79: 79.0, 80: None, 100: None}
    s = screen.group_summary({"d1": screen.summarise_variant(series, 50)}, "screen_group", ["nearest_site_mean_relative_l2"]).collect()
    assert s[0]["n"] == 2 and s[0]["median"] == 49.5


def test_csv_and_stores(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes("﻿id,flag,x\r\na,True,1.5\r\nb,False,\r\n".encode())
    rows = T.read_csv(spark, str(tmp_path / "t.csv"), "id string, flag string, x double", ["id", "flag", "x"]).withColumn("flag", T.truth(F.col("flag"))).collect()
    assert [tuple(r) for r in rows] == [("a", True, 1.5), ("b", False, None)]
    a, b = spark.createDataFrame([(1, 2)], "p int, q int"), spark.createDataFrame([(3, 4)], "q int, z int")
    assert K.write_csv_union([a, b], str(tmp_path / "u")) == ["p", "q", "z"]
    df = spark.range(10).withColumn("v", F.col("id") % 3)
    K.write_many(df, {"all": (F.lit(True), ["id"]), "threes": (F.col("v") == 0, ["id"])}, str(tmp_path / "many"))
    assert K.read_output(spark, str(tmp_path / "many"), "threes", ["id"]).count() == 4 and K.read_output(spark, str(tmp_path / "many"), "all", ["id"]).count() == 10
    store = K.RunStore(spark, str(tmp_path / "store"))
    plan = spark.createDataFrame([(str(i), i) for i in range(5)], "run_id string, x int")
    store.commit(plan.filter("x < 3"), F.col("x") != 1, "f1")
    assert sorted(r["run_id"] for r in store.pending(plan, "f1").collect()) == ["1", "3", "4"] and store.pending(plan, "f2").count() == 5
    assert store.quarantined().count() == 1 and store.results("f1").count() == 2
    K.write_fasta(spark.createDataFrame([("a", "ACGT")], "n string, s string"), str(tmp_path / "fa"), "n", "s")
    assert G.read_fasta(spark, str(tmp_path / "fa")).collect()[0]["sequence"] == "ACGT"
    K.write_staged(df, str(tmp_path / "staged"))
    K.write_staged(df.limit(3), str(tmp_path / "staged"))
    assert spark.read.parquet(str(tmp_path / "staged")).count() == 3 and not (tmp_path / "staged.old").exists() and not (tmp_path / "staged.partial").exists()
    (tmp_path / "staged").rename(tmp_path / "staged.old")  # as a crash between the renames leaves it
    K.write_staged(df.limit(4), str(tmp_path / "staged"))
    assert spark.read.parquet(str(tmp_path / "staged")).count() == 4 and not (tmp_path / "staged.old").exists()
    listed = T.list_files(spark, str(tmp_path / "fa"), "part-*", content=True).collect()
    assert listed and all(len(r["sha256"]) == 64 for r in listed)
    ticks = iter([False, False, True])
    assert T.wait_until(lambda: next(ticks), 1, sleep=lambda s: None)


def test_marker_stream(spark, tmp_path):
    d = tmp_path / "markers"
    d.mkdir()
    (d / "1.json").write_text('{"run": "a", "status": "complete", "completed": 5, "planned": 5}\n{"run": "b", "status": "running", "completed": 1, "planned": 9}')
    seen = []
    assert not markers.when_complete(spark, str(d), str(tmp_path / "cp"), ["a", "b"], lambda df: seen.append(df.count()))
    (d / "2.json").write_text('{"run": "b", "status": "complete", "completed": 9, "planned": 9}')
    assert markers.when_complete(spark, str(d), str(tmp_path / "cp"), ["a", "b"], lambda df: seen.append(df.count())) and seen == [2]


def test_progress_survives_restarts_and_disorder(spark, tmp_path):
    """Late, repeated and shuffled markers in files that come between restarts give what one batch gives."""
    r = np.random.default_rng(3)
    rows = [(run, s, float(r.integers(1, 9)), plan) for run, n, plan in (("a", 250, 250), ("b", 130, 400), ("c", 3, None)) for s in range(n)]
    rows += [("a", 200, 50.0, 250), ("b", None, 1.0, 400), (None, 0, None, 2)] + rows[::7]
    order = r.permutation(len(rows)).tolist()
    d, out, cp = tmp_path / "steps", str(tmp_path / "out"), str(tmp_path / "cp")
    d.mkdir()
    for part in range(4):
        lines = [json.dumps(dict(zip(("run", "step", "seconds", "planned"), rows[i]))) for i in order[part::4]]
        (d / f"{part}.json").write_text("\n".join(lines))
        if part % 2:  # the stream ends after two files and is taken up again
            progress.keep_progress(progress.progress_stream(spark.readStream.schema(progress.STEP).option("maxFilesPerTrigger", 1).json(str(d)), patience=0.001), out, cp)
    want = {x["run"]: x for x in progress.batch_progress(spark.read.schema(progress.STEP).json(str(d))).collect()}
    got = {x["run"]: x for x in progress.latest_progress(spark, out).collect()}
    assert set(got) == set(want) == {"a", "b", "c", None} and want["a"]["complete"]
    for run, w in want.items():
        assert [got[run][c] for c in ("completed", "planned", "mean_seconds", "remaining_seconds")] == [pytest.approx(w[c]) if w[c] is not None else None for c in ("completed", "planned", "mean_seconds", "remaining_seconds")]
        assert (got[run]["status"] == "complete") == w["complete"]
    # once only one run reports, the others' timers go off
    for name, step in (("5.json", 130), ("6.json", 131), ("7.json", 131)):
        (d / name).write_text(json.dumps({"run": "b", "step": step, "seconds": 1.0, "planned": 400}))
        progress.keep_progress(progress.progress_stream(spark.readStream.schema(progress.STEP).json(str(d)), patience=0.001), out, cp)
    status = {x["run"]: (x["status"], x["completed"]) for x in progress.latest_progress(spark, out).collect()}
    assert status == {"a": ("complete", 250), "b": ("running", 132), "c": ("stalled", 3), None: ("stalled", 1)}


class Counting:
    """Two layers over a sequence's code points, in blocks of five, that remember how many vectors were alive at once."""

    def layers(self, sequence):
        codes = np.array([ord(c) for c in sequence], float)
        for layer, power in (("low", 1), ("high", 2)):
            for a in range(0, len(codes), 5):
                yield layer, a, np.stack([codes[a : a + 5] ** power, np.ones(len(codes[a : a + 5]))], axis=1)


def test_pooled_layers_equal_whole_arrays(spark):
    texts = {1: "abcdefghijklmnopq", 2: "xy", 3: "", 4: None}
    asked = [("head", 0, 4), ("middle", 3, 13), ("one", 1, 2), ("none", 2, 2), ("beyond", 1, 99)]
    df = spark.createDataFrame([(k, v, asked) for k, v in texts.items()], "id long, seq string, regions array<struct<region string, start long, end long>>")
    got = {(x["id"], x["layer"], x["region"]): x["mean"] for x in layers.pooled_layers(df, ["id"], "seq", "regions", Counting, rows=3).collect()}
    assert {k[0] for k in got} == {1, 2} and len(got) == 20
    whole = {}
    for x in layers.layer_blocks(df, ["id"], "seq", Counting).collect():
        whole.setdefault((x["id"], x["layer"]), {}).update({x["start"] + i: v for i, v in enumerate(x["vectors"])})
    for (k, layer, region), mean in got.items():
        _, a, b = next(x for x in asked if x[0] == region)
        vectors = [whole[k, layer][i] for i in range(a, b) if i in whole[k, layer]]
        assert mean is None if len(vectors) < b - a or a == b else np.allclose(mean, np.mean(vectors, axis=0))


def test_a_cluster_needs_a_shared_folder(spark):
    from helixframe.session import scratch

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="yarn")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch(SimpleNamespace(conf={}, sparkContext=context), "x")
    assert scratch(spark, "x") != scratch(spark, "x")


def test_fasta_chunks_over_split_borders(spark, tmp_path):
    r = np.random.default_rng(5)
    made = {f"s{i}": "".join(r.choice(list("ACGTn"), int(n))) for i, n in enumerate([0, 1, 59, 60, 61, 5000, 700, 100, 99])}
    text = "".join(f">{k} about {k}\r\n" + "".join(v[i : i + 60] + ("\r\n" if i % 120 else "\n\n") for i in range(0, len(v), 60)) for k, v in made.items())
    (tmp_path / "g.fa").write_bytes(text.encode())
    for split in ("40b", "333b", "1g"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            for overlap in (0, 30, 150):
                got = {(x["name"], x["chunk"]): (x["start_1based"], x["bases"]) for x in G.fasta_chunks(spark, str(tmp_path / "g.fa"), 100, overlap).collect()}
                want = {(k, i // 100): (i + 1, v.upper()[i : i + 100 + overlap]) for k, v in made.items() for i in range(0, len(v), 100)}
                assert got == want, (split, overlap)
                if split != "333b":
                    break
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def blocked_gzip(text, size):
    out = b""
    for i in range(0, len(text) + 1, size):
        part = text[i : i + size]
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(part) + c.flush()
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHH", 6, b"BC", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def test_blocked_gzip_is_read_by_many_tasks(spark, tmp_path):
    lines = ["##fileDate=2024-01-01", "#CHROM\tPOS", *(f"7\t{i}\tv{i}\tA\tC,G\t.\t.\tGENEINFO=A:{i}" + "x" * (i % 90) for i in range(1, 200)), "", "7\t900\tlast\tA\tT\t.\t.\tX"]
    for size in (40, 1000):
        (tmp_path / "v.vcf.bgz").write_bytes(blocked_gzip("\n".join(lines).encode(), size))
        for part in (400, 1500, 10**9):
            rows = read_blocked_lines(spark, str(tmp_path / "v.vcf.bgz"), part).orderBy("part", "line").collect()
            assert [x["value"] for x in rows] == lines, (size, part)
            assert (len({x["part"] for x in rows}) > 1) == (part < 10**9)
    v = G.read_vcf(spark, str(tmp_path / "v.vcf.bgz")).collect()
    assert len(v) == 199 * 2 + 1 and [x["id"] for x in sorted(v, key=lambda x: (x["row"], x["alt_index"]))][-1] == "last"


def test_commit_log(spark, tmp_path, monkeypatch):
    one, two = (K.RunStore(spark, str(tmp_path / "log")) for _ in range(2))
    rows = lambda a, b, tag: spark.range(a, b).select(F.col("id").cast("string").alias("run_id"), F.lit(tag).alias("tag"))
    assert one.results("f") is None and one.quarantined() is None
    assert one.commit(rows(0, 5, "first"), F.col("run_id") != "3", "f") == 0
    # a crash after the files, before the entry
    monkeypatch.setattr(K.RunStore, "_append", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        two.commit(rows(0, 9, "half"), F.lit(True), "f")
    monkeypatch.undo()
    assert {r["run_id"] for r in one.results("f").collect()} == {"0", "1", "2", "4"} and [r["run_id"] for r in one.quarantined().collect()] == ["3"]
    # a crash while the entry is written leaves a file that waits
    (tmp_path / "log" / "log" / "abc.waiting").write_text("{")
    # another writer takes the number meanwhile
    real, seen = K.rename, []

    def late(*args, **more):
        if not seen:
            seen.append(None)
            seen[0] = two.commit(rows(3, 7, "second"), F.lit(True), "f")
        return real(*args, **more)

    monkeypatch.setattr(K, "rename", late)
    number = one.commit(rows(2, 4, "third"), F.lit(True), "f")
    monkeypatch.undo()
    assert sorted([number, *seen]) == [1, 2]
    tags = {r["run_id"]: r["tag"] for r in one.results("f").collect()}
    third = "second" if seen[0] < number else "third"
    assert tags == {"0": "first", "1": "first", "2": "first", "3": third, "4": "first", "5": "second", "6": "second"}
    assert one.pending(rows(0, 9, "x"), "f").count() == 2 and one.pending(rows(0, 9, "x"), "other").count() == 9
