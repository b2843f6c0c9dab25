"""VCF, GTF and FASTA text as DataFrames.

Plain text is read in splits. ``fasta_chunks`` puts lines of a genome together over split
borders, so neither a file nor a sequence is one task's. Gzip text is read by one task for
each file, unless it is in blocks (``sources.blocked``). A file's line order is kept as
``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.session import written
from helixframe.sources.blocked import BLOCKED, read_blocked_lines


def _lines(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(BLOCKED):
        return read_blocked_lines(spark, path).withColumn("row", F.shiftleft("part", 33) + F.col("line")).select("value", "row")
    return spark.read.text(path).withColumn("row", F.monotonically_increasing_id())


def bare_chromosome(c: Column) -> Column:
    """The name without its ``chr`` prefix."""
    return F.regexp_replace(c, "^chr", "")


def info_map(info: Column) -> Column:
    """INFO as a map: a flag has the value 'true', a repeated key its last value."""
    parts = F.filter(F.split(info, ";"), lambda p: (p != "") & (p != "."))
    entry = lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise("true").alias("value"))
    entries = F.transform(parts, entry)
    later = lambda e, i: F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"])
    return F.map_from_entries(F.filter(entries, lambda e, i: ~later(e, i)))


def read_vcf(spark: SparkSession, path: str, chromosomes: list[str] | None = None) -> DataFrame:
    """One row for each ALT allele: (chromosome, position_1based, id, ref, alt, qual, filter, info, row, alt_index).

    Rows of other chromosomes drop out before INFO is parsed.
    """
    f = F.split("value", "\t")
    rows = _lines(spark, path).filter(~F.col("value").startswith("#") & (F.col("value") != ""))
    cut = rows.select(bare_chromosome(F.get(f, F.lit(0))).alias("chromosome"), f.alias("f"), "row")
    if chromosomes:
        cut = cut.filter(F.col("chromosome").isin([c.removeprefix("chr") for c in chromosomes]))
    field = lambda i: F.get("f", F.lit(i))
    one = cut.select(
        "chromosome", field(1).cast("long").alias("position_1based"), field(2).alias("id"), field(3).alias("ref"), F.split(field(4), ",").alias("alts"),
        field(5).alias("qual"), field(6).alias("filter"), info_map(field(7)).alias("info"), "row",
    )
    return one.select("*", F.posexplode("alts").alias("alt_index", "alt")).select("chromosome", "position_1based", "id", "ref", "alt", "qual", "filter", "info", "row", "alt_index")


def vcf_headers(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of the ``##key=value`` lines."""
    rows = spark.read.text(path).filter(F.col("value").startswith("##") & F.contains("value", F.lit("=")))
    return rows.select(F.regexp_extract("value", "^##([^=]+)=", 1).alias("key"), F.regexp_extract("value", "^##[^=]+=(.*)$", 1).alias("value"))


def gtf_attribute(attributes: Column, name: str) -> Column:
    """The first value of a GTF attribute, NULL if it isn't there."""
    found = F.regexp_extract(attributes, rf'(?:^|;\s*){name} "([^"]*)"', 1)
    return F.when(attributes.rlike(rf'(?:^|;\s*){name} "'), found)


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """(chromosome, feature, start_1based, end_1based, strand, gene, transcript, exon_number, tags, attributes)."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.size(f) >= 9)).select(f.alias("f"))
    a = F.get("f", F.lit(8))
    tags = F.transform(F.regexp_extract_all(a, F.lit(r'tag "([^"]*)"'), F.lit(1)), lambda t: t)
    return rows.select(
        bare_chromosome(F.get("f", F.lit(0))).alias("chromosome"), F.get("f", F.lit(2)).alias("feature"), F.get("f", F.lit(3)).cast("long").alias("start_1based"), F.get("f", F.lit(4)).cast("long").alias("end_1based"),
        F.get("f", F.lit(6)).alias("strand"), F.coalesce(gtf_attribute(a, "gene_name"), gtf_attribute(a, "gene"), gtf_attribute(a, "gene_id")).alias("gene"), gtf_attribute(a, "transcript_id").alias("transcript"),
        gtf_attribute(a, "exon_number").cast("int").alias("exon_number"), tags.alias("tags"), a.alias("attributes"),
    )


def read_fasta(spark: SparkSession, path: str, upper: bool = True) -> DataFrame:
    """(name, description, sequence): one row for each record, its lines joined."""
    record = spark.read.option("lineSep", ">").text(path).filter(F.trim("value") != "")
    head = F.regexp_replace(F.substring_index("value", "\n", 1), r"\r$", "")
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s+", "")
    out = record.select(F.substring_index(head, " ", 1).alias("name"), head.alias("description"), body.alias("sequence"))
    return out.withColumn("sequence", F.upper("sequence")) if upper else out


def chunked(sequences: DataFrame, size: int = 1 << 16, overlap: int = 0) -> DataFrame:
    """(name, chunk, start_1based, bases): long sequences as pieces that a join by chunk can reach.

    A sequence is cut in one pass; each piece goes on for ``overlap`` bases of the next ones.
    """
    cut = sequences.select("name", F.regexp_extract_all("sequence", F.lit(f"(?s).{{1,{size}}}"), F.lit(0)).alias("cut"))
    ahead = -(-overlap // size)
    tail = lambda i: F.substring(F.array_join(F.slice("cut", i + 2, F.lit(ahead)), ""), 1, overlap)
    parts = F.transform("cut", lambda c, i: F.concat(c, tail(i)) if overlap else c)
    rows = cut.select("name", F.posexplode(parts).alias("chunk", "bases"))
    return rows.select("name", "chunk", (F.col("chunk").cast("long") * size + 1).alias("start_1based"), "bases")


def fasta_chunks(spark: SparkSession, path: str, size: int = 1 << 16, overlap: int = 0, upper: bool = True) -> DataFrame:
    """(name, chunk, start_1based, bases) as ``chunked`` gives them, straight from the file's splits.

    A line's sequence and offset follow from its split: what the split's own headers say,
    or else what the nearest earlier split with a header carries on, one row for each
    split. A task holds the lines of a split or the pieces of a chunk, never a sequence.
    Names must be unique; a sequence without bases has no chunks.
    """
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))
    head, bare = F.col("value").startswith(">"), F.regexp_replace("value", r"\s+", "")
    lines = text.select("file", "split", "line", head.alias("head"), F.when(head, F.substring_index(F.regexp_replace(F.substring("value", 2, 1 << 30), r"\r$", ""), " ", 1)).otherwise(F.upper(bare) if upper else bare).alias("text"))
    lines = lines.filter("head or text <> ''")
    here = Window.partitionBy("file", "split").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    length = F.when(F.col("head"), 0).otherwise(F.length("text")).cast("long")
    lines = written(lines.withColumn("length", length).withColumn("record", F.count_if(F.col("head")).over(here)).withColumn("name", F.last(F.when(F.col("head"), F.col("text")), True).over(here)), "lines")
    # one row for each split: its last name, the bases after it, and those before its first header
    last = lines.groupBy("file", "split", "record").agg(F.first("name").alias("name"), F.sum("length").alias("n")).groupBy("file", "split").agg(
        F.max_by("name", "record").alias("name"), F.max("record").alias("records"), F.max_by("n", "record").alias("after"), F.sum(F.when(F.col("record") == 0, F.col("n")).otherwise(0)).alias("before")
    )
    earlier = Window.partitionBy("file").orderBy("split")
    named = last.withColumn("run", F.count_if(F.col("records") > 0).over(earlier))
    inside = Window.partitionBy("file", "run").orderBy("split").rowsBetween(Window.unboundedPreceding, 0)
    reached = named.withColumn("reached", F.sum("after").over(inside)).withColumn("carried", F.last("name", True).over(inside))
    carry = reached.select("file", "split", F.lag("reached").over(earlier).alias("base"), F.lag("carried").over(earlier).alias("carried"))
    at = Window.partitionBy("file", "split", "record").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.withColumn("offset", F.coalesce(F.sum("length").over(at), F.lit(0))).filter("not head").join(carry, ["file", "split"])
    placed = placed.select(F.coalesce("name", "carried").alias("name"), (F.col("offset") + F.when(F.col("record") == 0, F.coalesce("base", F.lit(0))).otherwise(0)).alias("offset"), "text", "length")
    first = F.greatest(F.floor((F.col("offset") - overlap) / size), F.lit(0))
    chunks = F.explode(F.sequence(first, F.floor((F.col("offset") + F.col("length") - 1) / size))).alias("chunk")
    pieces = placed.select("name", "offset", "text", "length", chunks)
    start, end = F.col("chunk") * size, F.col("chunk") * size + size + overlap
    cut = F.greatest(start - F.col("offset"), F.lit(0))
    pieces = pieces.select("name", "chunk", (F.col("offset") + cut).alias("from"), F.substring("text", (cut + 1).cast("int"), (F.least(end - F.col("offset"), F.col("length")) - cut).cast("int")).alias("piece"))
    held = pieces.filter("piece <> ''").groupBy("name", "chunk").agg(F.array_sort(F.collect_list(F.struct("from", "piece"))).alias("_s"))
    # a piece that begins past the chunk's own bases is overlap only
    held = held.filter(F.col("_s")[0]["from"] < (F.col("chunk") + 1) * size)
    return held.select("name", F.col("chunk").cast("int").alias("chunk"), (F.col("chunk") * size + 1).alias("start_1based"), F.array_join("_s.piece", "").alias("bases"))


def with_bases(df: DataFrame, chunks: DataFrame, position: str, length: Column | int, into: str, size: int = 1 << 16) -> DataFrame:
    """``df`` (chromosome, ...) with ``length`` bases from a 1-based position; NULL where they run off an end or the chromosome is unknown.

    ``chunks`` of ``size`` must overlap by the greatest length less one. The join is by
    (chromosome, chunk): no row carries a chromosome.
    """
    c = chunks.select(bare_chromosome(F.col("name")).alias("_chromosome"), F.col("chunk").alias("_chunk"), F.col("start_1based").alias("_from"), F.col("bases").alias("_bases"))
    n = F.lit(length) if isinstance(length, int) else length
    out = df.withColumn("_at", F.floor((F.col(position) - 1) / size).cast("int"))
    out = out.join(c, (F.col("chromosome") == F.col("_chromosome")) & (F.col("_at") == F.col("_chunk")), "left")
    got = F.substring("_bases", (F.col(position) - F.col("_from") + 1).cast("int"), n)
    return out.withColumn(into, F.when((F.col(position) >= 1) & (F.length(got) == n), got)).drop("_at", "_chromosome", "_chunk", "_from", "_bases")


def with_windows(variants: DataFrame, chunks: DataFrame, length: int, size: int = 1 << 16) -> DataFrame:
    """Variants with ``window``: ``length`` bases centred on the position, from chunks that overlap by ``length``.

    The join is by (chromosome, chunk): no task holds a chromosome. Windows that run off
    an end are NULL.
    """
    start = F.col("position_1based") - length // 2
    v = variants.withColumn("_start", start).withColumn("_chunk", F.floor((F.greatest(F.col("_start"), F.lit(1)) - 1) / size).cast("int"))
    c = chunks.select(bare_chromosome(F.col("name")).alias("chromosome"), F.col("chunk").alias("_chunk"), F.col("start_1based").alias("_at"), "bases")
    cut = F.substring("bases", (F.col("_start") - F.col("_at") + 1).cast("int"), F.lit(length))
    out = v.join(c, ["chromosome", "_chunk"], "left").withColumn("window", F.when((F.col("_start") >= 1) & (F.length(cut) == length), cut))
    return out.drop("_start", "_chunk", "_at", "bases")
