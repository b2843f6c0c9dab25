"""From annotation, genome and variant files to a classified catalog with splice-site annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import sequences as S
from helixframe.operators import classify, joins, reshape
from helixframe.sources.genomics import chunked, with_bases

#: Bases of a chunk of the genome.
CHUNK = 1 << 16
VARIANT_KEY = ["chromosome", "position_1based", "ref", "alt"]


def genes(gtf: DataFrame, wanted: list[str], tag: str = "MANE_Select") -> DataFrame:
    """(gene, chromosome, strand, gene span, transcript, transcript span) of the tagged transcript of each gene, in one aggregation."""
    g = gtf.filter(F.col("gene").isin(wanted))
    tagged = F.array_contains(F.transform("tags", lambda t: F.translate(t, " ", "_")), tag)
    is_gene, is_tx = F.col("feature") == "gene", (F.col("feature") == "transcript") & tagged
    return g.groupBy("gene", "chromosome", "strand").agg(
        F.max(F.when(is_gene, F.col("start_1based"))).alias("gene_start_1based"), F.max(F.when(is_gene, F.col("end_1based"))).alias("gene_end_1based"),
        F.max(F.when(is_tx, F.col("transcript"))).alias("transcript"), F.max(F.when(is_tx, F.col("start_1based"))).alias("transcript_start_1based"), F.max(F.when(is_tx, F.col("end_1based"))).alias("transcript_end_1based"),
    )


def exons(gtf: DataFrame, gene_table: DataFrame) -> DataFrame:
    e = gtf.filter("feature = 'exon'").select("gene", "transcript", "exon_number", F.col("start_1based").alias("exon_start_1based"), F.col("end_1based").alias("exon_end_1based"))
    return gene_table.select("gene", "transcript", "chromosome", "strand").join(e, ["gene", "transcript"])


def junctions(exon_table: DataFrame, genome: DataFrame) -> DataFrame:
    """Each exon with its successor in transcript order: the intron between, its boundary bases and dinucleotides.

    ``genome`` has (name, sequence) for the chromosomes; bases come from its chunks. Raises
    where exons aren't in transcript order.
    """
    pairs = joins.adjacent(exon_table, ["gene", "transcript", "chromosome", "strand"], [F.col("exon_number")], ["exon_number", "exon_start_1based", "exon_end_1based"])
    plus = F.col("strand") == "+"
    start = F.when(plus, F.col("exon_end_1based")).otherwise(F.col("next_exon_end_1based")) + 1
    end = F.when(plus, F.col("next_exon_start_1based")).otherwise(F.col("exon_start_1based")) - 1
    j = pairs.select(
        "gene", "transcript", "chromosome", "strand", F.concat(F.col("gene"), F.lit("_J"), F.lpad(F.col("exon_number").cast("string"), 2, "0")).alias("junction_id"),
        F.col("exon_number").alias("upstream_exon"), F.col("next_exon_number").alias("downstream_exon"), start.alias("intron_start_1based"), end.alias("intron_end_1based"),
    ).filter(F.coalesce(F.assert_true(end >= start, F.lit("exons out of order")).cast("boolean"), F.lit(True)))
    first, last, sign = F.col("intron_start_1based"), F.col("intron_end_1based"), F.when(plus, 1).otherwise(-1)
    donor, acceptor = F.when(plus, first - 1).otherwise(last + 1), F.when(plus, last + 1).otherwise(first - 1)
    j = j.withColumns({"donor_exonic_base_1based": donor, "acceptor_exonic_base_1based": acceptor})
    d, a = F.col("donor_exonic_base_1based"), F.col("acceptor_exonic_base_1based")
    j = j.withColumns({"donor_plus1_1based": d + sign, "donor_plus2_1based": d + 2 * sign, "acceptor_minus2_1based": a - 2 * sign, "acceptor_minus1_1based": a - sign})
    j = j.withColumns({"_d": F.least("donor_plus1_1based", "donor_plus2_1based"), "_a": F.least("acceptor_minus2_1based", "acceptor_minus1_1based")})
    pieces = chunked(genome, CHUNK, 1)
    for place, name in (("_d", "donor_dinucleotide"), ("_a", "acceptor_dinucleotide")):
        j = with_bases(j, pieces, place, 2, "_two", CHUNK).withColumn(name, F.when(plus, F.col("_two")).otherwise(S.reverse_complement(F.col("_two")))).drop("_two")
    return j.drop("_d", "_a")


def sites(junction_table: DataFrame) -> DataFrame:
    """(gene, chromosome, strand, junction_id, site_type, site_1based): the exonic base on either side of each intron."""
    pair = F.array(F.struct(F.lit("donor").alias("site_type"), F.col("donor_exonic_base_1based").alias("site_1based")), F.struct(F.lit("acceptor").alias("site_type"), F.col("acceptor_exonic_base_1based").alias("site_1based")))
    return junction_table.select("gene", "chromosome", "strand", "junction_id", F.explode(pair).alias("s")).select("gene", "chromosome", "strand", "junction_id", "s.site_type", "s.site_1based")


def signed_offset(position: Column, site: Column, strand: Column) -> Column:
    """Distance in transcript direction."""
    return (position - site) * F.when(strand == "+", 1).otherwise(-1)


def annotated_variants(vcf: DataFrame, gene_table: DataFrame, junction_table: DataFrame, genome: DataFrame, gene_ids: dict[str, int] | None = None) -> DataFrame:
    """Variants that overlap a gene, classified, checked against the reference, with the nearest site of SNVs.

    ``gene_ids`` gives each gene's database id: GENEINFO must then hold exactly GENE:ID,
    else an entry for the gene's symbol is enough.

    Every other class has NULLs for the nearest site; of sites at equal distance the
    first by junction and type counts.
    """
    v = vcf.withColumn("variant_end_1based", F.col("position_1based") + F.length("ref") - 1)
    spans = gene_table.select("chromosome", "gene", "strand", "gene_start_1based", "gene_end_1based", "transcript", "transcript_start_1based", "transcript_end_1based")
    hit = joins.overlap_join(v, spans, ["chromosome"], ("position_1based", "variant_end_1based"), ("gene_start_1based", "gene_end_1based"), 1 << 17)
    longest = hit.agg(F.max(F.length("ref"))).first()[0] or 1
    hit = with_bases(hit, chunked(genome, CHUNK, longest - 1), "position_1based", F.length("ref"), "_there", CHUNK)
    listed = F.coalesce(F.try_element_at("info", F.lit("GENEINFO")), F.lit(""))
    if gene_ids:
        entry = classify.ordered_rules([(F.col("gene") == g, f"{g}:{i}") for g, i in gene_ids.items()], None)
        named_gene = F.coalesce(classify.in_list(listed, entry), F.lit(False))
    else:
        named_gene = F.array_contains(F.transform(F.split(listed, r"\|"), lambda x: F.substring_index(x, ":", 1)), F.col("gene"))
    info = lambda k: F.try_element_at("info", F.lit(k))
    named = hit.select(
        "gene", "chromosome", "strand", "position_1based", "id", "ref", "alt", "row", "alt_index", "transcript",
        classify.variant_class(F.col("ref"), F.col("alt")).alias("variant_class"),
        F.coalesce(F.col("_there") == F.col("ref"), F.lit(False)).alias("ref_matches_genome"),
        named_gene.alias("geneinfo_matches_gene"),
        F.col("position_1based").between(F.col("transcript_start_1based"), F.col("transcript_end_1based")).alias("within_transcript"),
        info("CLNSIG").alias("significance"), info("CLNREVSTAT").alias("review_status"), info("MC").alias("consequence"),
    )
    s = sites(junction_table).select("gene", "site_1based", "junction_id", "site_type")
    snv = named.filter("variant_class = 'SNV'")
    near = joins.nearest_site(snv, s, ["gene"], "position_1based", "site_1based", ["junction_id", "site_type"])
    near = near.withColumn("offset_in_transcript", signed_offset(F.col("position_1based"), F.col("site_1based"), F.col("strand")))
    near = near.withColumn("site_category", classify.site_category(F.col("site_type"), F.col("offset_in_transcript")))
    return near.unionByName(named.filter("variant_class <> 'SNV'"), allowMissingColumns=True)


def eligible() -> Column:
    """An SNV whose reference base and gene agree with the genome and the annotation."""
    return (F.col("variant_class") == "SNV") & F.col("ref_matches_genome") & F.col("geneinfo_matches_gene")


def nearby_sites(variants: DataFrame, junction_table: DataFrame, radius: int = 20) -> DataFrame:
    """One row for each eligible variant and site no farther apart than ``radius``."""
    s = sites(junction_table).select("gene", F.col("site_1based").alias("near_site_1based"), F.col("junction_id").alias("near_junction_id"), F.col("site_type").alias("near_site_type"))
    pairs = joins.radius_join(variants.filter(eligible()), s, ["gene"], "position_1based", "near_site_1based", radius)
    off = signed_offset(F.col("position_1based"), F.col("near_site_1based"), F.col("strand"))
    return pairs.withColumn("near_offset", off).withColumn("near_category", classify.site_category(F.col("near_site_type"), F.col("near_offset")))


def saturation(junction_table: DataFrame, genome: DataFrame, existing: DataFrame, radius: int = 20) -> tuple[DataFrame, DataFrame]:
    """(every single-base change near a site, those of them that ``existing`` lacks)."""
    at = reshape.positions_around(sites(junction_table), "site_1based", radius, "position_1based").select("gene", "chromosome", "strand", "position_1based").distinct()
    based = with_bases(at, chunked(genome, CHUNK), "position_1based", 1, "ref", CHUNK).filter("ref in ('A', 'C', 'G', 'T')")
    every = reshape.alternative_bases(based, "ref")
    every = every.withColumn("synthetic_variant_id", S.variant_key("sat", F.col("position_1based"), F.col("ref"), F.col("alt")))
    return every, every.join(existing.select(*VARIANT_KEY).distinct(), VARIANT_KEY, "left_anti")


def catalog_outputs() -> dict[str, Column]:
    """What each output table of the catalog holds."""
    return {"all": F.lit(True), "experiment_ready": eligible(), "nearby": eligible() & (F.abs("offset_in_transcript") <= 20), "dinucleotide": eligible() & (F.col("site_category") == "canonical_intronic")}
