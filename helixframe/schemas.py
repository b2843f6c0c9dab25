"""Explicit schemas of the domain's tables. Column names carry their coordinate convention."""

from __future__ import annotations

EXONS = "gene string, transcript string, chromosome string, strand string, exon_number int, exon_start_1based long, exon_end_1based long"
GENES = "gene string, gene_id string, chromosome string, strand string, gene_start_1based long, gene_end_1based long, transcript string, transcript_start_1based long, transcript_end_1based long"
JUNCTIONS = (
    "gene string, transcript string, chromosome string, strand string, junction_id string, upstream_exon int, downstream_exon int, intron_start_1based long, intron_end_1based long, "
    "donor_exonic_base_1based long, acceptor_exonic_base_1based long, donor_plus1_1based long, donor_plus2_1based long, acceptor_minus2_1based long, acceptor_minus1_1based long, "
    "donor_dinucleotide string, acceptor_dinucleotide string"
)
VCF = "chromosome string, position_1based long, id string, ref string, alt string, qual string, filter string, info map<string,string>, row long, alt_index int"
OUTCOMES = "cell_line string, run_id string, position_1based long, ref string, alt string, exon int, outcome double"
REGIONS = "run_id string, region string, forward_start_0based int, forward_end_0based_exclusive int, rc_start_0based int, rc_end_0based_exclusive int"
SERIES = ("relative_l2", "rms_difference", "cosine_distance", "max_abs_difference", "changed_dimension_fraction", "reference_l2")
POSITION_METRICS = "run_id string, " + ", ".join(f"{m} array<float>" for m in SERIES)


def names(schema: str) -> list[str]:
    """Column names of a flat schema string."""
    return [part.split()[0] for part in schema.split(", ")]
