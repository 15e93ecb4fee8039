"""Schemas of the tables, as DDL, and the closed set of variant types."""

#: Types and columns of call files.
VARIANT_TYPES = ["Reference", "Substitution", "Insertion", "Deletion", "ITD", "Indel"]

KMERS = "sample string, k int, kmer string, count long"
TARGETS = "target string, sequence string, source string"

#: On-disk columns of a call, in order; pvalue .. ci_upper and the coordinates may be null.
CALLS = (
    "sample string, target string, type string, variant_name string, rVAF double, expression double, "
    "min_coverage long, start_kmer_count long, ref_sequence string, alt_sequence string, info string, "
    "chrom string, pos long, ref_allele string, alt_allele string, pvalue double, qual double, "
    "ci_lower double, ci_upper double"
)
CALLS_IN_MEMORY = CALLS + ", path_score long"
CALL_COLUMNS = [x.split()[0] for x in CALLS.split(", ")]

EXPECTED = "chrom string, pos long, ref_allele string, alt_allele string, variant_type string"
TRUTH = EXPECTED + ", true_vaf double, category string"
FILTERED = (
    "sample string, chrom string, pos long, ref_allele string, alt_allele string, variant_type string, "
    "found string, filter_notes string, kmer_vaf double, kmer_min_coverage long, kmer_expression double, "
    "ref_sequence string, variant_sequence string"
)
FILTER_COLUMNS = [x.split()[0] for x in FILTERED.split(", ")]
PON = (
    "chrom string, pos long, ref_allele string, alt_allele string, target string, "
    "sample_count long, frequency double, max_vaf double, mean_vaf double"
)
