"""The library's tables made from the general test tables, in expressions that SQL has too.

documents and benchmark items give DNA (the letters A, C, G, T of a whole text) for reads
and targets, lineitem gives calls, part gives truth and expected variants.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

K = 5
#: Walks need k-mers that are rare enough to lead somewhere.
WALK_K = 13


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """target (doc_id), sample (source), sequence."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("target"), F.col("source").alias("sample"), F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("sequence"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """target, sequence of the benchmark items' DNA, which documents hold pieces of."""
    items = table(spark, sf_dir, "benchmark")
    own = items.select(F.concat(F.lit("B"), F.col("item_id").cast("string")).alias("target"), F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("sequence"))
    return own.filter(F.length("sequence") >= WALK_K)


def base(x) -> F.Column:
    return F.substring(F.lit("ACGT"), (x % 4 + 1).cast("int"), F.lit(1))


def calls(spark: SparkSession, sf_dir: str, distinct: bool = True) -> DataFrame:
    """Distinct calls, or all where repeated ones do not count; alleles are one to three bases, positions collide often."""
    t = table(spark, sf_dir, "lineitem")
    start = F.col("l_partkey") % 200
    kinds = F.array(*[F.lit(x) for x in ("Substitution", "Insertion", "Deletion", "ITD", "Indel", "Reference", "Substitution")])
    b = lambda d: base(F.floor(F.col("l_partkey") / d))
    out = t.select(
        F.concat(F.lit("S"), (F.col("l_suppkey") % 10).cast("string")).alias("sample"),
        F.concat(F.lit("T"), (F.col("l_partkey") % 50).cast("string")).alias("target"),
        F.element_at(kinds, F.col("l_linenumber").cast("int")).alias("type"),
        F.col("l_discount").alias("rVAF"),
        F.col("l_quantity").alias("expression"),
        F.col("l_quantity").cast("long").alias("min_coverage"),
        F.concat(F.lit("chr"), (F.col("l_partkey") % 22 + 1).cast("string")).alias("chrom"),
        start.cast("long").alias("pos"),
        F.when(F.col("l_linenumber") == 2, b(1)).when(F.col("l_linenumber") == 3, F.concat(b(1), b(3), b(5))).when(F.col("l_linenumber") == 5, F.concat(b(1), b(3))).otherwise(b(1)).alias("ref_allele"),
        F.when(F.col("l_linenumber") == 2, F.concat(b(1), b(2))).when(F.col("l_linenumber") == 3, b(1)).when(F.col("l_linenumber") == 5, F.concat(b(1), b(2), b(7))).otherwise(b(2)).alias("alt_allele"),
        F.concat(b(1), b(2), b(3), b(5), b(7), b(11), b(13), b(17), b(19), b(23), b(29), b(31)).alias("ref_sequence"),
        F.when(F.col("l_tax") > 0.04, F.col("l_tax")).alias("pvalue"),
        F.when(F.col("l_tax") > 0.02, F.col("l_tax") * 1000).alias("qual"),
    )
    out = out.distinct() if distinct else out
    name = F.concat(F.col("pos").cast("string"), F.lit(":"), "ref_allele", F.lit("/"), "alt_allele", F.lit(":"), (F.col("pos") + F.length("ref_allele")).cast("string"))
    return out.withColumn("variant_name", F.when(F.col("type") == "Reference", F.lit("")).otherwise(name)).withColumn("alt_sequence", F.concat("ref_sequence", "alt_allele"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom, pos, ref_allele, alt_allele, variant_type, true_vaf, one row for each part."""
    t = table(spark, sf_dir, "part")
    kinds = F.array(*[F.lit(x) for x in ("Substitution", "Insertion", "Deletion", "Indel")])
    b = lambda d: base(F.floor(F.col("p_partkey") / d))
    which = F.col("p_partkey") % 4
    return t.select(
        (F.col("p_partkey") % 22 + 1).cast("string").alias("chrom"),
        (F.col("p_partkey") % 200).cast("long").alias("pos"),
        F.when(which == 2, F.concat(b(1), b(3), b(5))).when(which == 3, F.concat(b(1), b(3))).otherwise(b(1)).alias("ref_allele"),
        F.when(which == 1, F.concat(b(1), b(2))).when(which == 2, b(1)).when(which == 3, F.concat(b(1), b(2), b(7))).otherwise(b(2)).alias("alt_allele"),
        F.element_at(kinds, (which + 1).cast("int")).alias("variant_type"),
        ((F.col("p_size") % 11) / F.lit(100.0)).alias("true_vaf"),
    )


_B = lambda key, d: f"substr('ACGT', ((({key} // {d}) % 4) + 1)::INTEGER, 1)"


def _b(key: str, *ds: int) -> str:
    return " || ".join(_B(key, d) for d in ds)


DNA_SQL = "dna AS (SELECT doc_id AS target, source AS sample, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS sequence FROM documents)"
TARGETS_SQL = f"""{DNA_SQL}, targets AS (SELECT * FROM (SELECT 'B' || item_id::VARCHAR AS target, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS sequence FROM benchmark) WHERE length(sequence) >= {WALK_K})"""
_L = "l_partkey"
CALLS_SQL = f"""raw AS (SELECT DISTINCT
    'S' || (l_suppkey % 10)::VARCHAR AS sample, 'T' || (l_partkey % 50)::VARCHAR AS target,
    (['Substitution', 'Insertion', 'Deletion', 'ITD', 'Indel', 'Reference', 'Substitution'])[l_linenumber] AS type,
    l_discount AS "rVAF", l_quantity AS expression, floor(l_quantity)::BIGINT AS min_coverage,
    'chr' || (l_partkey % 22 + 1)::VARCHAR AS chrom, (l_partkey % 200)::BIGINT AS pos,
    CASE l_linenumber WHEN 2 THEN {_b(_L, 1)} WHEN 3 THEN {_b(_L, 1, 3, 5)} WHEN 5 THEN {_b(_L, 1, 3)} ELSE {_b(_L, 1)} END AS ref_allele,
    CASE l_linenumber WHEN 2 THEN {_b(_L, 1, 2)} WHEN 3 THEN {_b(_L, 1)} WHEN 5 THEN {_b(_L, 1, 2, 7)} ELSE {_b(_L, 2)} END AS alt_allele,
    {_b(_L, 1, 2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31)} AS ref_sequence,
    CASE WHEN l_tax > CAST(0.04 AS DOUBLE) THEN l_tax END AS pvalue, CASE WHEN l_tax > CAST(0.02 AS DOUBLE) THEN l_tax * 1000 END AS qual
    FROM lineitem),
calls AS (SELECT *, CASE WHEN type = 'Reference' THEN '' ELSE pos::VARCHAR || ':' || ref_allele || '/' || alt_allele || ':' || (pos + length(ref_allele))::VARCHAR END AS variant_name,
    ref_sequence || alt_allele AS alt_sequence FROM raw)"""
_P = "p_partkey"
TRUTH_SQL = f"""truth AS (SELECT (p_partkey % 22 + 1)::VARCHAR AS chrom, (p_partkey % 200)::BIGINT AS pos,
    CASE p_partkey % 4 WHEN 2 THEN {_b(_P, 1, 3, 5)} WHEN 3 THEN {_b(_P, 1, 3)} ELSE {_b(_P, 1)} END AS ref_allele,
    CASE p_partkey % 4 WHEN 1 THEN {_b(_P, 1, 2)} WHEN 2 THEN {_b(_P, 1)} WHEN 3 THEN {_b(_P, 1, 2, 7)} ELSE {_b(_P, 2)} END AS alt_allele,
    (['Substitution', 'Insertion', 'Deletion', 'Indel'])[p_partkey % 4 + 1] AS variant_type, (p_size % 11) / CAST(100 AS DOUBLE) AS true_vaf
    FROM part)"""
