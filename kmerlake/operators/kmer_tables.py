"""Counting, looking up and summarising k-mers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import kmers as K


def target_kmers(targets: DataFrame, k: int) -> DataFrame:
    """target, pos (from 0), kmer of every target of at least k bases."""
    return targets.filter(F.length("sequence") >= k).select("target", F.posexplode(K.decompose("sequence", k)).alias("pos", "kmer"))


def count_kmers(sequences: DataFrame, k: int, by: list[str] = ("sample",), canonical: bool = False, min_count: int = 1) -> DataFrame:
    """by, k, kmer, count over a `sequence` column; k-mers with other letters than ACGT do not count."""
    rows = sequences.filter(F.length("sequence") >= k).select(*by, F.explode(K.decompose("sequence", k)).alias("kmer")).filter(K.is_dna("kmer"))
    if canonical:
        rows = rows.withColumn("kmer", K.canonical("kmer"))
    out = rows.groupBy(*by, "kmer").agg(F.count("*").alias("count"))
    out = out.filter(F.col("count") >= min_count) if min_count > 1 else out
    return out.select(*by, F.lit(k).alias("k"), "kmer", "count")


def strand_specific(kmers: DataFrame) -> DataFrame:
    """A canonical table with the other strand's k-mers added, so that equality finds both."""
    other = kmers.withColumn("kmer", K.reverse_complement("kmer"))
    return kmers.unionByName(other.join(kmers, [c for c in kmers.columns if c != "count"], "left_anti"))


def lookup(queries: DataFrame, kmers: DataFrame, on: list[str] = ("kmer",)) -> DataFrame:
    """queries with `count`; a k-mer that is not in the table counts 0."""
    return queries.join(kmers.select(*on, "count"), list(on), "left").withColumn("count", F.coalesce("count", F.lit(0)).cast("long"))


def kmer_length(kmers: DataFrame, given: int | None = None) -> int:
    """The given length, or that of the table's k-mers; an error if the table is empty."""
    if given:
        return given
    row = kmers.select(F.length("kmer")).first()
    if row is None:
        raise ValueError("no k-mers: give the k-mer length")
    return row[0]


def coverage_stats(targets: DataFrame, kmers: DataFrame, k: int, by: list[str] = ()) -> DataFrame:
    """Count, mean, median, least, largest, population deviation and variation of k-mer counts, for each target.

    by names columns of the k-mer table (such as sample) that coverage is told apart by.
    Targets shorter than k are left out.
    """
    own = target_kmers(targets, k)
    if by:
        own = own.join(kmers.select(*by).distinct(), F.lit(True))  # every group is asked for every target
    counted = lookup(own, kmers, [*by, "kmer"])
    mean, deviation = F.avg("count"), F.stddev_pop("count")
    return counted.groupBy(*by, "target").agg(
        F.count("*").alias("num_kmers"),
        mean.alias("mean_coverage"),
        F.percentile("count", F.lit(0.5)).alias("median_coverage"),
        F.min("count").alias("min_coverage"),
        F.max("count").alias("max_coverage"),
        deviation.alias("stdev"),
        F.when(mean == 0, F.lit(0.0)).otherwise(deviation / mean).alias("cv"),
    )


def every_nth(rows: DataFrame, by: list[str], order: list[str], take: int) -> DataFrame:
    """At most `take` rows of each group, evenly spaced: every n-th with n = size // take, 1 at least."""
    size = F.count("*").over(Window.partitionBy(*by))
    step = F.greatest(F.floor(size / take), F.lit(1))
    numbered = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).withColumn("_step", step)
    return numbered.filter((F.col("_n") % F.col("_step") == 0) & (F.col("_n") / F.col("_step") < take)).drop("_n", "_step")
