"""An extension: k-mer counts kept up to date from a stream of sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import kmers as K


def streaming_counts(sequences: DataFrame, k: int, canonical: bool = False) -> DataFrame:
    """sample, kmer, count over a stream with sample and sequence."""
    rows = sequences.filter(F.length("sequence") >= k).select("sample", F.explode(K.decompose("sequence", k)).alias("kmer")).filter(K.is_dna("kmer"))
    rows = rows.withColumn("kmer", K.canonical("kmer")) if canonical else rows
    return rows.groupBy("sample", "kmer").agg(F.count("*").alias("count"))


def start(counts: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Keeps the counts in a table in memory, for small streams and tests."""
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
