"""De Bruijn graphs of all targets as relations: edges, dead ends, low counts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import kmers as K
from .local import OTHER_WEIGHT, REFERENCE_WEIGHT, SINK, SOURCE, reachable


def edges(nodes: DataFrame, by: list[str] = ("sample", "target")) -> DataFrame:
    """by, src, dst, is_reference, weight: overlaps of k - 1 bases, no loops."""
    left = nodes.select(*by, F.col("kmer").alias("src"), F.col("is_reference").alias("_a"), K.suffix("kmer").alias("_on"))
    right = nodes.select(*by, F.col("kmer").alias("dst"), F.col("is_reference").alias("_b"), K.prefix("kmer").alias("_on"))
    known = F.col("_a") & F.col("_b")
    return left.join(right, [*by, "_on"]).filter("src <> dst").select(*by, "src", "dst", known.alias("is_reference"), weight(known))


def weight(known) -> F.Column:
    return F.when(known, F.lit(REFERENCE_WEIGHT)).otherwise(F.lit(OTHER_WEIGHT)).alias("weight")


def end_edges(nodes: DataFrame, reference: DataFrame, by: list[str] = ("sample", "target")) -> DataFrame:
    """Edges from the source to the first reference k-mer and its siblings, and from the last one and its siblings to the sink.

    reference: target, pos, kmer.
    """
    ends = reference.groupBy("target").agg(F.min_by("kmer", "pos").alias("_first"), F.max_by("kmer", "pos").alias("_last"))
    joined = nodes.join(ends, "target")
    first = joined.filter(K.prefix("kmer") == K.prefix("_first")).select(*by, F.lit(SOURCE).alias("src"), F.col("kmer").alias("dst"), "is_reference", weight(F.col("is_reference")))
    last = joined.filter(K.suffix("kmer") == K.suffix("_last")).select(*by, F.col("kmer").alias("src"), F.lit(SINK).alias("dst"), "is_reference", weight(F.col("is_reference")))
    return first.union(last)


def without_dead_ends(nodes: DataFrame, links: DataFrame, by: list[str] = ("sample", "target")) -> DataFrame:
    """Nodes on a way from source to sink. A group is one target's graph, which a walk's largest number of nodes bounds."""

    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ahead, back = {}, {}
        for a, b in zip(right["src"], right["dst"]):
            ahead.setdefault(a, []).append(b)
            back.setdefault(b, []).append(a)
        stay = reachable(SOURCE, lambda x: ahead.get(x, ())) & reachable(SINK, lambda x: back.get(x, ()))
        return left[left["kmer"].isin(stay)]

    return nodes.groupBy(*by).cogroup(links.groupBy(*by)).applyInPandas(one, nodes.schema)


def least_counts(nodes: DataFrame, error_rate: float = 0.001, by: list[str] = ("sample", "target")) -> DataFrame:
    """by, upper_median of reference counts, min_count."""
    order = Window.partitionBy(*by).orderBy("count", "kmer")
    size = F.count("*").over(Window.partitionBy(*by))
    middle = nodes.filter("is_reference").withColumns({"_n": F.row_number().over(order) - 1, "_size": size}).filter(F.col("_n") == F.floor(F.col("_size") / 2))
    own = middle.select(*by, F.col("count").alias("upper_median"))
    all_groups = nodes.select(*by).distinct().join(own, list(by), "left")
    return all_groups.select(*by, F.coalesce("upper_median", F.lit(0)).alias("upper_median"), F.greatest(F.lit(2), F.ceil(F.coalesce("upper_median", F.lit(0)) * F.lit(error_rate)).cast("int")).alias("min_count"))


def without_low_counts(nodes: DataFrame, bars: DataFrame, bar: str = "min_count", by: list[str] = ("sample", "target")) -> DataFrame:
    """Without non-reference nodes below their group's bar."""
    return nodes.join(bars.select(*by, F.col(bar).alias("_bar")), list(by)).filter(F.col("is_reference") | (F.col("count") >= F.col("_bar"))).drop("_bar")
