"""Merging calls made at several k-mer lengths into consensus calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .variants import INDELS, left_aligned, start_of, trimmed

#: For each type, (largest k, weight) in ascending order; the last weight holds beyond.
WEIGHTS = {
    "Substitution": ((21, 0.7), (31, 1.0), (None, 0.9)),
    "Insertion": ((21, 1.0), (31, 0.9), (None, 0.7)),
    "Deletion": ((21, 1.0), (31, 0.9), (None, 0.7)),
    "Indel": ((21, 1.0), (31, 0.7), (None, 0.4)),
    "ITD": ((25, 1.0), (31, 0.8), (None, 0.3)),
    "Reference": ((None, 1.0),),
}


def weight(kind: Column, k: Column) -> Column:
    out = None
    for name, steps in WEIGHTS.items():
        own = None
        for most, value in steps:
            if most is None:
                own = F.lit(value) if own is None else own.otherwise(F.lit(value))
            else:
                own = F.when(k <= most, value) if own is None else own.when(k <= most, value)
        out = F.when(kind == name, own) if out is None else out.when(kind == name, own)
    return out.otherwise(F.lit(1.0))


def tier(ks: Column, total: int) -> Column:
    """1: every k; 2: two or more; 3: only 31; 4: any other single k."""
    n = F.size(ks)
    return F.when(n >= total, 1).when(n >= 2, 2).when((n == 1) & (ks[0] == 31), 3).otherwise(4)


def keyed(calls: DataFrame, align: bool = True) -> DataFrame:
    """calls with `identity`, what makes them one variant across k."""
    start = F.coalesce(start_of("variant_name"), F.lit(0)).cast("long")
    r, a = F.coalesce("ref_allele", F.lit("")), F.coalesce("alt_allele", F.lit(""))
    has = F.col("ref_allele").isNotNull() & F.col("alt_allele").isNotNull() & ((r != "") | (a != ""))
    shift = left_aligned(start, r, a, F.when(F.col("type").isin(INDELS), F.coalesce("ref_sequence", F.lit(""))).otherwise("")) if align else trimmed(start, r, a)
    out = calls.withColumn("_n", shift)
    text = F.concat_ws("|", F.coalesce("chrom", F.lit("")), F.col("_n.pos").cast("string"), F.col("_n.ref"), F.col("_n.alt"))
    identity = F.when(F.col("type") == "Reference", F.lit("R")).when(has, F.concat(F.lit("N|"), text)).otherwise(F.concat(F.lit("V|"), "variant_name"))
    return out.withColumn("identity", identity).drop("_n")


def merged(calls: DataFrame, ks: list[int], align: bool = True, order: list[str] = ("k",)) -> DataFrame:
    """Consensus calls of calls with a column k.

    Calls of one identity are of one family of types (insertions, deletions and indels
    are one) that the smallest k's first call gives; calls of other families stay apart
    by k and name. The call of largest expression stands for all (ties: the last by
    order, then name). Adds k_values, per_k_rvafs, consensus_rvaf, consensus_score, tier.
    """
    family = F.when(F.col("type").isin(INDELS), F.lit("indel")).otherwise(F.col("type"))
    rows = keyed(calls, align).withColumn("_family", family)
    same = Window.partitionBy("sample", "target", "identity").orderBy(*order, "type", "variant_name")
    apart = F.concat(F.lit("V|k"), F.col("k").cast("string"), F.lit(":"), F.col("variant_name"))
    rows = rows.withColumn("identity", F.when(F.col("_family") == F.first("_family").over(same), F.col("identity")).otherwise(apart))
    keys = ["sample", "target", "identity"]
    whole = F.struct(*[F.col(c) for c in calls.columns])
    best = F.max_by(whole, F.struct("expression", *order, "type", "variant_name", "rVAF")).alias("best")
    per_k = rows.groupBy(*keys, "k").agg(F.max("rVAF").alias("rvaf"), best, F.collect_list(F.struct("min_coverage", "rVAF")).alias("own"))
    groups = per_k.groupBy(*keys).agg(
        F.array_sort(F.collect_set("k")).alias("k_values"),
        F.array_sort(F.collect_list(F.struct("k", "rvaf"))).alias("_per_k"),
        F.max_by("best", F.struct("best.expression", *[f"best.{c}" for c in order], "best.type", "best.variant_name", "best.rVAF")).alias("best"),
        F.flatten(F.collect_list(F.transform("own", lambda x: F.struct(F.col("k").alias("k"), x["min_coverage"].alias("c"), x["rVAF"].alias("v"))))).alias("_own"),
    )
    kind = F.col("best.type")
    w = lambda x: weight(kind, x["k"]) * x["c"]
    total = F.aggregate("_own", F.lit(0.0), lambda s, x: s + w(x))
    dot = F.aggregate("_own", F.lit(0.0), lambda s, x: s + w(x) * x["v"])
    every = F.aggregate(F.array(*[F.lit(k) for k in ks]), F.lit(0.0), lambda s, k: s + weight(kind, k))
    found = F.aggregate("k_values", F.lit(0.0), lambda s, k: s + weight(kind, k))
    out = groups.select(
        "best.*",
        "identity",
        "k_values",
        F.map_from_entries("_per_k").alias("per_k_rvafs"),
        F.when(total > 0, dot / total).otherwise(F.col("best.rVAF")).alias("consensus_rvaf"),
        F.when(every > 0, found / every).otherwise(F.lit(0.0)).alias("consensus_score"),
        tier(F.col("k_values"), len(ks)).alias("tier"),
    )
    return out.drop("k")


def ordered(consensus: DataFrame) -> DataFrame:
    """Consensus calls by sample and target, then identity; for output."""
    return consensus.orderBy("sample", "target", "identity")


def as_calls(consensus: DataFrame) -> DataFrame:
    """Consensus calls as calls: the consensus share, and how it came about in info. The order of the rows stays."""
    per_k = F.concat_ws(",", F.transform(F.array_sort(F.map_entries("per_k_rvafs")), lambda e: F.format_string("k%d=%.4f", e["key"], e["value"])))
    info = F.format_string("multi_k=%s;tier=%d;score=%.3f;per_k=[%s]", F.concat_ws(",", F.transform("k_values", lambda k: k.cast("string"))), F.col("tier"), F.col("consensus_score"), per_k)
    extra = ["identity", "k_values", "per_k_rvafs", "consensus_rvaf", "consensus_score", "tier"]
    return consensus.withColumns({"rVAF": F.col("consensus_rvaf"), "info": info}).drop(*extra)


def tier_distribution(consensus: DataFrame) -> DataFrame:
    return consensus.groupBy("tier").agg(F.count("*").alias("n"))
