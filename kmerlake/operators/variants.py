"""Classification, normalisation, de-duplication and clustering of calls, as columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import sequence as S
from ..functions.kmers import col
from . import local

INDELS = ["Insertion", "Deletion", "Indel"]


def piece(s: Column, start: Column, n: Column) -> Column:
    """n characters from start, counted from 0; null where the text does not hold them all."""
    return F.when((start >= 0) & (start + n <= F.length(s)), F.substring(s, start + 1, n))


def classified(reference: Column | str, alt: Column | str) -> Column:
    """struct(type, variant_name, ref_allele, alt_allele, start, end) of an alternative sequence."""
    r, a = col(reference), col(alt)
    start = S.shared_prefix(r, a)
    same = F.greatest(F.lit(0), F.least(S.shared_suffix(r, a), F.length(r) - 1 - start, F.length(a) - 1 - start))
    r_end, a_end = F.greatest(F.length(r) - 1, F.lit(0)) - same, F.greatest(F.length(a) - 1, F.lit(0)) - same
    base = F.struct(r.alias("r"), start.alias("start"), r_end.alias("r_end"), a_end.alias("a_end"), F.substring(r, start + 1, F.greatest(r_end - start + 1, F.lit(0))).alias("old"), F.substring(a, start + 1, F.greatest(a_end - start + 1, F.lit(0))).alias("new"))

    def finish(x: Column) -> Column:
        old, new, at, seq = x["old"], x["new"], x["start"], x["r"]
        n, m = F.length(old), F.length(new)
        extra = m - n
        head, tail = F.left(new, extra), F.substring(new, n + 1, extra)
        eq = lambda p, q: F.coalesce(p == q, F.lit(False))
        by_start = new.startswith(old) & eq(tail, piece(seq, at, extra))
        by_end = new.endswith(old) & (eq(head, piece(seq, at - extra, extra)) | eq(head, piece(seq, at + n, extra)))
        window = F.exists(F.sequence(F.lit(0), F.greatest(extra, F.lit(0))), lambda o: eq(new, piece(seq, at - o, m)))
        pure = eq(new, piece(seq, at - extra, extra)) | eq(new, piece(seq, at, extra))
        tandem = (extra >= 2) & F.when(n == 0, pure).otherwise(by_start | by_end | window)
        kind = (
            F.when(n == m, "Substitution")
            .when((m > n) & tandem, "ITD")
            .when(m > n, F.when(new.startswith(old) | new.endswith(old), "Insertion").otherwise("Indel"))
            .otherwise(F.when(old.startswith(new) | old.endswith(new), "Deletion").otherwise("Indel"))
        )
        end = F.greatest(x["r_end"], x["a_end"])
        name = F.concat(at.cast("string"), F.lit(":"), old, F.lit("/"), new, F.lit(":"), end.cast("string"))
        return F.struct(kind.alias("type"), name.alias("variant_name"), old.alias("ref_allele"), new.alias("alt_allele"), at.alias("start"), end.alias("end"))

    none = F.struct(F.lit("Reference").alias("type"), F.lit("").alias("variant_name"), F.lit("").alias("ref_allele"), F.lit("").alias("alt_allele"), F.lit(0).alias("start"), F.lit(0).alias("end"))
    return F.when(r == a, none).otherwise(F.transform(F.array(base), finish)[0])


def start_of(name: Column | str) -> Column:
    """The number before the first colon of a variant name, null without one."""
    return F.split(col(name), ":")[0].try_cast("long")


def end_of(name: Column | str) -> Column:
    return F.element_at(F.split(col(name), ":"), -1).try_cast("long")


def trimmed(pos: Column | str, ref: Column | str, alt: Column | str) -> Column:
    """struct(pos, ref, alt) without common suffix and then prefix, one base of each allele kept; expressions only."""
    p, r, a = col(pos), col(ref), col(alt)
    least = F.least(F.length(r), F.length(a))
    tail = F.greatest(F.lit(0), F.least(S.shared_suffix(r, a), least - 1))
    step = F.struct(F.left(r, F.length(r) - tail).alias("r"), F.left(a, F.length(a) - tail).alias("a"))

    def head(x: Column) -> Column:
        n = F.greatest(F.lit(0), F.least(S.shared_prefix(x["r"], x["a"]), F.least(F.length(x["r"]), F.length(x["a"])) - 1))
        return F.struct((p + n).cast("long").alias("pos"), F.substring(x["r"], n + 1, F.length(x["r"])).alias("ref"), F.substring(x["a"], n + 1, F.length(x["a"])).alias("alt"))

    same = F.struct(p.cast("long").alias("pos"), r.alias("ref"), a.alias("alt"))
    return F.when((r == a) | ((F.length(r) == 1) & (F.length(a) == 1)), same).otherwise(F.transform(F.array(step), head)[0])


def left_aligned(pos: Column | str, ref: Column | str, alt: Column | str, context: Column | str) -> Column:
    """struct(pos, ref, alt) shifted left through the context as far as it goes, then trimmed."""

    @F.pandas_udf("pos long, ref string, alt string")
    def run(p: pd.Series, r: pd.Series, a: pd.Series, c: pd.Series) -> pd.DataFrame:
        rows = [local.normalize(int(w), x or "", y or "", z or None) for w, x, y, z in zip(p, r, a, c)]
        return pd.DataFrame(rows, columns=["pos", "ref", "alt"])

    return run(col(pos), col(ref), col(alt), col(context))


def normalized(calls: DataFrame, align: bool = True) -> DataFrame:
    """calls with norm_pos, norm_ref, norm_alt: of the name's start and the alleles, in the reference sequence."""
    start = F.coalesce(start_of("variant_name"), F.lit(0)).cast("long")
    r, a = F.coalesce("ref_allele", F.lit("")), F.coalesce("alt_allele", F.lit(""))
    shifted = left_aligned(start, r, a, F.coalesce("ref_sequence", F.lit(""))) if align else trimmed(start, r, a)
    out = calls.withColumn("_norm", shifted)
    return out.select(*calls.columns, F.col("_norm.pos").alias("norm_pos"), F.col("_norm.ref").alias("norm_ref"), F.col("_norm.alt").alias("norm_alt"))


def deduplicated(calls: DataFrame, order: list[str], align: bool = True) -> DataFrame:
    """Of indels alike after normalisation in a sample and target the one of largest expression; others pass.

    order breaks ties of expression and has to tell rows apart.
    """
    indels = normalized(calls.filter(F.col("type").isin(INDELS)), align)
    over = Window.partitionBy("sample", "target", F.coalesce("chrom", F.lit("")), "norm_pos", "norm_ref", "norm_alt").orderBy(F.desc("expression"), *order)
    best = indels.withColumn("_n", F.row_number().over(over)).filter("_n = 1").select(*calls.columns)
    return calls.filter(~F.col("type").isin(INDELS)).unionByName(best)


def clustered(calls: DataFrame, by: list[str] = ("sample", "target")) -> DataFrame:
    """Named calls with cluster_id (from 1 in each group): closed intervals that overlap, transitively."""
    spans = calls.withColumns({"_s": start_of("variant_name"), "_e": end_of("variant_name")}).filter("_s is not null and _e is not null")
    order = Window.partitionBy(*by).orderBy("_s", "_e")
    before = F.max("_e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col("_s") > before), 1).otherwise(0)
    return spans.withColumn("_new", fresh).withColumn("cluster_id", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumnsRenamed({"_s": "start", "_e": "end"}).drop("_new")


def clusters(calls: DataFrame, by: list[str] = ("sample", "target")) -> DataFrame:
    """by, cluster_id, start, end, n of each cluster."""
    return clustered(calls, by).groupBy(*by, "cluster_id").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"))


def with_clusters(calls: DataFrame, by: list[str] = ("sample", "target")) -> DataFrame:
    """calls with `;cluster=N` in info for clusters of several calls, numbered from 1 among those."""
    several = clusters(calls, by).filter("n > 1").withColumn("_number", F.row_number().over(Window.partitionBy(*by).orderBy("cluster_id"))).select(*by, "cluster_id", "_number")
    named = clustered(calls, by).select(*by, "variant_name", "cluster_id").distinct().join(several, [*by, "cluster_id"]).select(*by, "variant_name", "_number")
    return calls.join(named, [*by, "variant_name"], "left").withColumn("info", F.concat("info", F.coalesce(F.concat(F.lit(";cluster="), F.col("_number").cast("string")), F.lit("")))).select(*calls.columns)
