"""Filters of calls: thresholds, expected variants, stages, context flags, panels of normals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import storage
from ..functions import sequence as S
from .variants import INDELS, start_of, trimmed

#: This and the texts of failures below are read back by reports.
NO_MATCH = "No matching variant detected"


@dataclass(frozen=True)
class FilterOptions:
    min_coverage: int = 3
    min_vaf: float = 0.0
    min_expression: float = 0.0
    types: tuple[str, ...] = ()
    use_alt: bool = False
    min_qual: float | None = None
    max_pvalue: float | None = None
    context: bool = False
    homopolymer: int = 6
    low_gc: float = 0.2
    high_gc: float = 0.8


def number(x: float) -> str:
    """As short as it reads back, whole numbers without a point."""
    return str(int(x)) if float(x).is_integer() else repr(float(x))


def reporting(calls: DataFrame, min_qual: float = 0, min_rvaf: float = 0, min_cov: int = 0) -> DataFrame:
    """Reference calls, and others that reach all bars; a bar on quality drops calls without one."""
    fine = (F.col("rVAF") >= min_rvaf) & (F.col("min_coverage") >= min_cov)
    if min_qual > 0:
        fine &= F.coalesce(F.col("qual") >= min_qual, F.lit(False))
    return calls.filter((F.col("type") == "Reference") | fine)


def type_allowed(kind: Column, types: tuple[str, ...]) -> Column:
    return F.lower(kind).isin([t.lower() for t in types]) if types else F.lit(True)


def failures(o: FilterOptions) -> Column:
    """What a call fails, joined by `; `; empty if nothing."""
    tests = [
        F.when(F.col("min_coverage") < o.min_coverage, F.concat(F.lit("coverage "), F.col("min_coverage").cast("string"), F.lit(f" < {o.min_coverage}"))),
        F.when(F.col("rVAF") < o.min_vaf, F.concat(F.lit("VAF "), F.format_string("%.6f", "rVAF"), F.lit(f" < {number(o.min_vaf)}"))),
        F.when(F.col("expression") < o.min_expression, F.concat(F.lit("expression "), F.format_string("%.2f", "expression"), F.lit(f" < {number(o.min_expression)}"))),
        F.when(~type_allowed(F.col("type"), o.types), F.concat(F.lit("type "), F.col("type"), F.lit(" not in allowed types"))),
    ]
    return F.concat_ws("; ", *tests)


def matches(expected: DataFrame, calls: DataFrame, use_alt: bool, order: list[str]) -> DataFrame:
    """expected with its first matching call as struct `call` (null without one).

    Reference mode: same chromosome (without chr), position, alleles and type; for
    insertions, deletions and indels without one, the same after trimming. Alternative
    mode: the call's sequence contains the expected alternative allele. order says which
    call comes first; calls that are equal in it come in the order of their other columns.

    Calls are brought down to the first of each key before any join, so a key costs one
    row however many calls and expected variants share it, and repeated calls cost nothing.
    """
    whole = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in calls.columns if c not in order])
    c = calls.select(whole.alias("call"))

    def firsts(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.min("call").alias("call"))

    if use_alt:
        # no key to join by: each different allele is tested against each different sequence
        alleles = expected.select("alt_allele").filter("alt_allele is not null").distinct()
        own = firsts(c.withColumn("_s", F.col("call.alt_sequence")), "_s")
        hits = alleles.join(own.select("_s"), F.col("_s").contains(F.col("alt_allele"))).join(own, "_s")
        return expected.join(firsts(hits, "alt_allele"), "alt_allele", "left")

    def keyed(p: str | Column, r: str | Column, a: str | Column, chrom: str, kind: str) -> list[Column]:
        return [S.bare_chrom(chrom).alias("_c"), F.col(p).alias("_p"), F.col(r).alias("_r"), F.col(a).alias("_a"), F.lower(kind).alias("_t")]

    keys = ["_c", "_p", "_r", "_a", "_t"]
    named = firsts(c.select(*keyed("call.pos", "call.ref_allele", "call.alt_allele", "call.chrom", "call.type"), "call"), *keys)
    # written, as both joins read it: filters that go below the aggregate would have the calls worked through twice
    named = storage.written(named, f"{storage.new_folder(expected.sparkSession, 'calls')}/rows")
    sought = expected.select("*", *keyed("pos", "ref_allele", "alt_allele", "chrom", "variant_type"))
    exact = sought.join(named, keys, "left")
    indel = F.col("_t").isin([x.lower() for x in INDELS])

    def cut(rows: DataFrame, where: Column) -> DataFrame:
        t = rows.withColumn("_n", F.when(where, trimmed("_p", "_r", "_a")))
        return t.withColumns({"_p": F.col("_n.pos"), "_r": F.col("_n.ref"), "_a": F.col("_n.alt")}).drop("_n")

    near = firsts(cut(named.filter(indel), F.lit(True)), *keys).withColumnRenamed("call", "_near")
    out = cut(exact, indel & F.col("call").isNull()).join(near, keys, "left")
    return out.withColumn("call", F.coalesce("call", "_near")).drop("_near", *keys)


def filtered(expected: DataFrame, calls: DataFrame, options: FilterOptions = FilterOptions(), order: list[str] = ("sample", "target", "variant_name", "min_coverage", "rVAF", "expression")) -> DataFrame:
    """One row for each expected variant: whether a call matches and passes, and what it fails."""
    rows = matches(expected, calls, options.use_alt, list(order))
    flat = rows.select("chrom", "pos", "ref_allele", "alt_allele", "variant_type", F.col("call"), F.col("call.min_coverage").alias("min_coverage"), F.col("call.rVAF").alias("rVAF"), F.col("call.expression").alias("expression"), F.col("call.type").alias("type"))
    failed = failures(options)
    some = F.col("call").isNotNull()
    out = flat.withColumn("_failed", failed)
    fine = some & (F.col("_failed") == "")
    out = out.select(
        F.coalesce("call.sample", F.lit("")).alias("sample"),
        "chrom",
        "pos",
        "ref_allele",
        "alt_allele",
        "variant_type",
        F.when(fine, "Found").otherwise("Not Found").alias("found"),
        F.when(~some, NO_MATCH).when(fine, "PASS").otherwise(F.col("_failed")).alias("filter_notes"),
        F.col("rVAF").alias("kmer_vaf"),
        F.col("min_coverage").alias("kmer_min_coverage"),
        F.col("expression").alias("kmer_expression"),
        F.col("call.ref_sequence").alias("ref_sequence"),
        F.col("call.alt_sequence").alias("variant_sequence"),
        "call",
    )
    if options.min_qual is not None or options.max_pvalue is not None or options.context:
        out = second_pass(out, options)
    return out.drop("call")


def quality_reason(o: FilterOptions, qual: Column, pvalue: Column) -> Column:
    tests = []
    if o.min_qual is not None:
        tests.append(F.when(qual < o.min_qual, F.format_string(f"QUAL %.1f < {o.min_qual:.1f}", qual)))
    if o.max_pvalue is not None:
        shown = short_exponent(f"{o.max_pvalue:.2e}")
        tests.append(F.when(pvalue > o.max_pvalue, F.concat(F.lit("pvalue "), S.scientific(pvalue, 2), F.lit(f" > {shown}"))))
    return F.coalesce(*tests, F.lit(None).cast("string"))


def short_exponent(text: str) -> str:
    mantissa, _, exponent = text.partition("e")
    return f"{mantissa}e{int(exponent)}"


def context_flags(sequence: Column, o: FilterOptions = FilterOptions()) -> Column:
    """Array of flags that annotate and never reject."""
    run, gc = S.max_homopolymer(sequence), S.gc_content(sequence)
    flags = F.array(
        F.when(run >= o.homopolymer, F.concat(F.lit("HOMOPOLYMER_"), run.cast("string"))),
        F.when(gc < o.low_gc, F.format_string("LOW_GC_%.2f", gc)).when(gc > o.high_gc, F.format_string("HIGH_GC_%.2f", gc)),
        F.when(F.upper(sequence).contains("GGC"), F.lit("GGC_MOTIF")),
        F.when(S.low_complexity(sequence), F.lit("LOW_COMPLEXITY")),
    )
    return F.array_compact(flags)


def staged(calls: DataFrame, o: FilterOptions) -> DataFrame:
    """calls with passed, stage_reasons (of failed stages) and context_flags."""
    hard = (
        F.when(F.col("min_coverage") < o.min_coverage, F.format_string(f"min_coverage %d < {o.min_coverage}", "min_coverage"))
        .when(F.col("rVAF") < o.min_vaf, F.format_string(f"vaf %.4f < {o.min_vaf:.4f}", "rVAF"))
        .when(F.col("expression") < o.min_expression, F.format_string(f"expression %.2f < {o.min_expression:.2f}", "expression"))
    )
    reasons = [hard]
    if o.types:
        reasons.append(F.when(~type_allowed(F.col("type"), o.types), F.concat(F.lit("type "), F.col("type"), F.lit(" not in allowed list"))))
    if o.min_qual is not None or o.max_pvalue is not None:
        reasons.append(quality_reason(o, F.col("qual"), F.col("pvalue")))
    failed = F.array_compact(F.array(*reasons))
    flags = context_flags(F.col("ref_sequence"), o) if o.context else F.array().cast("array<string>")
    return calls.withColumns({"stage_reasons": failed, "passed": F.size(failed) == 0, "context_flags": flags})


def second_pass(rows: DataFrame, o: FilterOptions) -> DataFrame:
    """Quality bars and context flags for rows that were found, by the call that was matched."""
    found = F.col("found") == "Found"
    reason = quality_reason(o, F.col("call.qual"), F.col("call.pvalue")) if o.min_qual is not None or o.max_pvalue is not None else F.lit(None).cast("string")
    bad = found & reason.isNotNull()
    notes = F.when(bad, reason).otherwise(F.col("filter_notes"))
    if o.context:
        flags = context_flags(F.col("call.ref_sequence"), o)
        notes = F.when(found & (F.size(flags) > 0), F.concat(notes, F.lit(" [context: "), F.concat_ws(", ", flags), F.lit("]"))).otherwise(notes)
    return rows.withColumns({"_notes": notes, "_found": F.when(bad, "Not Found").otherwise(F.col("found"))}).withColumns({"filter_notes": F.col("_notes"), "found": F.col("_found")}).drop("_notes", "_found")


# Panel of normals

PON_KEY = ["chrom", "pos", "ref_allele", "alt_allele", "target"]


def pon_keyed(calls: DataFrame, align: bool = True) -> DataFrame:
    """calls with struct `_key`: normalised place and alleles in the target; the position is the genomic one if there is one, else the name's start."""
    from .variants import left_aligned

    start = F.coalesce(F.col("pos"), start_of("variant_name"), F.lit(0)).cast("long")
    r, a = F.coalesce("ref_allele", F.lit("")), F.coalesce("alt_allele", F.lit(""))
    n = left_aligned(start, r, a, F.coalesce("ref_sequence", F.lit(""))) if align else trimmed(start, r, a)
    out = calls.withColumn("_n", n)
    key = F.struct(F.coalesce("chrom", F.lit("")).alias("chrom"), F.col("_n.pos").alias("pos"), F.col("_n.ref").alias("ref_allele"), F.col("_n.alt").alias("alt_allele"), "target")
    return out.withColumn("_key", key).drop("_n")


def pon_build(normals: DataFrame, min_vaf: float = 0.0, files: int = 0, align: bool = True) -> DataFrame:
    """How many normal samples show each variant, with their shares; total_samples is in every row."""
    rows = pon_keyed(normals.filter((F.col("type") != "Reference") & (F.col("rVAF") >= min_vaf)), align)
    total = rows.agg(F.greatest(F.countDistinct("sample"), F.lit(files)).alias("total_samples"))
    out = rows.groupBy("_key").agg(F.countDistinct("sample").alias("sample_count"), F.max("rVAF").alias("max_vaf"), F.avg("rVAF").alias("mean_vaf"))
    # total is one row
    return out.join(F.broadcast(total), F.lit(True)).select("_key.*", "sample_count", (F.col("sample_count") / F.greatest("total_samples", F.lit(1))).alias("frequency"), "max_vaf", "mean_vaf", "total_samples")


def pon_split(calls: DataFrame, pon: DataFrame, frequency: float = 0.05, align: bool = True) -> tuple[DataFrame, DataFrame]:
    """(calls that pass, calls that normals show too often); reference calls pass."""
    bad = pon.filter(F.col("frequency") >= frequency).select(F.struct(*PON_KEY).alias("_key")).distinct()
    rows = pon_keyed(calls, align)
    known = F.col("type") == "Reference"
    passed = rows.filter(known).unionByName(rows.filter(~known).join(bad, "_key", "left_anti").select(*rows.columns))
    dropped = rows.filter(~known).join(bad, "_key", "left_semi")
    return passed.drop("_key"), dropped.drop("_key")
