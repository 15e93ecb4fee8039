"""Summaries of calls, comparison with a ground truth, reports about filtering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import sequence as S
from ..functions.special import chi2_sf_col
from .filters import NO_MATCH, FilterOptions

GROUPS = ("sample", "target", "type")


def _mean(x: Column) -> Column:
    """The mean of the numbers as they are written, whatever the order of the rows."""
    return F.avg(x.try_cast("decimal(38,18)")).cast("double")


def _or_zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def summary(calls: DataFrame) -> DataFrame:
    """One row: rows, detected calls, rate, and shares and expressions of calls that are not reference; 0 where there are none."""
    kind = F.col("type") != "Reference"
    vaf, expression = F.when(kind, F.col("rVAF")), F.when(kind, F.col("expression"))
    part = lambda x, p: _or_zero(F.percentile(x, F.lit(p)))
    return calls.agg(
        F.count("*").alias("total_targets"),
        F.count_if(kind).alias("detected"),
        F.when(F.count("*") == 0, F.lit(0.0)).otherwise(F.count_if(kind) / F.count("*")).alias("detection_rate"),
        _or_zero(_mean(vaf)).alias("vaf_mean"),
        part(vaf, 0.5).alias("vaf_median"),
        _or_zero(F.min(vaf)).alias("vaf_min"),
        _or_zero(F.max(vaf)).alias("vaf_max"),
        *[part(vaf, p / 100).alias(f"vaf_p{p}") for p in (5, 25, 75, 95)],
        _or_zero(_mean(expression)).alias("expression_mean"),
        part(expression, 0.5).alias("expression_median"),
        _or_zero(F.min(expression)).alias("expression_min"),
        _or_zero(F.max(expression)).alias("expression_max"),
    )


def grouped_summary(calls: DataFrame, by: str) -> DataFrame:
    if by not in GROUPS:
        raise ValueError(f"group by one of {', '.join(GROUPS)}")
    kind = F.col("type") != "Reference"
    vaf = F.when(kind, F.col("rVAF"))
    return calls.groupBy(by).agg(
        F.count("*").alias("total"),
        F.count_if(kind).alias("detected"),
        (F.count_if(kind) / F.count("*")).alias("detection_rate"),
        _or_zero(_mean(vaf)).alias("vaf_mean"),
        _or_zero(F.percentile(vaf, F.lit(0.5))).alias("vaf_median"),
    )


def type_histogram(calls: DataFrame) -> DataFrame:
    return calls.filter(F.col("type") != "Reference").groupBy("type").agg(F.count("*").alias("n"))


# Ground truth

COUNTS = ["tp", "fp", "fn", "tn"]


def confusion_metrics(counts: DataFrame) -> DataFrame:
    """counts (tp, fp, fn, tn) with sensitivity, specificity, precision, npv, f1, accuracy; null where there is nothing to divide by."""
    tp, fp, fn, tn = (F.col(c) for c in COUNTS)
    ratio = lambda a, b: F.when(b != 0, a / b)
    out = counts.withColumns({"sensitivity": ratio(tp, tp + fn), "specificity": ratio(tn, tn + fp), "precision": ratio(tp, tp + fp), "npv": ratio(tn, tn + fn), "accuracy": ratio(tp + tn, tp + fp + fn + tn)})
    both = F.col("sensitivity") + F.col("precision")
    return out.withColumn("f1", F.when(both != 0, F.lit(2.0) * F.col("sensitivity") * F.col("precision") / both))


def matched_truth(truth: DataFrame, calls: DataFrame, by: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(truth with `measured` and `status`, unmatched calls with status FP).

    A truth row takes the call of largest share at its chromosome (without chr),
    position and alleles; other calls there are false. A call may serve two truth rows.
    Rows of a call table are told apart by their values and how often these repeat.
    """
    place = ["_c", "pos", "ref_allele", "alt_allele"]
    c = calls.filter(F.col("type") != "Reference").withColumn("_c", S.bare_chrom("chrom"))
    rank = Window.partitionBy(*by, *place).orderBy(F.desc("rVAF"), *[F.desc_nulls_last(x) for x in ("sample", "target", "type", "expression", "min_coverage")])
    c = c.withColumn("_n", F.row_number().over(rank))
    t = truth.withColumn("_c", S.bare_chrom("chrom"))
    best = c.filter("_n = 1").select(*by, *place, F.col("rVAF").alias("measured"))
    found = t.join(best, [*by, *place], "left")
    present = F.col("true_vaf") > 0
    hit = F.col("measured").isNotNull()
    status = F.when(present, F.when(hit, "TP").otherwise("FN")).otherwise(F.when(hit, "FP").otherwise("TN"))
    sought = t.select(*by, *place).distinct()
    others = c.filter("_n > 1").unionByName(c.filter("_n = 1").join(sought, [*by, *place], "left_anti").select(*c.columns))
    return found.drop("_c").withColumn("status", status), others.drop("_c", "_n").withColumn("status", F.lit("FP"))


def matched_once(truth: DataFrame, calls: DataFrame, order: list[str] = ("variant_type", "true_vaf")) -> tuple[DataFrame, DataFrame]:
    """(truth with measured_rvaf, vaf_error and `status`, unmatched calls with status FP_call); a call serves one truth row.

    Unlike in `matched_truth` a chromosome is compared in lower case, reference calls may
    match, and the n-th truth row at a place (by order) takes the call of n-th largest share.
    """
    place = ["_c", "pos", "ref_allele", "alt_allele"]
    bare = F.regexp_replace(F.lower("chrom"), "^chr", "")
    rank = Window.partitionBy(*place).orderBy(F.desc("rVAF"), *[F.desc_nulls_last(x) for x in ("sample", "target", "type", "expression", "min_coverage")])
    c = calls.withColumn("_c", bare).withColumn("_n", F.row_number().over(rank))
    t = truth.withColumn("_c", bare).withColumn("_n", F.row_number().over(Window.partitionBy(*place).orderBy(*order)))
    found = t.join(c.select(*place, "_n", F.col("rVAF").alias("measured_rvaf")), [*place, "_n"], "left")
    present, hit = F.col("true_vaf") > 0, F.col("measured_rvaf").isNotNull()
    status = F.when(present, F.when(hit, "TP").otherwise("FN")).otherwise(F.when(hit, "FP_truth").otherwise("TN"))
    error = F.when(present, F.col("measured_rvaf") - F.col("true_vaf"))
    others = c.filter("type <> 'Reference'").join(t.select(*place, "_n"), [*place, "_n"], "left_anti").select(*calls.columns)
    return found.select(*truth.columns, "measured_rvaf", error.alias("vaf_error"), status.alias("status")), others.withColumn("status", F.lit("FP_call"))


def confusion(truth: DataFrame, calls: DataFrame, by: list[str] = ()) -> DataFrame:
    """by, tp, fp, fn, tn and their metrics."""
    t, others = matched_truth(truth, calls, by)
    rows = t.select(*by, "status").unionByName(others.select(*by, "status"))
    count = [F.count_if(F.col("status") == s.upper()).alias(s) for s in COUNTS]
    return confusion_metrics(rows.groupBy(*by).agg(*count) if by else rows.agg(*count))


def by_type(truth: DataFrame, calls: DataFrame) -> DataFrame:
    """variant_type, total, detected, sensitivity of truth that is present."""
    t, _ = matched_truth(truth, calls)
    return t.filter("true_vaf > 0").groupBy("variant_type").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "TP").alias("detected"), (F.count_if(F.col("status") == "TP") / F.count("*")).alias("sensitivity"))


def by_vaf_bin(truth: DataFrame, calls: DataFrame, bounds: list[float] = (0.0, 0.001, 0.01, 0.1, 1.0)) -> DataFrame:
    """bin_low, bin_high, total, detected, sensitivity (null for an empty bin); the last bin is closed."""
    if len(bounds) < 2:
        raise ValueError("two boundaries at least")
    spark = truth.sparkSession
    bins = spark.createDataFrame([(float(a), float(b), i == len(bounds) - 2) for i, (a, b) in enumerate(zip(bounds, bounds[1:]))], "bin_low double, bin_high double, _last boolean")
    t, _ = matched_truth(truth, calls)
    v = F.col("true_vaf")
    inside = (v > 0) & (v >= F.col("bin_low")) & ((v < F.col("bin_high")) | F.col("_last") & (v <= F.col("bin_high")))
    # bins are as few as the boundaries given
    rows = t.select("true_vaf", "status").join(F.broadcast(bins), inside).groupBy("bin_low").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "TP").alias("detected"))
    out = bins.drop("_last").join(rows, "bin_low", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("total", "detected")})
    return out.withColumn("sensitivity", F.when(F.col("total") > 0, F.col("detected") / F.col("total")))


def sweep(truth: DataFrame, calls: DataFrame, thresholds: list[float]) -> DataFrame:
    """threshold and metrics with the calls of at least that share; matching is done anew for each."""
    spark = truth.sparkSession
    # as few rows as thresholds given
    steps = F.broadcast(spark.createDataFrame([(float(x),) for x in thresholds], "threshold double"))
    own = calls.join(steps, F.col("rVAF") >= F.col("threshold"))
    return confusion(truth.join(steps, F.lit(True)), own, ["threshold"])


def detection_limit(bins: DataFrame, level: float) -> DataFrame:
    """level, limit: the share at which sensitivity reaches level, interpolated between neighbouring bins' midpoints; null if it never does."""
    over = Window.orderBy("mid")  # as many rows as bins
    rows = bins.filter("total > 0").withColumn("mid", (F.col("bin_low") + F.col("bin_high")) / 2)
    pairs = rows.select("mid", "sensitivity", F.lead("mid").over(over).alias("m2"), F.lead("sensitivity").over(over).alias("s2"))
    crossing = pairs.filter((F.col("sensitivity") <= level) & (F.col("s2") >= level) & (F.col("s2") > F.col("sensitivity")))
    limit = F.col("mid") + (F.lit(level) - F.col("sensitivity")) * (F.col("m2") - F.col("mid")) / (F.col("s2") - F.col("sensitivity"))
    return crossing.agg(F.lit(level).alias("level"), F.min_by(limit, "mid").alias("limit"))


def mcnemar(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """b, c, statistic (with continuity correction from 20 discordant pairs) and, by pvalue=True callers, its tail."""
    only_a, only_b = F.count_if(F.col(a) & ~F.col(b)), F.count_if(~F.col(a) & F.col(b))
    out = pairs.agg(only_a.alias("b"), only_b.alias("c"))
    n, gap = F.col("b") + F.col("c"), F.abs(F.col("b") - F.col("c"))
    top = F.when(n >= 20, F.greatest(gap - 1, F.lit(0))).otherwise(gap)
    return out.withColumn("statistic", F.when(n == 0, F.lit(0.0)).otherwise(top * top / n))


def with_pvalue(statistics: DataFrame) -> DataFrame:
    return statistics.withColumn("pvalue", chi2_sf_col(F.col("statistic"), F.lit(1.0)))


def concordance(left: DataFrame, right: DataFrame, key: list[str], hit: str = "detected") -> DataFrame:
    """key, both tools' outcome and how they compare, over the keys of either."""
    a = left.select(*key, F.col(hit).alias("left_hit"))
    b = right.select(*key, F.col(hit).alias("right_hit"))
    x, y = F.coalesce("left_hit", F.lit(False)), F.coalesce("right_hit", F.lit(False))
    return a.join(b, key, "full").withColumn("outcome", F.when(x & y, "both").when(x, "left_only").when(y, "right_only").otherwise("neither"))


# Reports about filtering


def outcome() -> Column:
    return F.when(F.col("found") == "Found", "found").when(F.col("filter_notes") == NO_MATCH, "not_detected").otherwise("detected_but_filtered")


def filter_summary(rows: DataFrame) -> DataFrame:
    own = rows.select(outcome().alias("o"))
    n = F.count("*")
    count = lambda x: F.count_if(F.col("o") == x)
    return own.agg(
        n.alias("total_expected"),
        count("found").alias("found"),
        (n - count("found")).alias("not_found"),
        count("detected_but_filtered").alias("detected_but_filtered"),
        count("not_detected").alias("not_detected"),
        F.when(n == 0, F.lit(0.0)).otherwise(count("found") / n).alias("detection_rate"),
    )


def parsed_notes(rows: DataFrame, keep: list[str] = ()) -> DataFrame:
    """keep, criterion, observed, threshold for each failure in filter_notes."""
    parts = rows.filter(~F.col("filter_notes").isin("PASS", NO_MATCH)).select(*keep, F.explode(F.split("filter_notes", "; ")).alias("part"))
    form = "^(coverage|VAF|expression) ([^<]*)<([^<]*)$"
    named = parts.withColumns({"criterion": F.when(F.col("part").startswith("type "), F.lit("type")).otherwise(F.regexp_extract("part", form, 1)), "observed": F.trim(F.regexp_extract("part", form, 2)).try_cast("double"), "threshold": F.trim(F.regexp_extract("part", form, 3)).try_cast("double")})
    return named.filter((F.col("criterion") == "type") | (F.col("observed").isNotNull() & F.col("threshold").isNotNull())).drop("part")


def by_criterion(rows: DataFrame) -> DataFrame:
    """criterion, rejected_alone, rejected_any; a row for each of the four criteria."""
    own = rows.filter(outcome() == "detected_but_filtered").withColumn("_r", F.monotonically_increasing_id())
    kinds = parsed_notes(own, ["_r"]).groupBy("_r").agg(F.collect_set("criterion").alias("kinds"))
    counts = kinds.select(F.explode("kinds").alias("criterion"), (F.size("kinds") == 1).alias("alone")).groupBy("criterion").agg(F.count_if("alone").alias("rejected_alone"), F.count("*").alias("rejected_any"))
    four = rows.sparkSession.createDataFrame([("coverage",), ("VAF",), ("expression",), ("type",)], "criterion string")
    return four.join(counts, "criterion", "left").select("criterion", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("rejected_alone", "rejected_any")])


def near_misses(rows: DataFrame, o: FilterOptions) -> DataFrame:
    """Rows not found that reach half a bar or more."""
    three = [("coverage", F.col("kmer_min_coverage").cast("double"), float(o.min_coverage)), ("VAF", F.col("kmer_vaf"), float(o.min_vaf)), ("expression", F.col("kmer_expression"), float(o.min_expression))]
    tests = F.array(*[F.struct(F.lit(n).alias("criterion"), x.alias("observed_value"), F.lit(t).alias("threshold"), (x / F.lit(t)).alias("ratio")) for n, x, t in three if t > 0]) if any(t > 0 for *_, t in three) else None
    rows = rows.filter(F.col("found") != "Found")
    if tests is None:
        tests = F.expr("cast(array() as array<struct<criterion:string,observed_value:double,threshold:double,ratio:double>>)")
    out = rows.select("chrom", "pos", "ref_allele", "alt_allele", F.explode(tests).alias("m")).select("chrom", "pos", "ref_allele", "alt_allele", "m.*")
    return out.filter("ratio >= 0.5 and ratio < 1")


def variant_details(rows: DataFrame) -> DataFrame:
    return rows.select("chrom", "pos", "ref_allele", "alt_allele", "variant_type", outcome().alias("outcome"), "filter_notes", "kmer_vaf", "kmer_min_coverage", "kmer_expression")


def threshold_sensitivity(rows: DataFrame, o: FilterOptions, multipliers: tuple[float, ...] = (0.5, 1.0, 2.0, 5.0)) -> DataFrame:
    """How many expected variants would be found if all bars were scaled; the type does not count."""
    own = rows.select(outcome().alias("o"), "kmer_min_coverage", "kmer_vaf", "kmer_expression")
    # four rows
    steps = F.broadcast(rows.sparkSession.createDataFrame([(m, "1x (current)" if m == 1 else f"{m:g}x", int(o.min_coverage * m), o.min_vaf * m, o.min_expression * m) for m in multipliers], "multiplier double, label string, cov long, vaf double, expr double"))
    fine = (F.col("o") != "not_detected") & (F.col("kmer_min_coverage") >= F.col("cov")) & (F.col("kmer_vaf") >= F.col("vaf")) & (F.col("kmer_expression") >= F.col("expr"))
    return own.join(steps, F.lit(True)).groupBy("multiplier", "label").agg(F.count_if(fine).alias("found"), (F.count_if(fine) / F.count("*")).alias("detection_rate"))


# Charts' figures


def vaf_histogram(calls: DataFrame, bins: int = 20) -> DataFrame:
    """bin (from 0), low, high, n over 0 to the largest share (0.01 at least); bins without calls are left out."""
    own = calls.filter(F.col("type") != "Reference").select("rVAF")
    top = F.broadcast(own.agg(F.greatest(F.max("rVAF"), F.lit(0.01)).alias("top")))  # one row
    width = F.col("top") / F.lit(float(bins))
    rows = own.join(top, F.lit(True)).withColumn("bin", F.least(F.floor(F.col("rVAF") / width), F.lit(bins - 1)).cast("int"))
    return rows.groupBy("bin", "top").agg(F.count("*").alias("n")).select("bin", (F.col("bin") * width).alias("low"), ((F.col("bin") + 1) * width).alias("high"), "n")


def detection_bars(calls: DataFrame, top: int = 30) -> DataFrame:
    """target, detected, reference of the targets with most detected calls, by name."""
    kind = F.col("type") != "Reference"
    counts = calls.groupBy("target").agg(F.count_if(kind).alias("detected"), F.count_if(~kind).alias("reference"))
    return counts.orderBy(F.desc("detected"), "target").limit(top).orderBy("target")


def detection_summary(calls: DataFrame, order: list[str]) -> DataFrame:
    """target, result_type, rvaf, coverage, n_paths, n_variants: a row for each target of a run."""
    kind = F.col("type") != "Reference"
    rank = F.struct(*order)
    return calls.groupBy("target").agg(
        F.coalesce(F.min_by(F.when(kind, F.col("type")), F.struct(~kind, *order)), F.lit("Reference")).alias("result_type"),
        F.coalesce(F.max(F.when(kind, F.col("rVAF"))), F.lit(1.0)).alias("rvaf"),
        F.min_by("min_coverage", rank).alias("coverage"),
        F.count("*").alias("n_paths"),
        F.count_if(kind).alias("n_variants"),
    )


def runtime_scaling(timings: DataFrame) -> DataFrame:
    """tool, threads, n_targets, seconds (mean), targets_per_second, speedup over one tool's smallest number of threads."""
    means = timings.groupBy("tool", "threads", "n_targets").agg(F.avg("seconds").alias("seconds"))
    first = F.first("seconds").over(Window.partitionBy("tool", "n_targets").orderBy("threads"))
    return means.withColumns({"targets_per_second": F.when(F.col("seconds") > 0, F.col("n_targets") / F.col("seconds")), "speedup": F.when(F.col("seconds") > 0, first / F.col("seconds"))})
