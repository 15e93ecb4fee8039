"""One function for each command: tables or paths in, tables out, files where asked for."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import storage
from ..operators import detect as detection
from ..operators import filters, kmer_tables, local, merge as merging, metrics
from ..sources import readers, writers
from . import charts, dot, reports, settings

CALL_ORDER = ["variant_name", "sample", "alt_sequence", "type"]


def detect(spark: SparkSession, db: str, targets: list[str], k: int | None = None, config: str | None = None, sensitivity: str | None = None, multi_k: list[int] | None = None, output: str | None = None, form: str = "tsv", header: bool = True, trace: str | None = None, debug_graph: str | None = None, report_dir: str | None = None, report_level: str = "summary", **given) -> DataFrame:
    """Calls of a k-mer table against FASTA targets."""
    kmers = readers.kmer_table(spark, db)
    own = readers.fasta(spark, *targets)
    options = settings.detect_options(settings.settled(readers.config(config) if config else {}, given, sensitivity))
    if multi_k:
        from ..operators.consensus import as_calls, ordered

        calls = filters.reporting(as_calls(ordered(detection.detect_multi_k(own, kmers, multi_k, options))), options.min_qual, options.min_rvaf, options.min_cov)
    else:
        k = kmer_tables.kmer_length(kmers, k)
        found = detection.attempts(own, kmers, k, options)
        if report_dir or output:  # read more than once
            found = storage.written(found, f"{storage.new_folder(spark, 'attempts')}/rows")
        calls = detection.finished(found, options)
        sample = readers.sample_of(db)
        if trace:
            reports.write_traces(own, kmers, k, options, trace, sample)
        if debug_graph:
            write_graphs(own, kmers, k, options, debug_graph, sample)
    if report_dir:
        files = None
        if report_level in reports.LEVELS[2:] and not multi_k:
            files = reports.documents(own, kmers, k, lambda *job: reports.details(*job, options, report_level))
        level = "standard" if multi_k and files is None and report_level in reports.LEVELS[2:] else report_level
        reports.write_run_report(calls, report_dir, CALL_ORDER, level, None if multi_k else found, files)
    if output:
        writers.write_calls(calls, form, output, header)
    return calls


def write_graphs(targets: DataFrame, kmers: DataFrame, k: int, o: detection.DetectOptions, folder: str, sample: str) -> None:
    """A Graphviz file for each target of a panel. The tasks make the texts."""

    def text(sample: str, target: str, sequence: str, k: int, count: local.Count) -> str:
        reference = [sequence[i : i + k] for i in range(len(sequence) - k + 1)]
        graph = local.build_graph(local.walk(reference, count, o.walk), reference)
        if o.prune:
            local.prune(graph, o.prune)
        return dot.graph_dot(graph, target, [p for p, _ in local.paths(graph, count)])

    os.makedirs(folder, exist_ok=True)
    for r in reports.documents(targets, kmers.filter(F.col("sample") == sample), k, text).toLocalIterator():
        with open(f"{folder}/{reports.safe(r['target'])}.dot", "w", encoding="utf-8") as file:
            file.write(r["text"])


def filter_calls(spark: SparkSession, calls: DataFrame | str, expected: DataFrame | str, config: str | None = None, output: str | None = None, header: bool = True, **given) -> DataFrame:
    """One row for each expected variant."""
    calls = readers.calls(spark, calls) if isinstance(calls, str) else calls
    expected = readers.expected(spark, expected) if isinstance(expected, str) else expected
    rows = filters.filtered(expected, calls, settings.filter_options(readers.config(config) if config else {}, **given))
    if output:
        writers.write_filtered(rows, output, header)
    return rows


def merge(spark: SparkSession, inputs: list[str], deduplicate: bool = False, output: str | None = None, header: bool = True) -> DataFrame:
    heads = [spark.read.text(p).first() for p in inputs]
    if len({h[0] if h else None for h in heads}) > 1:
        raise ValueError("the inputs have different headers")
    calls = merging.merged([readers.calls(spark, p, line=deduplicate).drop("path_score") for p in inputs], deduplicate)
    if output:
        writers.write_calls(calls, "tsv", output, header)
    return calls


def stats(calls: DataFrame, group_by: str | None = None, output: str | None = None, form: str = "tsv") -> DataFrame:
    """The summary, or one row for each group; a file in form tsv, text or json (groups: tsv)."""
    if form not in writers.STATS_FORMS:
        raise ValueError(f"forms are {', '.join(writers.STATS_FORMS)}")
    if group_by:
        rows = metrics.grouped_summary(calls, group_by).orderBy(group_by)
        if output:
            writers.write_table(rows, writers.grouped_stats_cells(group_by), output)
        return rows
    rows = metrics.summary(calls)
    if output:
        writers.write_stats(rows, metrics.type_histogram(calls), form, output)
    return rows


def plot(calls: DataFrame, kind: str, output: str | None = None) -> str:
    path = output or f"{kind}.svg"
    text = charts.chart(calls, kind)
    with open(path, "w", encoding="utf-8") as file:
        file.write(text)
    return path


def coverage(spark: SparkSession, db: str, targets: list[str], k: int | None = None, output: str | None = None) -> DataFrame:
    kmers = readers.kmer_table(spark, db)
    rows = kmer_tables.coverage_stats(readers.fasta(spark, *targets), kmers, kmer_tables.kmer_length(kmers, k))
    if output:
        writers.write_coverage(rows, output)
    return rows


def run(spark: SparkSession, db: str, targets: list[str], expected: str | None = None, output: str | None = None, use_alt: bool = False, min_coverage: int = 3, min_vaf: float = 0.0, **given) -> DataFrame:
    """Detection, and filtering if there are expected variants."""
    calls = detect(spark, db, targets, output=None if expected else output, **given)
    return filter_calls(spark, calls, expected, output=output, use_alt=use_alt, min_coverage=min_coverage, min_vaf=min_vaf) if expected else calls


def benchmark(spark: SparkSession, results: str, truth: str, vaf_bins: str = "0,0.001,0.01,0.1,1.0", sweep_vaf: str | None = None, output: str | None = None, form: str = "text") -> dict:
    report = reports.benchmark_report(readers.truth(spark, truth), readers.calls(spark, results), readers.floats(vaf_bins), readers.floats(sweep_vaf) if sweep_vaf else ())
    if form == "json":
        writers.write_json(report, output)
    else:
        writers.put([reports.benchmark_text(report)], output, "")
    return report


def pon_build(spark: SparkSession, normals: list[str], output: str, min_vaf: float = 0.0) -> DataFrame:
    calls = merging.merged([readers.calls(spark, p) for p in normals])
    panel = filters.pon_build(calls, min_vaf, len(normals))
    writers.write_pon(panel, output)
    return panel


def pon_filter(spark: SparkSession, calls: str, pon: str, frequency: float = 0.05, output: str | None = None) -> DataFrame:
    passed, _ = filters.pon_split(readers.calls(spark, calls), readers.pon(spark, pon), frequency)
    if output:
        writers.write_calls(passed, "tsv", output)
    return passed
