"""Traces of detection, run reports, and texts of benchmarks and filter reports."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators import local, metrics
from ..operators.detect import DetectOptions, detect_target, over_targets
from ..operators.filters import FilterOptions
from ..sources.writers import write_json, write_table

LEVELS = ("summary", "standard", "detailed", "full")


def safe(name: str) -> str:
    return re.sub(r"[^\w-]", "_", name)


def trace_target(sample: str, target: str, sequence: str, k: int, count: local.Count, o: DetectOptions) -> dict:
    """What detection saw on the way to a target's calls, as a document."""
    sequence = sequence.upper()
    reference = [sequence[i : i + k] for i in range(len(sequence) - k + 1)]
    nodes = (local.walk_both if o.walk.bidirectional else local.walk)(reference, count, o.walk)
    graph = local.build_graph(nodes, reference)
    removed = local.prune(graph, o.prune) if o.prune else 0
    routes = local.paths(graph, count)
    calls, seen = detect_target(sample, target, sequence, k, count, o)
    known = set(reference)
    branching = [x for x in sorted(nodes) if len(local.accepted(local.forward(x), count, o.walk.count, o.walk.ratio)) > 1]
    edges = graph.edges()

    def common(a: str, b: str) -> int:
        return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    base = local.spell(routes[0][0]) if routes else sequence
    return {
        "target": target,
        "walking": {"reference_kmers": len(known), "nodes": len(nodes), "variant_nodes": len(set(nodes) - known), "branching_points": branching},
        "graph": {"nodes": len(graph.counts), "edges": len(edges), "reference_edges": sum(e[3] for e in edges), "variant_edges": sum(not e[3] for e in edges), "removed": removed, "pruned": sorted(set(nodes) - set(graph.counts))},
        "pathfinding": {"paths": [{"length": len(p), "score": s, "mean_coverage": local.mean_count(p, count), "sequence": local.spell(p), "is_reference": i == 0, "shared_prefix": common(base, local.spell(p)), "shared_suffix": common(base[::-1], local.spell(p)[::-1])} for i, (p, s) in enumerate(routes)]},
        "classifications": [{"path": i, "type": c["type"], "name": c["variant_name"], "ref_allele": c["ref_allele"], "alt_allele": c["alt_allele"]} for i, c in enumerate(calls) if i],
        "quantification": {"coefficients": [c["expression"] for c in calls], "rvafs": [c["rVAF"] for c in calls], "min_coverages": [c["min_coverage"] for c in calls], "kmers": len({x for p, _ in routes for x in p})} if len(calls) > 1 else None,
        "outcome": seen["outcome"],
    }


def details(sample: str, target: str, sequence: str, k: int, count: local.Count, o: DetectOptions, level: str) -> dict[str, str]:
    """Texts of the files that a target has from `detailed` on, by their paths below the target's folder."""
    trace = trace_target(sample, target, sequence, k, count, o)
    reference = [sequence.upper()[i : i + k] for i in range(len(sequence) - k + 1)]
    known = set(reference)
    nodes = (local.walk_both if o.walk.bidirectional else local.walk)(reference, count, o.walk)
    steps, branches, ends = [], [], 0
    for way, step in (("forward", local.forward), ("backward", local.backward))[: 1 + o.walk.bidirectional]:
        for x in sorted(nodes):
            four = step(x)
            taken = {y for y, _ in local.accepted(four, count, o.walk.count, o.walk.ratio)}
            bar = max(o.walk.count, int(sum(map(count, four)) * o.walk.ratio))
            steps += [(y, way, count(y), bar, y in taken) for y in four if count(y)]
            ends += not taken
            if len(taken) > 1 and way == "forward":
                own = next((y for y in four if y in known), "")
                best = max(sorted(four), key=count)
                branches.append((reference.index(x) if x in known else "", count(own) if own else 0, ",".join(str(count(y)) for y in four if y in taken and y != own), best))
    graph = local.build_graph(nodes, reference)
    if o.prune:
        local.prune(graph, o.prune)
    routes = local.paths(graph, count)
    kmers, matrix = local.contributions([p for p, _ in routes])
    table = lambda head, rows: "".join("\t".join(str(x).lower() if isinstance(x, bool) else f"{x:g}" if isinstance(x, float) else str(x) for x in row) + "\n" for row in [head, *rows])
    numbers = trace["quantification"] or {"coefficients": [], "rvafs": [], "min_coverages": []}
    out = {
        "walking/walk_log.tsv": table(("kmer", "direction", "count", "threshold", "accepted"), steps),
        "walking/branches_explored.tsv": table(("position", "ref_count", "alt_counts", "chosen"), branches),
        "walking/walk_stats.json": json.dumps({"total_extensions": len(steps), "accepted": sum(x[4] for x in steps), "rejected": sum(not x[4] for x in steps), "dead_ends": ends, "branch_points": len(branches)}, indent=2),
        "graph/graph_stats.json": json.dumps({"n_nodes": trace["graph"]["nodes"], "n_edges": trace["graph"]["edges"], "n_ref_nodes": len(known & set(graph.counts)), "n_alt_nodes": len(set(graph.counts) - known), "n_pruned": trace["graph"]["removed"]}, indent=2),
        "graph/paths.tsv": table(("path_id", "sequence", "weight", "is_ref"), [(i, x["sequence"], float(x["score"]), x["is_reference"]) for i, x in enumerate(trace["pathfinding"]["paths"])]),
        "graph/pruning_log.tsv": table(("node", "reason"), [(x, "pruned") for x in trace["graph"]["pruned"]]),
        "quantification/nnls_matrix.tsv": table(("kmer", *[f"path_{i}" for i in range(len(routes))]), [(x, *row) for x, row in zip(kmers, matrix.tolist())]),
        "quantification/coefficients.json": json.dumps(numbers["coefficients"], indent=2),
        "quantification/rvaf_calculation.json": json.dumps({"coefficients": numbers["coefficients"], "sum_coefficients": sum(numbers["coefficients"]), "rvafs": numbers["rvafs"], "min_coverages": numbers["min_coverages"]}, indent=2),
    }
    if level == "full":
        flip = str.maketrans("ACGT", "TGCA")
        middle = sorted(count(x) for x in reference)[len(reference) // 2]
        out |= {
            "kmers/ref_kmers.tsv": table(("kmer", "canonical", "db_count", "expected_count"), [(x, min(x, x.translate(flip)[::-1]), count(x), middle) for x in reference]),
            "kmers/alt_kmers.tsv": table(("kmer", "db_count", "path_id"), [(x, count(x), i) for i, (p, _) in enumerate(routes) for x in p if i and x not in known]),
            "kmers/missing_kmers.tsv": table(("kmer", "expected_in", "reason"), [(x, "reference", "not in the table") for x in reference if not count(x)]),
            "kmers/coverage_profile.tsv": table(("position", "count"), [(i, count(x)) for i, x in enumerate(reference)]),
        }
    return out


def documents(targets: DataFrame, kmers: DataFrame, k: int, document: Callable[..., str | dict]) -> DataFrame:
    """sample, target, path, text: what `document` makes of each sample and target, in the tasks.

    document gets sample, target, sequence, k and the counts; it returns a text or texts by path.
    """

    def work(jobs: list[tuple]) -> pd.DataFrame:
        rows = []
        for job in jobs:
            if len(job[2]) >= k:
                made = document(*job)
                rows += [(job[0], job[1], path, text) for path, text in (made.items() if isinstance(made, dict) else [("", made)])]
        return pd.DataFrame(rows, columns=["sample", "target", "path", "text"])

    return over_targets(targets, kmers, k, work, "sample string, target string, path string, text string")


def write_traces(targets: DataFrame, kmers: DataFrame, k: int, o: DetectOptions, folder: str, sample: str) -> dict[str, int]:
    """A file for each target and a summary of outcomes in a local folder. The tasks make the texts; the driver writes one after another."""
    os.makedirs(f"{folder}/targets", exist_ok=True)
    found = documents(targets, kmers.filter(F.col("sample") == sample), k, lambda *job: json.dumps(trace_target(*job, o), indent=2))
    outcomes: dict[str, int] = {}
    for r in found.toLocalIterator():
        outcome = json.loads(r["text"])["outcome"]
        outcomes[outcome] = outcomes.get(outcome, 0) + 1
        with open(f"{folder}/targets/{safe(r['target'])}.json", "w", encoding="utf-8") as file:
            file.write(r["text"] + "\n")
    write_json({"targets": sum(outcomes.values()), "outcomes": outcomes}, f"{folder}/summary.json")
    return outcomes


def outcome_counts(found: DataFrame) -> DataFrame:
    """outcome, n_targets of what `detect.attempts` returns."""
    return found.groupBy("outcome").agg(F.countDistinct("sample", "target").alias("n_targets"))


def decision(result_type: str, variants: list[dict]) -> str:
    """Why a target's result is what it is, in a few lines."""
    if not variants:
        return "Reference only -- no variant branches found"
    lines = [f"Detected {v['variant_type']}" + (f" {v['variant_name']}" if v["variant_name"] else "") + f", rVAF={v['rvaf']:.4f}, coverage={v['min_coverage']}" for v in variants]
    return lines[0] if len(lines) == 1 else f"Multiple variants detected ({len(lines)} {result_type}):\n" + "\n".join(lines)


def with_traces(rows: DataFrame, calls: DataFrame, traces: DataFrame | None) -> DataFrame:
    """A detection summary with each target's `variants` and what its walk and graph saw (n_ref_kmers, n_walked_kmers, n_graph_nodes; 0 without a trace).

    traces is what `detect.attempts` returns, nodes being counted before pruning.
    """
    own = F.struct(F.col("type").alias("variant_type"), "variant_name", F.col("rVAF").alias("rvaf"), "min_coverage", F.coalesce("ref_allele", F.lit("")).alias("ref_allele"), F.coalesce("alt_allele", F.lit("")).alias("alt_allele"))
    variants = calls.filter("type <> 'Reference'").groupBy("target").agg(F.array_sort(F.collect_list(own)).alias("variants"))
    out = rows.join(variants, "target", "left")
    seen = ["n_ref_kmers", "n_walked_kmers", "n_graph_nodes"]
    if traces is None:
        return out.withColumns({c: F.lit(0) for c in seen})
    size = F.length("ref_sequence") - F.col("k") + 1
    per_target = traces.groupBy("target").agg(F.max(size).alias(seen[0]), F.max("nodes").alias(seen[1]), F.max(F.col("nodes") - F.col("removed")).alias(seen[2]))
    return out.join(per_target, "target", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in seen})


def write_run_report(calls: DataFrame, folder: str, order: list[str], level: str = "summary", traces: DataFrame | None = None, files: DataFrame | None = None) -> None:
    """run_summary.json and detection_summary.tsv; from `standard` each target's result.json and decision.txt, joined with traces.

    From `detailed` each target has the parts walking, graph and quantification, in `full`
    also its k-mers: files is what `documents` makes of `details`.
    """
    if level not in LEVELS:
        raise ValueError(f"levels are {', '.join(LEVELS)}")
    if level in LEVELS[2:] and files is None:
        raise ValueError(f"the level {level} needs the targets' files")
    os.makedirs(folder, exist_ok=True)
    summary = metrics.summary(calls).first().asDict()
    write_json(summary, f"{folder}/run_summary.json")
    rows = metrics.detection_summary(calls, order).orderBy("target")
    cells = [F.col("target"), F.col("result_type"), F.format_string("%.6f", "rvaf").alias("rvaf"), *[F.col(c).cast("string").alias(c) for c in ("coverage", "n_paths", "n_variants")]]
    write_table(rows, cells, f"{folder}/detection_summary.tsv")
    if level == "summary":
        return
    for r in with_traces(rows, calls, traces).toLocalIterator():
        own = f"{folder}/targets/{safe(r['target'])}"
        os.makedirs(own, exist_ok=True)
        variants = [v.asDict() for v in r["variants"] or ()]
        text = decision(r["result_type"], variants)
        write_json(r.asDict() | {"variants": variants, "decision_text": text}, f"{own}/result.json")
        with open(f"{own}/decision.txt", "w", encoding="utf-8") as file:
            file.write(text + "\n")
    for r in files.toLocalIterator() if level in LEVELS[2:] else ():
        path = f"{folder}/targets/{safe(r['target'])}/{r['path']}"
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8") as file:
            file.write(r["text"])


def shown(x: float | None) -> str:
    return "N/A" if x is None or x != x else f"{x:.4f}"


def benchmark_report(truth: DataFrame, calls: DataFrame, bounds: list[float], thresholds: list[float] = ()) -> dict:
    """Confusion, metrics, types, bins and sweep as a document; empty denominators are null."""
    overall = metrics.confusion(truth, calls).first().asDict()
    rows = lambda df, *order: [r.asDict() for r in df.orderBy(*order).collect()]  # noqa: E731  as few rows as types, bins or thresholds
    out = {"overall": overall, "by_type": rows(metrics.by_type(truth, calls), "variant_type"), "by_vaf": rows(metrics.by_vaf_bin(truth, calls, bounds), "bin_low")}
    if thresholds:
        out["sweep"] = rows(metrics.sweep(truth, calls, thresholds), "threshold")
    return out


def benchmark_text(report: dict) -> str:
    o = report["overall"]
    out = ["Benchmark", f"TP {o['tp']:>8}  FP {o['fp']:>8}", f"FN {o['fn']:>8}  TN {o['tn']:>8}", ""]
    out += [f"{n:<12} {shown(o[n]):>8}" for n in ("sensitivity", "specificity", "precision", "npv", "f1", "accuracy")]
    out += ["", f"{'type':<14}{'total':>8}{'found':>8}{'sensitivity':>13}"]
    out += [f"{r['variant_type']:<14}{r['total']:>8}{r['detected']:>8}{shown(r['sensitivity']):>13}" for r in report["by_type"]]
    out += ["", f"{'VAF':<18}{'total':>8}{'found':>8}{'sensitivity':>13}"]
    out += [f"{r['bin_low']:g}-{r['bin_high']:g}".ljust(18) + f"{r['total']:>8}{r['detected']:>8}{shown(r['sensitivity']):>13}" for r in report["by_vaf"]]
    if "sweep" in report:
        out += ["", f"{'threshold':<12}{'sensitivity':>13}{'precision':>11}{'f1':>9}"]
        out += [f"{r['threshold']:<12g}{shown(r['sensitivity']):>13}{shown(r['precision']):>11}{shown(r['f1']):>9}" for r in report["sweep"]]
    return "\n".join(out) + "\n"


def filter_report(rows: DataFrame, o: FilterOptions) -> dict:
    """Summary, criteria, near misses and scaled bars of a filter's result as a document."""
    listed = lambda df, *order: [r.asDict() for r in df.orderBy(*order).collect()]  # noqa: E731  as few rows as expected variants
    return {
        "summary": metrics.filter_summary(rows).first().asDict(),
        "criteria": listed(metrics.by_criterion(rows), "criterion"),
        "near_misses": listed(metrics.near_misses(rows, o), "chrom", "pos", "criterion"),
        "variants": listed(metrics.variant_details(rows), "chrom", "pos"),
        "sensitivity": listed(metrics.threshold_sensitivity(rows, o), "multiplier"),
    }


def filter_text(report: dict) -> str:
    s = report["summary"]
    out = [f"{s['found']} of {s['total_expected']} expected variants found ({100 * s['detection_rate']:.1f}%)", f"not detected: {s['not_detected']}, detected but filtered: {s['detected_but_filtered']}", ""]
    out += [f"{r['criterion']}: {r['rejected_any']} rejected, {r['rejected_alone']} by it alone" for r in report["criteria"]]
    out += [f"near miss {r['chrom']}:{r['pos']} {r['criterion']} {r['observed_value']:g} of {r['threshold']:g}" for r in report["near_misses"]]
    out += [f"bars {r['label']}: {r['found']} found ({100 * r['detection_rate']:.1f}%)" for r in report["sensitivity"]]
    return "\n".join(out) + "\n"
