"""Variant detection: walks, graphs, paths, quantities and confidence for every sample and target."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .. import schemas
from . import consensus, filters, kmer_index, kmer_tables, local, variants, walk

#: A task holds the rows of so many samples and targets before it passes them on.
JOBS = 16


@dataclass(frozen=True)
class DetectOptions:
    walk: local.WalkOptions = field(default_factory=local.WalkOptions)
    prune: local.PruneOptions | None = field(default_factory=local.PruneOptions)
    bootstrap: local.BootstrapOptions | None = None
    adaptive: bool = False
    cluster: bool = False
    deduplicate: bool = True
    min_qual: float = 0.0
    min_rvaf: float = 0.0
    min_cov: int = 0


def detect_target(sample: str, target: str, sequence: str, k: int, count: local.Count, o: DetectOptions) -> tuple[list[dict], dict]:
    """Calls of one target in one sample, and what led to them."""
    sequence = sequence.upper()
    if len(sequence) < k:
        raise ValueError(f"target {target} has {len(sequence)} bases, fewer than k = {k}")
    reference = [sequence[i : i + k] for i in range(len(sequence) - k + 1)]
    steps = local.walk_both if o.walk.bidirectional else local.walk
    nodes = steps(reference, count, o.walk)
    graph = local.build_graph(nodes, reference)
    seen = {"nodes": len(nodes), "reference_nodes": len(set(reference)), "edges": len(graph.edges()), "branching": sum(len(v) > 1 for v in graph.out.values())}
    seen["removed"] = local.prune(graph, o.prune) if o.prune else 0
    routes = local.paths(graph, count)
    seen["paths"] = len(routes)
    if len(routes) < 2:
        counts = [count(x) for x in reference]
        seen["outcome"] = "reference_only" if routes else "no_paths"
        own = dict(type="Reference", variant_name="", rVAF=1.0, expression=sum(counts) / len(counts), min_coverage=min(counts), path_score=min(counts), start_kmer_count=counts[0], ref_sequence=sequence, alt_sequence=sequence)
        return [dict(sample=sample, target=target, info="vs_ref", **own)], seen
    seen["outcome"] = "variant_detected"
    only = [p for p, _ in routes]
    coefficients, share, least = local.quantify(only, count)
    intervals = local.bootstrap(only, count, o.bootstrap) if o.bootstrap else []
    error = local.error_rate(reference, count)
    calls = []
    base = local.spell(only[0])
    for i, (path, score) in enumerate(routes):
        alt = local.spell(path)
        kind, name, old, new, _, _ = local.classify(base, alt)
        own = dict(sample=sample, target=target, type=kind, variant_name=name, rVAF=float(share[i]), expression=float(coefficients[i]), min_coverage=least[i], start_kmer_count=count(path[0]), ref_sequence=base, alt_sequence=alt, info="vs_ref", ref_allele=old, alt_allele=new, path_score=score)
        if i:
            p = local.variant_pvalue(path, only[0], count, error)
            own |= dict(pvalue=p, qual=local.phred(p))
        if intervals:
            own |= dict(ci_lower=intervals[i][0], ci_upper=intervals[i][1])
        calls.append(own)
    return calls, seen


_names = [x.split()[0] for x in schemas.CALLS_IN_MEMORY.split(", ")]
OUTCOME = schemas.CALLS_IN_MEMORY + ", k int, error string, outcome string, nodes int, edges int, branching int, removed int, paths int"


def _rows(jobs: Iterator[tuple], o: DetectOptions) -> pd.DataFrame:
    out = []
    for sample, target, sequence, k, count, thresholds in jobs:
        own = replace(o, walk=replace(o.walk, count=thresholds[0], ratio=thresholds[1])) if thresholds else o
        try:
            calls, seen = detect_target(sample, target, sequence, k, count, own)
            seen.pop("reference_nodes")
            out += [{**dict.fromkeys(_names), **c, "k": k, "error": None, **seen} for c in calls]
        except ValueError as e:  # such a target has no calls; others go on
            out.append({**dict.fromkeys(_names), "sample": sample, "target": target, "k": k, "error": str(e)})
    columns = [x.split()[0] for x in OUTCOME.split(", ")]
    frame = pd.DataFrame(out, columns=columns)
    for c in ("min_coverage", "start_kmer_count", "pos", "path_score", "k", "nodes", "edges", "branching", "removed", "paths"):
        frame[c] = frame[c].astype("Int64")
    return frame


def thresholds_of(targets: DataFrame, kmers: DataFrame, k: int, o: DetectOptions, sampled_targets: int = 10) -> tuple[int, float] | None:
    """Count and ratio for adaptive walks from the first targets' k-mers; thresholds that were set stay."""
    default = local.WalkOptions()
    if not o.adaptive or o.walk.count != default.count or o.walk.ratio != default.ratio:
        return None
    first = targets.orderBy("target").limit(sampled_targets)
    reference = kmer_tables.target_kmers(first, k).withColumn("g", F.lit(1))
    row = walk.adaptive_thresholds(reference, kmers.groupBy("kmer").agg(F.max("count").alias("count")), [], ["g"], ["target", "pos"]).first()
    return (row["count_threshold"], row["ratio_threshold"]) if row else None


def over_targets(targets: DataFrame, kmers: DataFrame, k: int, work: Callable[[list[tuple]], pd.DataFrame], schema: str, part_rows: int = kmer_index.PART_ROWS) -> DataFrame:
    """work's rows for all samples and targets; it gets lists of (sample, target, sequence, k, count), count being a function.

    The k-mer table is packed into parts (`kmer_index`), and a task has a range of samples
    and targets, loading the parts that its walks come through. The plan is the same for
    tables of any size.
    """
    spark = targets.sparkSession
    index = kmer_index.built(kmers.select("sample", "kmer", "count"), k, part_rows)
    jobs = targets.select("target", "sequence").join(index, F.lit(True)).select("sample", "target", "sequence", "n_parts", "parts")
    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    # ranges keep a sample's targets together, and split a sample with many
    jobs = jobs.repartitionByRange(spread, "sample", "target").sortWithinPartitions("sample", "target")

    def search(frames):
        name, parts = None, None
        for frame in frames:
            own = []
            for sample, target, sequence, n, files in zip(*[frame[c] for c in ("sample", "target", "sequence", "n_parts", "parts")]):
                if parts is None or name != sample:
                    name, parts = sample, kmer_index.Parts(k, n, {p["part"]: p["file"] for p in files})
                own.append((sample, target, sequence, k, parts.lookup()))
                if len(own) == JOBS:
                    yield work(own)
                    own = []
            if own:
                yield work(own)

    return jobs.mapInPandas(search, schema)


def attempts(targets: DataFrame, kmers: DataFrame, k: int, o: DetectOptions = DetectOptions(), part_rows: int = kmer_index.PART_ROWS) -> DataFrame:
    """Calls of all samples and targets with k, error and counts of what was searched; targets that fail have a row with an error."""
    thresholds = thresholds_of(targets, kmers, k, o)
    return over_targets(targets, kmers, k, lambda jobs: _rows(((*job, thresholds) for job in jobs), o), OUTCOME, part_rows)


def finished(found: DataFrame, o: DetectOptions) -> DataFrame:
    """Calls of attempts after clustering, de-duplication and reporting bars."""
    calls = found.filter("error is null").select(*_names)
    if o.cluster:
        calls = variants.with_clusters(calls)
    if o.deduplicate:
        calls = variants.deduplicated(calls, ["variant_name", "alt_sequence"])
    return filters.reporting(calls, o.min_qual, o.min_rvaf, o.min_cov)


def detect(targets: DataFrame, kmers: DataFrame, k: int, o: DetectOptions = DetectOptions(), **more) -> DataFrame:
    return finished(attempts(targets, kmers, k, o, **more), o)


def detect_multi_k(targets: DataFrame, kmers: DataFrame, ks: list[int], o: DetectOptions = DetectOptions()) -> DataFrame:
    """Consensus of detection at several odd k (5 to 127); kmers has a column k with a table for each."""
    if not ks or any(k % 2 == 0 or not 5 <= k <= 127 for k in ks):
        raise ValueError("k must be odd and from 5 to 127")
    calls = None
    for k in ks:
        own = detect(targets, kmers.filter(F.col("k") == k), k, replace(o, deduplicate=False)).withColumn("k", F.lit(k))
        calls = own if calls is None else calls.unionByName(own)
    return consensus.merged(calls, ks)
