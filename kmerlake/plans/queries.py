"""Registered queries of the library's own operators over the general test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .. import storage
from ..functions import kmers as K
from ..functions import sequence as S
from ..operators import consensus, detect, filters, graph, kmer_tables, merge, metrics, variants, walk
from . import bridge
from .bridge import CALLS_SQL, DNA_SQL, TARGETS_SQL, TRUTH_SQL, WALK_K

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}
SHORT = bridge.K
OPTIONS = filters.FilterOptions(min_coverage=10, min_vaf=0.03, min_expression=12.0, types=("Substitution", "Insertion", "Deletion"))


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# K-mers

_KMERS = f"{DNA_SQL}, km AS (SELECT sample, target, i - 1 AS pos, substr(sequence, i, {{k}}) AS kmer FROM (SELECT *, unnest(range(1, length(sequence) - {{k}} + 2)) AS i FROM dna WHERE length(sequence) >= {{k}}))"
_REV = "reverse(translate(kmer, 'ACGT', 'TGCA'))"
_COUNTS = _KMERS.replace("{k}", str(WALK_K)) + ", kmers AS (SELECT sample, kmer, count(*) AS count FROM km GROUP BY 1, 2)"
_TARGET_KMERS = f"tk AS (SELECT target, i - 1 AS pos, substr(sequence, i, {WALK_K}) AS kmer FROM (SELECT *, unnest(range(1, length(sequence) - {WALK_K} + 2)) AS i FROM targets))"
_WALK = _COUNTS.replace(DNA_SQL, TARGETS_SQL) + ", " + _TARGET_KMERS


def read_kmers(spark: SparkSession, sf_dir: str, k: int = WALK_K, by: tuple[str, ...] = ("sample",)) -> DataFrame:
    return kmer_tables.count_kmers(bridge.dna(spark, sf_dir), k, by)


@query(f"WITH {_KMERS.format(k=SHORT)} SELECT kmer, count(*) AS n, count(DISTINCT target) AS n_targets FROM km GROUP BY 1")
def kmer_decompose(spark, sf_dir):
    rows = bridge.dna(spark, sf_dir).filter(F.length("sequence") >= SHORT).select("target", F.explode(K.decompose("sequence", SHORT)).alias("kmer"))
    return rows.groupBy("kmer").agg(F.count("*").alias("n"), F.countDistinct("target").alias("n_targets"))


@query(f"WITH {_KMERS.format(k=7)} SELECT DISTINCT kmer, {_REV} AS revcomp, least(kmer, {_REV}) AS canonical FROM km")
def kmer_revcomp_canonical(spark, sf_dir):
    rows = kmer_tables.count_kmers(bridge.dna(spark, sf_dir), 7, ())
    return rows.select("kmer", K.reverse_complement("kmer").alias("revcomp"), K.canonical("kmer").alias("canonical"))


@query(f"WITH {_KMERS.format(k=SHORT)}, d AS (SELECT DISTINCT kmer FROM km) SELECT kmer, {' + '.join(f'(position(substr(kmer, {i + 1}, 1) IN {chr(39)}ACGT{chr(39)}) - 1) * {4 ** (SHORT - 1 - i)}' for i in range(SHORT))} AS packed, kmer AS decoded FROM d")
def kmer_encode_long(spark, sf_dir):
    rows = kmer_tables.count_kmers(bridge.dna(spark, sf_dir), SHORT, ())
    return rows.select("kmer", K.encode("kmer").alias("packed"), K.decode(K.encode("kmer"), SHORT).alias("decoded"))


@query(f"WITH {_KMERS.format(k=7)} SELECT sample, least(kmer, {_REV}) AS kmer, count(*) AS count FROM km GROUP BY 1, 2 HAVING count(*) >= 2")
def kmer_count(spark, sf_dir):
    return kmer_tables.count_kmers(bridge.dna(spark, sf_dir), 7, ("sample",), canonical=True, min_count=2).drop("k")


@query(f"WITH {_WALK}, s AS (SELECT DISTINCT sample FROM kmers) SELECT s.sample, tk.target, tk.pos, tk.kmer, coalesce(k.count, 0) AS count FROM tk CROSS JOIN s LEFT JOIN kmers k ON k.sample = s.sample AND k.kmer = tk.kmer")
def kmer_lookup(spark, sf_dir):
    kmers = read_kmers(spark, sf_dir)
    own = kmer_tables.target_kmers(bridge.targets(spark, sf_dir), WALK_K).join(kmers.select("sample").distinct(), F.lit(True))
    return kmer_tables.lookup(own, kmers, ["sample", "kmer"]).select("sample", "target", "pos", "kmer", "count")


@query(
    f"""WITH {_WALK}, s AS (SELECT DISTINCT sample FROM kmers),
    c AS (SELECT s.sample, tk.target, coalesce(k.count, 0) AS c FROM tk CROSS JOIN s LEFT JOIN kmers k ON k.sample = s.sample AND k.kmer = tk.kmer)
    SELECT sample, target, count(*) AS num_kmers, round(avg(c), 6) AS mean_coverage, quantile_cont(c, 0.5)::DOUBLE AS median_coverage, min(c) AS min_coverage, max(c) AS max_coverage,
    round(stddev_pop(c), 6) AS stdev, round(CASE WHEN avg(c) = 0 THEN 0 ELSE stddev_pop(c) / avg(c) END, 6) AS cv FROM c GROUP BY 1, 2"""
)
def coverage_stats(spark, sf_dir):
    out = kmer_tables.coverage_stats(bridge.targets(spark, sf_dir), read_kmers(spark, sf_dir), WALK_K, ["sample"])
    return rounded(out, "mean_coverage", "stdev", "cv")


@query(f"WITH {_KMERS.format(k=WALK_K)}, one AS (SELECT target, list(kmer ORDER BY pos) AS p FROM km GROUP BY target) SELECT target, len(p) AS n_kmers, p[1] || array_to_string(list_transform(p[2:], lambda x: right(x, 1)), '') AS spelled FROM one")
def path_sequence(spark, sf_dir):
    rows = bridge.dna(spark, sf_dir).filter(F.length("sequence") >= WALK_K).select("target", K.decompose("sequence", WALK_K).alias("path"))
    return rows.select("target", K.path_length("path").cast("long").alias("n_kmers"), K.path_sequence("path").alias("spelled"))


# Walks


def _extension_sql(part: str) -> str:
    return f"WITH {_COUNTS}, t AS (SELECT *, sum(count) OVER (PARTITION BY sample, {part})::BIGINT AS total FROM kmers) SELECT sample, kmer, count, total, count >= greatest(2, floor(total * CAST(0.05 AS DOUBLE))::BIGINT) AS accepted FROM t"


@query(_extension_sql(f"left(kmer, {WALK_K - 1})"))
def extension_forward(spark, sf_dir):
    return walk.extensions(read_kmers(spark, sf_dir)).select("sample", "kmer", "count", "total", "accepted")


@query(_extension_sql(f"right(kmer, {WALK_K - 1})"))
def extension_backward(spark, sf_dir):
    return walk.extensions(read_kmers(spark, sf_dir), "backward").select("sample", "kmer", "count", "total", "accepted")


def _reach_sql(direction: str) -> str:
    n = WALK_K - 1
    mine, theirs = (f"right(r.kmer, {n})", f"left(kmer, {n})") if direction == "forward" else (f"left(r.kmer, {n})", f"right(kmer, {n})")
    return f"""acc_{direction} AS (SELECT sample, kmer, g FROM (SELECT *, {theirs} AS g, sum(count) OVER (PARTITION BY sample, {theirs}) AS total FROM kmers) WHERE count >= greatest(2, floor(total * CAST(0.05 AS DOUBLE)))),
    {direction} AS (SELECT s.sample, tk.target, tk.kmer FROM tk CROSS JOIN (SELECT DISTINCT sample FROM kmers) s
        UNION SELECT r.sample, r.target, a.kmer FROM {direction} r JOIN acc_{direction} a ON a.sample = r.sample AND a.g = {mine})"""


_NODES = "SELECT w.sample, w.target, w.kmer, coalesce(k.count, 0) AS count, EXISTS (SELECT 1 FROM tk WHERE tk.target = w.target AND tk.kmer = w.kmer) AS is_reference FROM {w} w LEFT JOIN kmers k ON k.sample = w.sample AND k.kmer = w.kmer"


@query(f"WITH RECURSIVE {_WALK}, {_reach_sql('forward')} {_NODES.format(w='forward')}")
def walk_reachability(spark, sf_dir):
    return walk.reach(bridge.targets(spark, sf_dir), read_kmers(spark, sf_dir), WALK_K)


@query(f"WITH RECURSIVE {_WALK}, {_reach_sql('forward')}, {_reach_sql('backward')}, both_ways AS (SELECT * FROM forward UNION SELECT * FROM backward) {_NODES.format(w='both_ways')}")
def walk_bidirectional(spark, sf_dir):
    return walk.reach_both(bridge.targets(spark, sf_dir), read_kmers(spark, sf_dir), WALK_K)


_POOLED = f"{_WALK}, pooled AS (SELECT kmer, sum(count)::BIGINT AS count FROM kmers GROUP BY 1), ext AS (SELECT left(kmer, {WALK_K - 1}) AS g, sum(count)::BIGINT AS s, max(count) AS m FROM pooled GROUP BY 1)"


@query(f"WITH {_POOLED} SELECT tk.target, round(sum(coalesce(e.s, 0) - coalesce(e.m, 0)) / (3.0::DOUBLE * sum(p.count)), 9) AS error_rate FROM tk JOIN pooled p USING (kmer) LEFT JOIN ext e ON e.g = right(tk.kmer, {WALK_K - 1}) GROUP BY 1")
def error_rate_walker(spark, sf_dir):
    pooled = read_kmers(spark, sf_dir, by=())
    reference = kmer_tables.lookup(kmer_tables.target_kmers(bridge.targets(spark, sf_dir), WALK_K), pooled)
    return walk.error_rate_of_walk(reference, pooled, [], ["target"]).withColumn("error_rate", F.round("error_rate", 9))


@query(
    f"""WITH {_POOLED}, n AS (SELECT *, lead(kmer) OVER (PARTITION BY target ORDER BY pos) AS nxt FROM tk),
    r AS (SELECT n.target, e.s, e.s - coalesce(p.count, 0) AS wrong FROM n JOIN ext e ON e.g = right(n.kmer, {WALK_K - 1}) LEFT JOIN pooled p ON p.kmer = right(n.kmer, {WALK_K - 1}) || right(n.nxt, 1) WHERE nxt IS NOT NULL AND e.s > 0),
    g AS (SELECT target, count(*) AS c, sum(wrong) AS w, sum(s) AS t FROM r GROUP BY 1)
    SELECT d.target, round(CASE WHEN coalesce(c, 0) < 10 THEN CAST(0.001 AS DOUBLE) ELSE least(CAST(0.1 AS DOUBLE), greatest(CAST(1e-6 AS DOUBLE), w / t)) END, 9) AS error_rate FROM (SELECT DISTINCT target FROM tk) d LEFT JOIN g USING (target)"""
)
def error_rate_confidence(spark, sf_dir):
    pooled = read_kmers(spark, sf_dir, by=())
    reference = kmer_tables.target_kmers(bridge.targets(spark, sf_dir), WALK_K)
    return walk.error_rate_of_extensions(reference, pooled, [], ["target"]).withColumn("error_rate", F.round("error_rate", 9))


@query(
    f"""WITH {_POOLED}, nn AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY pos) - 1 AS i, greatest(count(*) OVER (PARTITION BY target) // 100, 1) AS step FROM tk),
    c AS (SELECT nn.target, nn.kmer, coalesce(p.count, 0) AS count FROM nn LEFT JOIN pooled p USING (kmer) WHERE i % step = 0 AND i // step < 100),
    med AS (SELECT target, quantile_cont(count, 0.5)::DOUBLE AS median_coverage FROM c GROUP BY 1),
    er AS (SELECT c.target, sum(coalesce(e.s, 0) - coalesce(e.m, 0)) / (3.0::DOUBLE * sum(c.count)) AS e FROM c LEFT JOIN ext e ON e.g = right(c.kmer, {WALK_K - 1}) WHERE c.count > 0 GROUP BY 1),
    j AS (SELECT target, median_coverage, CASE WHEN coalesce(e, 0) > 0 THEN e ELSE CAST(0.001 AS DOUBLE) END AS error_rate FROM med LEFT JOIN er USING (target)),
    t AS (SELECT *, CASE WHEN floor(median_coverage) < 500 THEN 'UltraLow' WHEN floor(median_coverage) < 2000 THEN 'Standard' WHEN floor(median_coverage) < 10000 THEN 'HighDepth' ELSE 'UltraDeep' END AS tier, median_coverage * error_rate AS l FROM j)
    SELECT target, median_coverage, round(error_rate, 9) AS error_rate, tier, greatest(2, ceil(l + CAST(2.33 AS DOUBLE) * sqrt(l)))::INTEGER AS count_threshold,
    CASE tier WHEN 'UltraLow' THEN CAST(0.1 AS DOUBLE) WHEN 'Standard' THEN CAST(0.05 AS DOUBLE) WHEN 'HighDepth' THEN CAST(0.03 AS DOUBLE) ELSE CAST(0.01 AS DOUBLE) END AS ratio_threshold FROM t"""
)
def adaptive_thresholds(spark, sf_dir):
    pooled = read_kmers(spark, sf_dir, by=())
    reference = kmer_tables.target_kmers(bridge.targets(spark, sf_dir), WALK_K)
    return walk.adaptive_thresholds(reference, pooled, [], ["target"], ["pos"]).withColumn("error_rate", F.round("error_rate", 9))


# Graphs: nodes are the reads' k-mers that lie in targets or next to them


def _graph_nodes(spark, sf_dir) -> DataFrame:
    """target, kmer, count, is_reference: reference k-mers and their accepted extensions, over all samples."""
    pooled = read_kmers(spark, sf_dir, by=())
    reference = kmer_tables.target_kmers(bridge.targets(spark, sf_dir), WALK_K)
    own = kmer_tables.lookup(reference.select("target", "kmer").distinct(), pooled).withColumn("is_reference", F.lit(True))
    taken = walk.extensions(pooled, by=[]).filter("accepted").select(K.prefix("kmer").alias("g"), F.col("kmer").alias("next"), "count")
    near = own.select("target", K.suffix("kmer").alias("g")).distinct().join(taken, "g").select("target", F.col("next").alias("kmer"), "count").distinct()
    return own.unionByName(near.join(own, ["target", "kmer"], "left_anti").withColumn("is_reference", F.lit(False)))


_GRAPH = f"""{_POOLED}, own AS (SELECT DISTINCT tk.target, tk.kmer, coalesce(p.count, 0) AS count, true AS is_reference FROM tk LEFT JOIN pooled p USING (kmer)),
    acc AS (SELECT * FROM (SELECT kmer, count, left(kmer, {WALK_K - 1}) AS g, sum(count) OVER (PARTITION BY left(kmer, {WALK_K - 1})) AS total FROM pooled) WHERE count >= greatest(2, floor(total * CAST(0.05 AS DOUBLE)))),
    nodes AS (SELECT * FROM own UNION ALL SELECT DISTINCT o.target, a.kmer, a.count, false FROM own o JOIN acc a ON a.g = right(o.kmer, {WALK_K - 1}) WHERE NOT EXISTS (SELECT 1 FROM own x WHERE x.target = o.target AND x.kmer = a.kmer)),
    edges AS (SELECT a.target, a.kmer AS src, b.kmer AS dst, a.is_reference AND b.is_reference AS is_reference FROM nodes a JOIN nodes b ON a.target = b.target AND right(a.kmer, {WALK_K - 1}) = left(b.kmer, {WALK_K - 1}) AND a.kmer <> b.kmer)"""
_ENDS = f"""fl AS (SELECT target, min_by(kmer, pos) AS f, max_by(kmer, pos) AS l FROM tk GROUP BY 1),
    ends AS (SELECT n.target, 'BigBang' AS src, n.kmer AS dst, n.is_reference FROM nodes n JOIN fl USING (target) WHERE left(n.kmer, {WALK_K - 1}) = left(f, {WALK_K - 1})
        UNION ALL SELECT n.target, n.kmer, 'BigCrunch', n.is_reference FROM nodes n JOIN fl USING (target) WHERE right(n.kmer, {WALK_K - 1}) = right(l, {WALK_K - 1})),
    alledges AS (SELECT * FROM edges UNION ALL SELECT * FROM ends)"""
_W = "CASE WHEN is_reference THEN CAST(0.01 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS weight"


@query(f"WITH {_GRAPH} SELECT *, {_W} FROM edges")
def debruijn_edges(spark, sf_dir):
    return graph.edges(_graph_nodes(spark, sf_dir), ["target"])


@query(f"WITH {_GRAPH}, {_ENDS} SELECT *, {_W} FROM ends")
def graph_end_edges(spark, sf_dir):
    reference = kmer_tables.target_kmers(bridge.targets(spark, sf_dir), WALK_K)
    return graph.end_edges(_graph_nodes(spark, sf_dir), reference, ["target"])


@query(
    f"""WITH RECURSIVE {_GRAPH}, {_ENDS}, ahead AS (SELECT target, 'BigBang' AS node FROM fl UNION SELECT e.target, e.dst FROM ahead a JOIN alledges e ON e.target = a.target AND e.src = a.node),
    back AS (SELECT target, 'BigCrunch' AS node FROM fl UNION SELECT e.target, e.src FROM back a JOIN alledges e ON e.target = a.target AND e.dst = a.node)
    SELECT n.* FROM nodes n JOIN ahead a ON a.target = n.target AND a.node = n.kmer JOIN back b ON b.target = n.target AND b.node = n.kmer"""
)
def graph_dead_ends(spark, sf_dir):
    folder = storage.new_folder(spark, "graph")
    nodes = storage.written(_graph_nodes(spark, sf_dir), f"{folder}/nodes")
    reference = kmer_tables.target_kmers(bridge.targets(spark, sf_dir), WALK_K)
    links = graph.edges(nodes, ["target"]).union(graph.end_edges(nodes, reference, ["target"]))
    links = storage.written(links, f"{folder}/links")
    return graph.without_dead_ends(nodes, links, ["target"])


_BARS = "bars AS (SELECT target, coalesce(max(count) FILTER (WHERE i = n // 2), 0) AS upper_median FROM (SELECT target, count, row_number() OVER (PARTITION BY target ORDER BY count, kmer) - 1 AS i, count(*) OVER (PARTITION BY target) AS n FROM own) GROUP BY 1), lim AS (SELECT target, upper_median, greatest(2, ceil(upper_median * CAST(0.001 AS DOUBLE)))::INTEGER AS min_count FROM bars)"


@query(f"WITH {_GRAPH}, {_BARS} SELECT * FROM lim")
def graph_min_counts(spark, sf_dir):
    return graph.least_counts(_graph_nodes(spark, sf_dir), by=["target"])


@query(f"WITH {_GRAPH}, {_BARS} SELECT n.* FROM nodes n JOIN lim USING (target) WHERE n.is_reference OR n.count >= lim.min_count")
def graph_low_coverage(spark, sf_dir):
    nodes = _graph_nodes(spark, sf_dir)
    return graph.without_low_counts(nodes, graph.least_counts(nodes, by=["target"]), by=["target"])


@query(f"WITH {_GRAPH}, {_BARS} SELECT n.* FROM nodes n JOIN bars USING (target) WHERE n.is_reference OR n.count >= ceil(upper_median * CAST(0.1 AS DOUBLE))")
def graph_thin_bubbles(spark, sf_dir):
    nodes = _graph_nodes(spark, sf_dir)
    bars = graph.least_counts(nodes, by=["target"]).withColumn("bar", F.ceil(F.col("upper_median") * F.lit(0.10)))
    return graph.without_low_counts(nodes, bars, "bar", ["target"])


@query()
def detect_calls(spark, sf_dir):
    return detect.detect(bridge.targets(spark, sf_dir), read_kmers(spark, sf_dir), WALK_K)


@query()
def detect_outcomes(spark, sf_dir):
    found = detect.attempts(bridge.targets(spark, sf_dir), read_kmers(spark, sf_dir), WALK_K)
    return found.groupBy("outcome").agg(F.countDistinct("sample", "target").alias("n_targets"))


@query(
    f"""WITH {_WALK}, s AS (SELECT DISTINCT sample FROM kmers), acc AS (SELECT sample, kmer, left(kmer, {WALK_K - 1}) AS g FROM (SELECT *, sum(count) OVER (PARTITION BY sample, left(kmer, {WALK_K - 1})) AS total FROM kmers) WHERE count >= greatest(2, floor(total * CAST(0.05 AS DOUBLE)))),
    branched AS (SELECT DISTINCT a.sample, tk.target FROM tk JOIN acc a ON a.g = right(tk.kmer, {WALK_K - 1}) WHERE NOT EXISTS (SELECT 1 FROM tk x WHERE x.target = tk.target AND x.kmer = a.kmer))
    SELECT s.sample, tk.target, 'Reference' AS type, round(avg(coalesce(k.count, 0)), 6) AS expression, min(coalesce(k.count, 0)) AS min_coverage, arg_min(coalesce(k.count, 0), tk.pos) AS start_kmer_count, 'reference_only' AS outcome
    FROM tk CROSS JOIN s LEFT JOIN kmers k ON k.sample = s.sample AND k.kmer = tk.kmer WHERE NOT EXISTS (SELECT 1 FROM branched b WHERE b.sample = s.sample AND b.target = tk.target) GROUP BY 1, 2"""
)
def detect_unbranched(spark, sf_dir):
    """Detection's calls of all targets whose walk meets no k-mer but the reference's own."""
    own = kmer_tables.target_kmers(bridge.targets(spark, sf_dir), WALK_K).groupBy("target").agg(F.countDistinct("kmer").alias("own"))
    found = detect.attempts(bridge.targets(spark, sf_dir), read_kmers(spark, sf_dir), WALK_K).join(own, "target").filter("nodes = own")
    return found.withColumn("expression", F.round("expression", 6)).select("sample", "target", "type", "expression", "min_coverage", "start_kmer_count", "outcome")


# Variants

_PRE = lambda a, b: f"coalesce(nullif(list_position(list_transform(range(1, least(length({a}), length({b})) + 1), lambda i: substr({a}, i, 1) <> substr({b}, i, 1)), true), 0) - 1, least(length({a}), length({b})))"


@query(
    f"""WITH {CALLS_SQL}, p AS (SELECT DISTINCT ref_sequence AS r, alt_sequence AS x FROM (SELECT ref_sequence, left(ref_sequence, (pos % 12)::INTEGER) || alt_allele || substr(ref_sequence, (pos % 12)::INTEGER + 1 + length(ref_allele)) AS alt_sequence FROM calls)),
    s AS (SELECT *, {_PRE('r', 'x')} AS st, {_PRE('reverse(r)', 'reverse(x)')} AS su FROM p),
    e AS (SELECT *, greatest(0, least(su, length(r) - 1 - st, length(x) - 1 - st)) AS same FROM s),
    a AS (SELECT *, substr(r, st + 1, greatest(length(r) - 1 - same - st + 1, 0)) AS old, substr(x, st + 1, greatest(length(x) - 1 - same - st + 1, 0)) AS new FROM e),
    i AS (SELECT *, length(new) - length(old) AS ex FROM a),
    t AS (SELECT *, ex >= 2 AND CASE WHEN old = '' THEN (st >= ex AND substr(r, st - ex + 1, ex) = new) OR (st + ex <= length(r) AND substr(r, st + 1, ex) = new)
        ELSE (starts_with(new, old) AND st + ex <= length(r) AND substr(r, st + 1, ex) = substr(new, length(old) + 1))
          OR (ends_with(new, old) AND ((st >= ex AND substr(r, st - ex + 1, ex) = left(new, ex)) OR (st + length(old) + ex <= length(r) AND substr(r, st + length(old) + 1, ex) = left(new, ex))))
          OR len(list_filter(range(0, greatest(ex, 0) + 1), lambda o: st >= o AND st - o + length(new) <= length(r) AND substr(r, st - o + 1, length(new)) = new)) > 0 END AS itd FROM i)
    SELECT r AS ref_sequence, x AS alt_sequence, CASE WHEN r = x THEN 'Reference' WHEN ex = 0 THEN 'Substitution' WHEN ex > 0 AND itd THEN 'ITD'
        WHEN ex > 0 THEN CASE WHEN starts_with(new, old) OR ends_with(new, old) THEN 'Insertion' ELSE 'Indel' END
        WHEN starts_with(old, new) OR ends_with(old, new) THEN 'Deletion' ELSE 'Indel' END AS type,
        CASE WHEN r = x THEN '' ELSE st::VARCHAR || ':' || old || '/' || new || ':' || greatest(length(r) - 1 - same, length(x) - 1 - same)::VARCHAR END AS variant_name FROM t"""
)
def classify_variants(spark, sf_dir):
    at = (F.col("pos") % 12).cast("int")
    alt = F.concat(F.left("ref_sequence", at), "alt_allele", F.substring(F.col("ref_sequence"), at + 1 + F.length("ref_allele"), F.lit(100)))
    pairs = bridge.calls(spark, sf_dir).select("ref_sequence", alt.alias("alt_sequence")).distinct()
    return pairs.withColumn("c", variants.classified("ref_sequence", "alt_sequence")).select("ref_sequence", "alt_sequence", "c.type", "c.variant_name")


_TRIM = f"""tr AS (SELECT *, CASE WHEN ref_allele = alt_allele OR (length(ref_allele) = 1 AND length(alt_allele) = 1) THEN 0 ELSE greatest(0, least({_PRE('reverse(ref_allele)', 'reverse(alt_allele)')}, least(length(ref_allele), length(alt_allele)) - 1)) END AS cut FROM calls),
    t1 AS (SELECT *, left(ref_allele, length(ref_allele) - cut) AS r1, left(alt_allele, length(alt_allele) - cut) AS a1 FROM tr),
    t2 AS (SELECT *, CASE WHEN ref_allele = alt_allele THEN 0 ELSE greatest(0, least({_PRE('r1', 'a1')}, least(length(r1), length(a1)) - 1)) END AS h FROM t1),
    norm AS (SELECT *, pos + h AS norm_pos, substr(r1, h + 1) AS norm_ref, substr(a1, h + 1) AS norm_alt FROM t2)"""


@query(f"WITH {CALLS_SQL}, {_TRIM} SELECT DISTINCT pos, ref_allele, alt_allele, norm_pos, norm_ref, norm_alt FROM norm WHERE type <> 'Reference'")
def normalize_trimmed(spark, sf_dir):
    rows = variants.normalized(bridge.calls(spark, sf_dir).filter("type <> 'Reference'"), align=False)
    return rows.select("pos", "ref_allele", "alt_allele", "norm_pos", "norm_ref", "norm_alt").distinct()


def _aligned_sql(name: str, context: str) -> str:
    """calls as `name` with norm_pos, norm_ref, norm_alt after shifting left through a context, a base a step."""
    l, o = f"substr({name}_c, p, 1) || r", f"substr({name}_c, p, 1) || a"
    return f"""{name}v AS (SELECT DISTINCT {context} AS {name}_c, pos AS p0, ref_allele AS r0, alt_allele AS a0 FROM calls),
    {name}s AS (SELECT {name}_c, p0, r0, a0, p0 AS p, r0 AS r, a0 AS a, 0 AS step FROM {name}v
        UNION ALL SELECT {name}_c, p0, r0, a0, p - 1, left(l, length(l) - cut), left(o, length(o) - cut), step + 1
        FROM (SELECT *, greatest(0, least({_PRE('reverse(l)', 'reverse(o)')}, least(length(l), length(o)) - 1)) AS cut FROM (SELECT *, {l} AS l, {o} AS o FROM {name}s WHERE p > 0 AND p <= length({name}_c) AND r0 <> a0 AND NOT (length(r0) = 1 AND length(a0) = 1)) WHERE right(l, 1) = right(o, 1))),
    {name}e AS (SELECT {name}_c, p0, r0, a0, arg_max(p, step) AS p, arg_max(r, step) AS r, arg_max(a, step) AS a FROM {name}s GROUP BY 1, 2, 3, 4),
    {name}t AS (SELECT *, CASE WHEN r0 = a0 OR (length(r0) = 1 AND length(a0) = 1) THEN 0 ELSE greatest(0, least({_PRE('reverse(r)', 'reverse(a)')}, least(length(r), length(a)) - 1)) END AS cut FROM {name}e),
    {name}u AS (SELECT *, left(r, length(r) - cut) AS r1, left(a, length(a) - cut) AS a1 FROM {name}t),
    {name}w AS (SELECT *, CASE WHEN r0 = a0 THEN 0 ELSE greatest(0, least({_PRE('r1', 'a1')}, least(length(r1), length(a1)) - 1)) END AS h FROM {name}u),
    {name} AS (SELECT c.*, w.p + w.h AS norm_pos, substr(w.r1, w.h + 1) AS norm_ref, substr(w.a1, w.h + 1) AS norm_alt FROM calls c JOIN {name}w w ON w.{name}_c = {context} AND w.p0 = c.pos AND w.r0 = c.ref_allele AND w.a0 = c.alt_allele)"""


@query(f"WITH RECURSIVE {CALLS_SQL}, {_aligned_sql('al', 'ref_sequence')} SELECT DISTINCT ref_sequence, pos, ref_allele, alt_allele, norm_pos, norm_ref, norm_alt FROM al WHERE type <> 'Reference'")
def normalize_left_aligned(spark, sf_dir):
    rows = bridge.calls(spark, sf_dir).filter("type <> 'Reference'")
    return variants.normalized(rows).select("ref_sequence", "pos", "ref_allele", "alt_allele", "norm_pos", "norm_ref", "norm_alt").distinct()


@query(
    f"""WITH {CALLS_SQL}, {_TRIM}, best AS (SELECT *, row_number() OVER (PARTITION BY sample, target, chrom, norm_pos, norm_ref, norm_alt ORDER BY expression DESC, type, variant_name, "rVAF", pvalue NULLS FIRST, qual NULLS FIRST) AS n FROM norm WHERE type IN ('Insertion', 'Deletion', 'Indel'))
    SELECT sample, target, type, variant_name, expression, "rVAF" FROM calls WHERE type NOT IN ('Insertion', 'Deletion', 'Indel') UNION ALL SELECT sample, target, type, variant_name, expression, "rVAF" FROM best WHERE n = 1"""
)
def dedup_best_expression(spark, sf_dir):
    out = variants.deduplicated(bridge.calls(spark, sf_dir), ["type", "variant_name", "rVAF", "pvalue", "qual"], align=False)
    return out.select("sample", "target", "type", "variant_name", "expression", "rVAF")


_CLUSTERS = f"""{CALLS_SQL}, sp AS (SELECT DISTINCT sample, target, split_part(variant_name, ':', 1)::BIGINT AS s, split_part(variant_name, ':', 3)::BIGINT AS e, variant_name FROM calls WHERE type <> 'Reference'),
    o AS (SELECT *, max(e) OVER (PARTITION BY sample, target ORDER BY s, e, variant_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM sp),
    g AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (PARTITION BY sample, target ORDER BY s, e, variant_name ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster_id FROM o)"""


@query(f'WITH {_CLUSTERS} SELECT sample, target, cluster_id, min(s) AS start, max(e) AS "end", count(*) AS n FROM g GROUP BY 1, 2, 3')
def cluster_overlaps(spark, sf_dir):
    named = bridge.calls(spark, sf_dir).filter("type <> 'Reference'").select("sample", "target", "variant_name").distinct()
    return variants.clusters(named)


@query(
    f"""WITH {_CLUSTERS}, c AS (SELECT sample, target, cluster_id FROM g GROUP BY 1, 2, 3 HAVING count(*) > 1), m AS (SELECT *, row_number() OVER (PARTITION BY sample, target ORDER BY cluster_id) AS k FROM c)
    SELECT d.sample, d.target, d.variant_name, 'vs_ref' || coalesce(';cluster=' || m.k::VARCHAR, '') AS info FROM (SELECT DISTINCT sample, target, variant_name FROM calls WHERE type <> 'Reference') d
    LEFT JOIN g ON g.sample = d.sample AND g.target = d.target AND g.variant_name = d.variant_name LEFT JOIN m ON m.sample = g.sample AND m.target = g.target AND m.cluster_id = g.cluster_id"""
)
def cluster_annotation(spark, sf_dir):
    named = bridge.calls(spark, sf_dir).filter("type <> 'Reference'").select("sample", "target", "variant_name", F.lit("vs_ref").alias("info")).distinct()
    return variants.with_clusters(named)


# Merging, consensus


@query(
    f"""WITH {CALLS_SQL}, u AS (SELECT 0 AS f, * FROM calls UNION ALL SELECT 1 AS f, * FROM calls),
    r AS (SELECT *, row_number() OVER (PARTITION BY sample, target, variant_name ORDER BY f, type, "rVAF", expression, chrom, ref_sequence, pvalue NULLS FIRST, qual NULLS FIRST) AS n FROM u) SELECT sample, target, variant_name, type, "rVAF", expression FROM r WHERE n = 1"""
)
def merge_dedup(spark, sf_dir):
    calls = bridge.calls(spark, sf_dir)
    out = merge.merged([calls, calls], deduplicate=True, order=["type", "rVAF", "expression", "chrom", "ref_sequence", "pvalue", "qual"])
    return out.select("sample", "target", "variant_name", "type", "rVAF", "expression")


@query(
    f"""WITH {CALLS_SQL}, n AS (SELECT *, row_number() OVER (ORDER BY md5(sample || '|' || target || '|' || variant_name || '|' || type || '|' || chrom || '|' || ref_sequence || '|' || (floor("rVAF" * 1000))::BIGINT::VARCHAR || '|' || min_coverage::VARCHAR || '|' || (floor(coalesce(pvalue, 0) * 1000))::BIGINT::VARCHAR || '|' || (floor(coalesce(qual, 0)))::BIGINT::VARCHAR)) AS line FROM calls),
    r AS (SELECT *, row_number() OVER (PARTITION BY sample, target, variant_name ORDER BY CASE WHEN line % 2 = 0 THEN 0 ELSE 1 END, line) AS k FROM n) SELECT sample, target, variant_name, type, "rVAF", expression FROM r WHERE k = 1"""
)
def merge_first_line(spark, sf_dir):
    """Two tables, of even and odd lines in an order that no column gives away; the first line of a name wins."""
    whole = F.concat_ws("|", "sample", "target", "variant_name", "type", "chrom", "ref_sequence", F.floor(F.col("rVAF") * 1000).cast("string"), F.col("min_coverage").cast("string"), F.floor(F.coalesce("pvalue", F.lit(0.0)) * 1000).cast("string"), F.floor(F.coalesce("qual", F.lit(0.0))).cast("string"))
    lines = bridge.calls(spark, sf_dir).withColumn("_line", F.row_number().over(Window.orderBy(F.md5(whole.cast("binary")))))
    out = merge.merged([lines.filter("_line % 2 = 0"), lines.filter("_line % 2 = 1")], deduplicate=True)
    return out.select("sample", "target", "variant_name", "type", "rVAF", "expression")


def _multi_k(spark, sf_dir) -> DataFrame:
    ks = F.element_at(F.array(F.lit(21), F.lit(31), F.lit(41)), (F.col("min_coverage") % 3 + 1).cast("int"))
    return bridge.calls(spark, sf_dir).withColumn("k", ks)


def _weight_sql(kind: str, k: str) -> str:
    parts = []
    for name, steps in consensus.WEIGHTS.items():
        own = " ".join(f"WHEN {k} <= {most} THEN CAST({w} AS DOUBLE)" for most, w in steps if most is not None)
        last = f"CAST({steps[-1][1]} AS DOUBLE)"
        parts.append(f"WHEN '{name}' THEN " + (f"CASE {own} ELSE {last} END" if own else last))
    return f"CASE {kind} {' '.join(parts)} ELSE CAST(1 AS DOUBLE) END"


@query(
    f"""WITH {CALLS_SQL}, {_TRIM}, k0 AS (SELECT *, ([21, 31, 41])[min_coverage % 3 + 1] AS k, CASE WHEN type IN ('Insertion', 'Deletion', 'Indel') THEN 'indel' ELSE type END AS fam,
        CASE WHEN type = 'Reference' THEN 'R' ELSE 'N|' || chrom || '|' || norm_pos::VARCHAR || '|' || norm_ref || '|' || norm_alt END AS id0 FROM norm),
    k1 AS (SELECT *, CASE WHEN fam = first_value(fam) OVER (PARTITION BY sample, target, id0 ORDER BY k, type, variant_name) THEN id0 ELSE 'V|k' || k::VARCHAR || ':' || variant_name END AS identity FROM k0),
    g AS (SELECT sample, target, identity, list_sort(list(DISTINCT k)) AS ks, arg_max(type, (expression, k, type, variant_name, "rVAF")) AS type, arg_max("rVAF", (expression, k, type, variant_name, "rVAF")) AS brvaf FROM k1 GROUP BY 1, 2, 3),
    w AS (SELECT g.sample, g.target, g.identity, sum({_weight_sql('g.type', 'k1.k')} * k1.min_coverage) AS ws, sum({_weight_sql('g.type', 'k1.k')} * k1.min_coverage * k1."rVAF") AS wv FROM g JOIN k1 USING (sample, target, identity) GROUP BY 1, 2, 3)
    SELECT sample, target, identity, array_to_string(ks, ',') AS k_values, type, round(CASE WHEN ws > 0 THEN wv / ws ELSE brvaf END, 12) AS consensus_rvaf,
        round(list_sum(list_transform(ks, lambda k: {_weight_sql('type', 'k')})) / ({' + '.join(_weight_sql('type', str(k)) for k in (21, 31, 41))}), 6) AS consensus_score,
        CASE WHEN len(ks) >= 3 THEN 1 WHEN len(ks) >= 2 THEN 2 WHEN ks[1] = 31 THEN 3 ELSE 4 END AS tier FROM g JOIN w USING (sample, target, identity)"""
)
def consensus_multi_k(spark, sf_dir):
    out = consensus.merged(_multi_k(spark, sf_dir), [21, 31, 41], align=False)
    ks = F.concat_ws(",", F.transform("k_values", lambda k: k.cast("string")))
    out = out.withColumns({"consensus_rvaf": F.round("consensus_rvaf", 12), "consensus_score": F.round("consensus_score", 6)})
    return out.select("sample", "target", "identity", ks.alias("k_values"), "type", "consensus_rvaf", "consensus_score", "tier")


_INDEL_CONTEXT = "CASE WHEN type IN ('Insertion', 'Deletion', 'Indel') THEN ref_sequence ELSE '' END"


@query(
    f"""WITH RECURSIVE {CALLS_SQL}, {_aligned_sql('al', _INDEL_CONTEXT)}, k0 AS (SELECT *, ([21, 31, 41])[min_coverage % 3 + 1] AS k, CASE WHEN type IN ('Insertion', 'Deletion', 'Indel') THEN 'indel' ELSE type END AS fam,
        CASE WHEN type = 'Reference' THEN 'R' ELSE 'N|' || chrom || '|' || norm_pos::VARCHAR || '|' || norm_ref || '|' || norm_alt END AS id0 FROM al),
    k1 AS (SELECT *, CASE WHEN fam = first_value(fam) OVER (PARTITION BY sample, target, id0 ORDER BY k, type, variant_name) THEN id0 ELSE 'V|k' || k::VARCHAR || ':' || variant_name END AS identity FROM k0),
    pk AS (SELECT sample, target, identity, string_agg('k' || k::VARCHAR || '=' || printf('%.4f', v), ',' ORDER BY k) AS per_k FROM (SELECT sample, target, identity, k, max("rVAF") AS v FROM k1 GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
    g AS (SELECT sample, target, identity, list_sort(list(DISTINCT k)) AS ks, arg_max(type, (expression, k, type, variant_name, "rVAF")) AS type, arg_max(variant_name, (expression, k, type, variant_name, "rVAF")) AS variant_name, arg_max("rVAF", (expression, k, type, variant_name, "rVAF")) AS brvaf FROM k1 GROUP BY 1, 2, 3),
    w AS (SELECT g.sample, g.target, g.identity, sum({_weight_sql('g.type', 'k1.k')} * k1.min_coverage) AS ws, sum({_weight_sql('g.type', 'k1.k')} * k1.min_coverage * k1."rVAF") AS wv FROM g JOIN k1 USING (sample, target, identity) GROUP BY 1, 2, 3)
    SELECT sample, target, type, variant_name, round(CASE WHEN ws > 0 THEN wv / ws ELSE brvaf END, 12) AS "rVAF",
        'multi_k=' || array_to_string(ks, ',') || ';tier=' || CASE WHEN len(ks) >= 3 THEN '1' WHEN len(ks) >= 2 THEN '2' WHEN ks[1] = 31 THEN '3' ELSE '4' END
        || ';score=' || printf('%.3f', list_sum(list_transform(ks, lambda k: {_weight_sql('type', 'k')})) / ({' + '.join(_weight_sql('type', str(k)) for k in (21, 31, 41))})) || ';per_k=[' || per_k || ']' AS info
    FROM g JOIN w USING (sample, target, identity) JOIN pk USING (sample, target, identity)"""
)
def consensus_calls(spark, sf_dir):
    out = consensus.as_calls(consensus.merged(_multi_k(spark, sf_dir), [21, 31, 41])).withColumn("rVAF", F.round("rVAF", 12))
    return out.select("sample", "target", "type", "variant_name", "rVAF", "info")


# Filters

_EXP = f"{CALLS_SQL}, {TRUTH_SQL}, expected AS (SELECT row_number() OVER () AS e, chrom, pos, ref_allele, alt_allele, variant_type FROM truth)"
_ORD = 'c.sample, c.target, c.variant_name, c.min_coverage, c."rVAF", c.expression'
_TRIM_ANY = _TRIM.replace("FROM calls)", "FROM {t})").replace("tr AS", "{p}tr AS").replace("t1 AS", "{p}t1 AS").replace("t2 AS", "{p}t2 AS").replace("norm AS", "{p}norm AS").replace("FROM tr)", "FROM {p}tr)").replace("FROM t1)", "FROM {p}t1)").replace("FROM t2)", "FROM {p}t2)")
_NOTES = f"""CASE WHEN c_sample IS NULL THEN '{filters.NO_MATCH}' ELSE coalesce(nullif(concat_ws('; ',
        CASE WHEN min_coverage < 10 THEN 'coverage ' || min_coverage::VARCHAR || ' < 10' END, CASE WHEN "rVAF" < CAST(0.03 AS DOUBLE) THEN 'VAF ' || printf('%.6f', "rVAF") || ' < 0.03' END,
        CASE WHEN expression < 12 THEN 'expression ' || printf('%.2f', expression) || ' < 12' END, CASE WHEN lower(type) NOT IN ('substitution', 'insertion', 'deletion') THEN 'type ' || type || ' not in allowed types' END), ''), 'PASS') END"""
_REF_MATCH = f"""{_EXP}, {_TRIM_ANY.format(p='c', t='calls')}, {_TRIM_ANY.format(p='x', t='expected')},
    ex AS (SELECT x.e, c.*, row_number() OVER (PARTITION BY x.e ORDER BY {_ORD}) AS n FROM expected x JOIN calls c ON replace(c.chrom, 'chr', '') = x.chrom AND c.pos = x.pos AND c.ref_allele = x.ref_allele AND c.alt_allele = x.alt_allele AND lower(c.type) = lower(x.variant_type)),
    nr AS (SELECT x.e, c.*, row_number() OVER (PARTITION BY x.e ORDER BY {_ORD}) AS n FROM xnorm x JOIN cnorm c ON replace(c.chrom, 'chr', '') = x.chrom AND c.norm_pos = x.norm_pos AND c.norm_ref = x.norm_ref AND c.norm_alt = x.norm_alt AND lower(c.type) = lower(x.variant_type)
        WHERE x.variant_type IN ('Insertion', 'Deletion', 'Indel') AND x.e NOT IN (SELECT e FROM ex)),
    mt AS (SELECT e, sample AS c_sample, min_coverage, "rVAF", expression, type FROM ex WHERE n = 1 UNION ALL SELECT e, sample, min_coverage, "rVAF", expression, type FROM nr WHERE n = 1),
    filtered AS (SELECT coalesce(c_sample, '') AS sample, chrom, pos, ref_allele, alt_allele, variant_type, CASE WHEN notes = 'PASS' THEN 'Found' ELSE 'Not Found' END AS found, notes AS filter_notes,
        "rVAF" AS kmer_vaf, min_coverage AS kmer_min_coverage, expression AS kmer_expression FROM (SELECT *, {_NOTES} AS notes FROM expected LEFT JOIN mt USING (e)))"""
_SHOWN = ["sample", "chrom", "pos", "ref_allele", "alt_allele", "variant_type", "found", "filter_notes", "kmer_vaf", "kmer_min_coverage", "kmer_expression"]


def _filtered(spark, sf_dir, options=OPTIONS) -> DataFrame:
    return filters.filtered(bridge.truth(spark, sf_dir).drop("true_vaf"), bridge.calls(spark, sf_dir, distinct=False), options).select(*_SHOWN)


@query(f"WITH {_REF_MATCH} SELECT * FROM filtered")
def filter_reference_mode(spark, sf_dir):
    return _filtered(spark, sf_dir)


@query(
    f"""WITH {_EXP}, al AS (SELECT DISTINCT alt_allele FROM expected), sq AS (SELECT DISTINCT alt_sequence FROM calls), hit AS (SELECT a.alt_allele, s.alt_sequence FROM al a JOIN sq s ON contains(s.alt_sequence, a.alt_allele)),
    ex AS (SELECT h.alt_allele AS aa, c.*, row_number() OVER (PARTITION BY h.alt_allele ORDER BY {_ORD}) AS n FROM hit h JOIN calls c USING (alt_sequence)), mt AS (SELECT aa, sample AS c_sample, min_coverage, "rVAF", expression, type FROM ex WHERE n = 1)
    SELECT coalesce(c_sample, '') AS sample, chrom, pos, ref_allele, alt_allele, variant_type, CASE WHEN notes = 'PASS' THEN 'Found' ELSE 'Not Found' END AS found, notes AS filter_notes, "rVAF" AS kmer_vaf, min_coverage AS kmer_min_coverage, expression AS kmer_expression
    FROM (SELECT *, {_NOTES} AS notes FROM expected x LEFT JOIN mt ON mt.aa = x.alt_allele)"""
)
def filter_alt_mode(spark, sf_dir):
    from dataclasses import replace

    return _filtered(spark, sf_dir, replace(OPTIONS, use_alt=True))


@query(f"""WITH {CALLS_SQL} SELECT sample, target, type, variant_name, "rVAF", min_coverage, qual FROM calls WHERE type = 'Reference' OR ("rVAF" >= CAST(0.05 AS DOUBLE) AND min_coverage >= 20 AND coalesce(qual >= 30, false))""")
def filter_reporting(spark, sf_dir):
    return filters.reporting(bridge.calls(spark, sf_dir), 30, 0.05, 20).select("sample", "target", "type", "variant_name", "rVAF", "min_coverage", "qual")


@query(
    f"""WITH {CALLS_SQL}, r AS (SELECT *, CASE WHEN min_coverage < 10 THEN 'min_coverage ' || min_coverage::VARCHAR || ' < 10' WHEN "rVAF" < CAST(0.03 AS DOUBLE) THEN 'vaf ' || printf('%.4f', "rVAF") || ' < 0.0300' WHEN expression < 12 THEN 'expression ' || printf('%.2f', expression) || ' < 12.00' END AS a,
        CASE WHEN lower(type) NOT IN ('substitution', 'insertion', 'deletion') THEN 'type ' || type || ' not in allowed list' END AS b, CASE WHEN qual < 40 THEN 'QUAL ' || printf('%.1f', qual) || ' < 40.0' END AS c FROM calls)
    SELECT sample, target, type, variant_name, expression, coalesce(a, b, c) IS NULL AS passed, concat_ws('; ', a, b, c) AS reasons FROM r"""
)
def filter_stages(spark, sf_dir):
    from dataclasses import replace

    out = filters.staged(bridge.calls(spark, sf_dir), replace(OPTIONS, min_qual=40.0))
    return out.select("sample", "target", "type", "variant_name", "expression", "passed", F.concat_ws("; ", "stage_reasons").alias("reasons"))


@query(
    f"""WITH {DNA_SQL}, s AS (SELECT target, sequence, length(sequence) AS n, CASE WHEN length(sequence) = 0 THEN 0 ELSE length(regexp_replace(sequence, '[^GC]', '', 'g')) / length(sequence)::DOUBLE END AS gc,
        list_max(list_transform(regexp_extract_all(sequence, 'A+|C+|G+|T+'), lambda x: length(x))) AS run, len(list_distinct(list_transform(range(1, greatest(length(sequence) - 2, 1) + 1), lambda i: substr(sequence, i, 3)))) AS kinds FROM dna)
    SELECT target, concat_ws(',', CASE WHEN run >= 6 THEN 'HOMOPOLYMER_' || run::VARCHAR END, CASE WHEN gc < CAST(0.2 AS DOUBLE) THEN 'LOW_GC' WHEN gc > CAST(0.8 AS DOUBLE) THEN 'HIGH_GC' END,
        CASE WHEN contains(sequence, 'GGC') THEN 'GGC_MOTIF' END, CASE WHEN n >= 10 AND kinds < CAST(0.5 AS DOUBLE) * (n - 2) THEN 'LOW_COMPLEXITY' END) AS flags, round(gc, 9) AS gc FROM s"""
)
def filter_context_flags(spark, sf_dir):
    flags = F.regexp_replace(F.concat_ws(",", filters.context_flags(F.col("sequence"))), "GC_[0-9.]+", "GC")
    return bridge.dna(spark, sf_dir).select("target", flags.alias("flags"), F.round(S.gc_content("sequence"), 9).alias("gc"))


_PON = f"""{CALLS_SQL}, {_TRIM}, use AS (SELECT * FROM norm WHERE type <> 'Reference' AND "rVAF" >= CAST(0.01 AS DOUBLE)), tot AS (SELECT count(DISTINCT sample) AS t FROM use),
    pon AS (SELECT chrom, norm_pos AS pos, norm_ref AS ref_allele, norm_alt AS alt_allele, target, count(DISTINCT sample) AS sample_count, count(DISTINCT sample) / max(t)::DOUBLE AS frequency, max("rVAF") AS max_vaf, round(avg("rVAF"), 9) AS mean_vaf, max(t) AS total_samples FROM use, tot GROUP BY 1, 2, 3, 4, 5)"""


def _pon(spark, sf_dir) -> DataFrame:
    return filters.pon_build(bridge.calls(spark, sf_dir), 0.01, align=False)


@query(f"WITH {_PON} SELECT * FROM pon")
def pon_build(spark, sf_dir):
    return _pon(spark, sf_dir).withColumn("mean_vaf", F.round("mean_vaf", 9))


@query(f"""WITH {_PON} SELECT n.sample, n.target, n.type, n.variant_name, n."rVAF" FROM norm n WHERE type = 'Reference' OR NOT EXISTS (SELECT 1 FROM pon p WHERE p.frequency >= CAST(0.3 AS DOUBLE) AND p.chrom = n.chrom AND p.pos = n.norm_pos AND p.ref_allele = n.norm_ref AND p.alt_allele = n.norm_alt AND p.target = n.target)""")
def pon_filter(spark, sf_dir):
    return filters.pon_split(bridge.calls(spark, sf_dir), _pon(spark, sf_dir), 0.3, align=False)[0].select("sample", "target", "type", "variant_name", "rVAF")


# Statistics

_STATS = ", ".join(f"round(coalesce({e}, 0), 6)::DOUBLE AS {n}" for n, e in [("vaf_mean", "avg(v::DECIMAL(18, 9))"), ("vaf_median", "quantile_cont(v, 0.5)"), ("vaf_min", "min(v)"), ("vaf_max", "max(v)"), *[(f"vaf_p{p}", f"quantile_cont(v, {p / 100})") for p in (5, 25, 75, 95)], ("expression_mean", "avg(x::DECIMAL(18, 9))"), ("expression_median", "quantile_cont(x, 0.5)"), ("expression_min", "min(x)"), ("expression_max", "max(x)")])
_ROWS = """r AS (SELECT *, CASE WHEN type <> 'Reference' THEN "rVAF" END AS v, CASE WHEN type <> 'Reference' THEN expression END AS x FROM calls)"""


@query(f"WITH {CALLS_SQL}, {_ROWS} SELECT count(*) AS total_targets, count(v) AS detected, round(count(v) / count(*)::DOUBLE, 6) AS detection_rate, {_STATS} FROM r")
def stats_summary(spark, sf_dir):
    out = metrics.summary(bridge.calls(spark, sf_dir))
    return rounded(out, *[c for c, t in out.dtypes if t == "double"])


@query(f"WITH {CALLS_SQL}, {_ROWS} SELECT target, count(*) AS total, count(v) AS detected, round(count(v) / count(*)::DOUBLE, 6) AS detection_rate, round(coalesce(avg(v::DECIMAL(18, 9)), 0), 6)::DOUBLE AS vaf_mean, round(coalesce(quantile_cont(v, 0.5), 0), 6) AS vaf_median FROM r GROUP BY 1")
def stats_grouped(spark, sf_dir):
    return rounded(metrics.grouped_summary(bridge.calls(spark, sf_dir), "target"), "detection_rate", "vaf_mean", "vaf_median")


@query(f"WITH {CALLS_SQL} SELECT type, count(*) AS n FROM calls WHERE type <> 'Reference' GROUP BY 1")
def type_histogram(spark, sf_dir):
    return metrics.type_histogram(bridge.calls(spark, sf_dir))


@query(f"""WITH {CALLS_SQL}, m AS (SELECT greatest(max("rVAF"), CAST(0.01 AS DOUBLE)) AS top FROM calls WHERE type <> 'Reference') SELECT least(floor("rVAF" / (top / 20)), 19)::INTEGER AS bin, count(*) AS n FROM calls, m WHERE type <> 'Reference' GROUP BY 1""")
def vaf_histogram(spark, sf_dir):
    return metrics.vaf_histogram(bridge.calls(spark, sf_dir)).select("bin", "n")


@query(f"WITH {CALLS_SQL} SELECT target, count(*) FILTER (WHERE type <> 'Reference') AS detected, count(*) FILTER (WHERE type = 'Reference') AS reference FROM calls GROUP BY 1 ORDER BY detected DESC, target LIMIT 30")
def detection_bar_top30(spark, sf_dir):
    return metrics.detection_bars(bridge.calls(spark, sf_dir))


@query(
    f"""WITH {CALLS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY variant_name, sample, expression, "rVAF", min_coverage, type) AS k FROM calls)
    SELECT target, coalesce(arg_min(type, k) FILTER (WHERE type <> 'Reference'), 'Reference') AS result_type, coalesce(max("rVAF") FILTER (WHERE type <> 'Reference'), 1) AS rvaf, arg_min(min_coverage, k) AS coverage, count(*) AS n_paths, count(*) FILTER (WHERE type <> 'Reference') AS n_variants FROM o GROUP BY 1"""
)
def detection_summary(spark, sf_dir):
    return metrics.detection_summary(bridge.calls(spark, sf_dir), ["variant_name", "sample", "expression", "rVAF", "min_coverage", "type"])


# Ground truth

_MATCH = f"""{CALLS_SQL}, {TRUTH_SQL}, cc AS (SELECT *, replace(chrom, 'chr', '') AS ch, row_number() OVER (PARTITION BY replace(chrom, 'chr', ''), pos, ref_allele, alt_allele ORDER BY "rVAF" DESC) AS n FROM calls WHERE type <> 'Reference'),
    tt AS (SELECT t.*, c."rVAF" AS measured FROM truth t LEFT JOIN cc c ON c.n = 1 AND c.ch = t.chrom AND c.pos = t.pos AND c.ref_allele = t.ref_allele AND c.alt_allele = t.alt_allele),
    st AS (SELECT *, CASE WHEN true_vaf > 0 THEN CASE WHEN measured IS NOT NULL THEN 'TP' ELSE 'FN' END ELSE CASE WHEN measured IS NOT NULL THEN 'FP' ELSE 'TN' END END AS status FROM tt),
    un AS (SELECT * FROM cc c WHERE n > 1 OR NOT EXISTS (SELECT 1 FROM truth t WHERE c.ch = t.chrom AND c.pos = t.pos AND c.ref_allele = t.ref_allele AND c.alt_allele = t.alt_allele)),
    cm AS (SELECT count(*) FILTER (WHERE status = 'TP') AS tp, count(*) FILTER (WHERE status = 'FP') + (SELECT count(*) FROM un) AS fp, count(*) FILTER (WHERE status = 'FN') AS fn, count(*) FILTER (WHERE status = 'TN') AS tn FROM st)"""
_METRICS = "round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS sensitivity, round(tn / nullif(tn + fp, 0)::DOUBLE, 6) AS specificity, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision, round(tn / nullif(tn + fn, 0)::DOUBLE, 6) AS npv, round((tp + tn) / nullif(tp + fp + fn + tn, 0)::DOUBLE, 6) AS accuracy, round(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 6) AS f1"
_METRIC_NAMES = ["sensitivity", "specificity", "precision", "npv", "accuracy", "f1"]


@query(f"WITH {_MATCH} SELECT tp, fp, fn, tn, {_METRICS} FROM cm")
def benchmark_confusion(spark, sf_dir):
    return rounded(metrics.confusion(bridge.truth(spark, sf_dir), bridge.calls(spark, sf_dir)), *_METRIC_NAMES)


@query(f"WITH {_MATCH} SELECT variant_type, count(*) AS total, count(*) FILTER (WHERE status = 'TP') AS detected, round(count(*) FILTER (WHERE status = 'TP') / count(*)::DOUBLE, 6) AS sensitivity FROM st WHERE true_vaf > 0 GROUP BY 1")
def benchmark_per_type(spark, sf_dir):
    return rounded(metrics.by_type(bridge.truth(spark, sf_dir), bridge.calls(spark, sf_dir)), "sensitivity")


_BINS = (0.0, 0.03, 0.06, 0.1)


@query(
    f"""WITH {_MATCH}, b AS (SELECT * FROM (VALUES (CAST(0 AS DOUBLE), CAST(0.03 AS DOUBLE), false), (CAST(0.03 AS DOUBLE), CAST(0.06 AS DOUBLE), false), (CAST(0.06 AS DOUBLE), CAST(0.1 AS DOUBLE), true)) v(lo, hi, last))
    SELECT lo AS bin_low, hi AS bin_high, count(status) AS total, count(*) FILTER (WHERE status = 'TP') AS detected, round(count(*) FILTER (WHERE status = 'TP') / nullif(count(status), 0)::DOUBLE, 6) AS sensitivity
    FROM b LEFT JOIN st ON true_vaf > 0 AND true_vaf >= lo AND (true_vaf < hi OR (last AND true_vaf <= hi)) GROUP BY 1, 2"""
)
def benchmark_vaf_bins(spark, sf_dir):
    return rounded(metrics.by_vaf_bin(bridge.truth(spark, sf_dir), bridge.calls(spark, sf_dir), list(_BINS)), "sensitivity")


@query(
    f"""WITH {CALLS_SQL}, {TRUTH_SQL}, c AS (SELECT *, regexp_replace(lower(chrom), '^chr', '') AS ch, row_number() OVER (PARTITION BY regexp_replace(lower(chrom), '^chr', ''), pos, ref_allele, alt_allele ORDER BY "rVAF" DESC, sample DESC, target DESC, type DESC, expression DESC, min_coverage DESC) AS n FROM calls),
    t AS (SELECT *, row_number() OVER (PARTITION BY chrom, pos, ref_allele, alt_allele ORDER BY variant_type, true_vaf) AS n FROM truth),
    m AS (SELECT t.*, c."rVAF" AS v FROM t LEFT JOIN c ON c.ch = t.chrom AND c.pos = t.pos AND c.ref_allele = t.ref_allele AND c.alt_allele = t.alt_allele AND c.n = t.n),
    r AS (SELECT chrom, pos, ref_allele, alt_allele, CASE WHEN true_vaf > 0 THEN CASE WHEN v IS NOT NULL THEN 'TP' ELSE 'FN' END WHEN v IS NOT NULL THEN 'FP_truth' ELSE 'TN' END AS status, CASE WHEN true_vaf > 0 THEN round(v - true_vaf, 9) END AS vaf_error FROM m
        UNION ALL SELECT ch, pos, ref_allele, alt_allele, 'FP_call', NULL FROM c WHERE type <> 'Reference' AND NOT EXISTS (SELECT 1 FROM t WHERE c.ch = t.chrom AND c.pos = t.pos AND c.ref_allele = t.ref_allele AND c.alt_allele = t.alt_allele AND c.n = t.n))
    SELECT status, vaf_error, count(*) AS n FROM r GROUP BY 1, 2"""
)
def benchmark_one_to_one(spark, sf_dir):
    t, others = metrics.matched_once(bridge.truth(spark, sf_dir), bridge.calls(spark, sf_dir))
    rows = t.select("status", F.round("vaf_error", 9).alias("vaf_error")).unionByName(others.select("status", F.lit(None).cast("double").alias("vaf_error")))
    return rows.groupBy("status", "vaf_error").agg(F.count("*").alias("n"))


_SWEEP = (0.0, 0.02, 0.05)


@query(" UNION ALL ".join(f'SELECT * FROM (WITH {_MATCH.replace(chr(39) + "Reference" + chr(39) + "),", chr(39) + "Reference" + chr(39) + f" AND {chr(34)}rVAF{chr(34)} >= CAST({t} AS DOUBLE)),")} SELECT CAST({t} AS DOUBLE) AS threshold, tp, fp, fn, tn, {_METRICS} FROM cm)' for t in _SWEEP))
def benchmark_sweep(spark, sf_dir):
    return rounded(metrics.sweep(bridge.truth(spark, sf_dir), bridge.calls(spark, sf_dir), list(_SWEEP)), *_METRIC_NAMES)


@query(
    f"""WITH {_MATCH}, b AS (SELECT i / CAST(100 AS DOUBLE) AS lo, (i + 1) / CAST(100 AS DOUBLE) AS hi, i = 9 AS last FROM range(10) t(i)),
    s AS (SELECT (lo + hi) / 2 AS mid, count(*) FILTER (WHERE status = 'TP') / count(*)::DOUBLE AS s FROM b JOIN st ON true_vaf > 0 AND true_vaf >= lo AND (true_vaf < hi OR (last AND true_vaf <= hi)) GROUP BY 1),
    p AS (SELECT mid, s, lead(mid) OVER (ORDER BY mid) AS m2, lead(s) OVER (ORDER BY mid) AS s2 FROM s), l AS (SELECT unnest([CAST(0.5 AS DOUBLE), CAST(0.8 AS DOUBLE)]) AS level)
    SELECT level, round(arg_min(mid + (level - s) * (m2 - mid) / (s2 - s), mid) FILTER (WHERE s <= level AND s2 >= level AND s2 > s), 9) AS "limit" FROM l, p GROUP BY 1"""
)
def detection_limit(spark, sf_dir):
    bins = metrics.by_vaf_bin(bridge.truth(spark, sf_dir), bridge.calls(spark, sf_dir), [x / 100 for x in range(11)])
    out = metrics.detection_limit(bins, 0.5).unionByName(metrics.detection_limit(bins, 0.8))
    return out.withColumn("limit", F.round("limit", 9))


def _two_tools(spark, sf_dir) -> DataFrame:
    key = ["chrom", "pos", "ref_allele", "alt_allele"]
    t = bridge.truth(spark, sf_dir).filter("true_vaf > 0").select(*key).distinct()
    c = bridge.calls(spark, sf_dir).filter("type <> 'Reference'").withColumn("chrom", S.bare_chrom("chrom"))
    hits = c.groupBy(*key).agg(F.max(F.col("rVAF") >= 0.03).alias("a"), F.max(F.col("expression") >= 25).alias("b"))
    return t.join(hits, key, "left").select(*key, *[F.coalesce(x, F.lit(False)).alias(x) for x in ("a", "b")])


_TOOLS = f"""{CALLS_SQL}, {TRUTH_SQL}, h AS (SELECT replace(chrom, 'chr', '') AS chrom, pos, ref_allele, alt_allele, bool_or("rVAF" >= CAST(0.03 AS DOUBLE)) AS a, bool_or(expression >= 25) AS b FROM calls WHERE type <> 'Reference' GROUP BY 1, 2, 3, 4),
    two AS (SELECT chrom, pos, ref_allele, alt_allele, coalesce(a, false) AS a, coalesce(b, false) AS b FROM (SELECT DISTINCT chrom, pos, ref_allele, alt_allele FROM truth WHERE true_vaf > 0) LEFT JOIN h USING (chrom, pos, ref_allele, alt_allele))"""


@query(f"WITH {_TOOLS}, n AS (SELECT count(*) FILTER (WHERE a AND NOT b) AS b, count(*) FILTER (WHERE b AND NOT a) AS c FROM two) SELECT b, c, round(CASE WHEN b + c = 0 THEN 0 WHEN b + c >= 20 THEN greatest(abs(b - c) - 1, 0) ** 2 / (b + c) ELSE abs(b - c) ** 2 / (b + c)::DOUBLE END, 6)::DOUBLE AS statistic FROM n")
def mcnemar(spark, sf_dir):
    return rounded(metrics.mcnemar(_two_tools(spark, sf_dir), "a", "b"), "statistic")


@query(f"WITH {_TOOLS} SELECT *, CASE WHEN left_hit AND right_hit THEN 'both' WHEN left_hit THEN 'left_only' WHEN right_hit THEN 'right_only' ELSE 'neither' END AS outcome FROM (SELECT chrom, pos, ref_allele, alt_allele, a AS left_hit, b AS right_hit FROM two)")
def concordance(spark, sf_dir):
    two = _two_tools(spark, sf_dir)
    key = ["chrom", "pos", "ref_allele", "alt_allele"]
    return metrics.concordance(two.select(*key, F.col("a").alias("detected")), two.select(*key, F.col("b").alias("detected")), key)


@query(
    f"""WITH {CALLS_SQL}, {TRUTH_SQL}, l AS (SELECT chrom, pos, ref_allele, alt_allele, bool_or(true_vaf >= CAST(0.05 AS DOUBLE)) AS a FROM truth GROUP BY 1, 2, 3, 4),
    r AS (SELECT replace(chrom, 'chr', '') AS chrom, pos, ref_allele, alt_allele, bool_or(expression >= 25) AS b FROM calls WHERE type <> 'Reference' GROUP BY 1, 2, 3, 4),
    f AS (SELECT chrom, pos, ref_allele, alt_allele, a AS left_hit, b AS right_hit FROM l FULL JOIN r USING (chrom, pos, ref_allele, alt_allele))
    SELECT *, CASE WHEN coalesce(left_hit, false) AND coalesce(right_hit, false) THEN 'both' WHEN coalesce(left_hit, false) THEN 'left_only' WHEN coalesce(right_hit, false) THEN 'right_only' ELSE 'neither' END AS outcome FROM f"""
)
def concordance_of_different_keys(spark, sf_dir):
    """Two tools that do not report on the same variants."""
    key = ["chrom", "pos", "ref_allele", "alt_allele"]
    left = bridge.truth(spark, sf_dir).groupBy(*key).agg(F.max(F.col("true_vaf") >= 0.05).alias("detected"))
    calls = bridge.calls(spark, sf_dir).filter("type <> 'Reference'").withColumn("chrom", S.bare_chrom("chrom"))
    return metrics.concordance(left, calls.groupBy(*key).agg(F.max(F.col("expression") >= 25).alias("detected")), key)


# Filter reports

_OUT = f"CASE WHEN found = 'Found' THEN 'found' WHEN filter_notes = '{filters.NO_MATCH}' THEN 'not_detected' ELSE 'detected_but_filtered' END"


@query(f"WITH {_REF_MATCH}, o AS (SELECT {_OUT} AS o FROM filtered) SELECT count(*) AS total_expected, count(*) FILTER (WHERE o = 'found') AS found, count(*) FILTER (WHERE o <> 'found') AS not_found, count(*) FILTER (WHERE o = 'detected_but_filtered') AS detected_but_filtered, count(*) FILTER (WHERE o = 'not_detected') AS not_detected, round(count(*) FILTER (WHERE o = 'found') / count(*)::DOUBLE, 6) AS detection_rate FROM o")
def filter_report_summary(spark, sf_dir):
    return rounded(metrics.filter_summary(_filtered(spark, sf_dir)), "detection_rate")


@query(
    f"""WITH {_REF_MATCH}, d AS (SELECT row_number() OVER () AS r, filter_notes FROM filtered WHERE {_OUT} = 'detected_but_filtered'), p AS (SELECT DISTINCT r, split_part(unnest(string_split(filter_notes, '; ')), ' ', 1) AS criterion FROM d),
    k AS (SELECT *, count(*) OVER (PARTITION BY r) AS n FROM p) SELECT f.criterion, count(*) FILTER (WHERE n = 1) AS rejected_alone, count(n) AS rejected_any FROM (VALUES ('coverage'), ('VAF'), ('expression'), ('type')) f(criterion) LEFT JOIN k USING (criterion) GROUP BY 1"""
)
def filter_report_criteria(spark, sf_dir):
    return metrics.by_criterion(_filtered(spark, sf_dir))


@query(
    f"""WITH {_REF_MATCH}, m AS (SELECT chrom, pos, ref_allele, alt_allele, unnest(['coverage', 'VAF', 'expression']) AS criterion, unnest([kmer_min_coverage::DOUBLE, kmer_vaf, kmer_expression]) AS observed_value, unnest([CAST(10 AS DOUBLE), CAST(0.03 AS DOUBLE), CAST(12 AS DOUBLE)]) AS threshold FROM filtered WHERE found <> 'Found')
    SELECT *, round(observed_value / threshold, 6) AS ratio FROM m WHERE observed_value / threshold >= 0.5 AND observed_value / threshold < 1"""
)
def filter_report_near_misses(spark, sf_dir):
    return rounded(metrics.near_misses(_filtered(spark, sf_dir), OPTIONS), "ratio")


@query(
    f"""WITH {_REF_MATCH}, s AS (SELECT * FROM (VALUES (CAST(0.5 AS DOUBLE), '0.5x', 5), (1, '1x (current)', 10), (2, '2x', 20), (5, '5x', 50)) v(m, label, cov))
    SELECT m AS multiplier, label, count(*) FILTER (WHERE kmer_min_coverage >= cov AND kmer_vaf >= CAST(0.03 AS DOUBLE) * m AND kmer_expression >= 12 * m) AS found, round(count(*) FILTER (WHERE kmer_min_coverage >= cov AND kmer_vaf >= CAST(0.03 AS DOUBLE) * m AND kmer_expression >= 12 * m) / count(*)::DOUBLE, 6) AS detection_rate FROM filtered, s GROUP BY 1, 2"""
)
def filter_report_sensitivity(spark, sf_dir):
    return rounded(metrics.threshold_sensitivity(_filtered(spark, sf_dir), OPTIONS), "detection_rate")


@query(f"WITH {_REF_MATCH} SELECT chrom, pos, ref_allele, alt_allele, variant_type, {_OUT} AS outcome, filter_notes, kmer_vaf, kmer_min_coverage, kmer_expression FROM filtered")
def filter_report_details(spark, sf_dir):
    return metrics.variant_details(_filtered(spark, sf_dir))


# Confidence


@query(f"WITH {CALLS_SQL} SELECT DISTINCT pvalue, round(CASE WHEN pvalue <= 0 THEN 999 WHEN pvalue >= 1 THEN 0 ELSE least(999, -10 * log10(pvalue)) END, 6)::DOUBLE AS qual, round(pvalue, 6) AS back FROM calls WHERE pvalue IS NOT NULL")
def phred_qual(spark, sf_dir):
    rows = bridge.calls(spark, sf_dir).filter("pvalue is not null").select("pvalue").distinct()
    return rounded(rows.select("pvalue", S.phred("pvalue").alias("qual"), S.from_phred(S.phred("pvalue")).alias("back")), "qual", "back")


@query(f"WITH {CALLS_SQL} SELECT target, count(*) AS n, round(-2 * sum(ln(greatest(pvalue, CAST(1e-300 AS DOUBLE)))), 6) AS statistic FROM calls WHERE pvalue IS NOT NULL GROUP BY 1")
def fisher_statistic(spark, sf_dir):
    rows = bridge.calls(spark, sf_dir).filter("pvalue is not null")
    return rounded(rows.groupBy("target").agg(F.count("*").alias("n"), (F.lit(-2.0) * F.sum(F.ln(F.greatest("pvalue", F.lit(1e-300))))).alias("statistic")), "statistic")


@query(
    f"""WITH {CALLS_SQL}, g AS (SELECT sample, target, type, count(*) AS n, -sum(ln(pvalue)) AS x FROM calls WHERE pvalue IS NOT NULL GROUP BY 1, 2, 3)
    SELECT sample, target, type, round(-log10(list_sum(list_transform(range(0, n), lambda i: exp(i * ln(x) - x - lgamma(i + 1))))), 6) AS minus_log10 FROM g"""
)
def fisher_combined(spark, sf_dir):
    """Combined p-values of each sample, target and type, of k-mers as long as the reads, which do not overlap.

    A p-value too small for a double is 0, its minus_log10 infinite.
    """
    from ..functions import special

    @F.pandas_udf("double")
    def combined(values: pd.Series) -> pd.Series:
        return values.map(lambda x: special.fisher_combine(x, special.READ_LENGTH))

    rows = bridge.calls(spark, sf_dir).filter("pvalue is not null").groupBy("sample", "target", "type").agg(F.collect_list("pvalue").alias("p"))
    rows = rows.select("sample", "target", "type", combined("p").alias("p"))
    return rows.select("sample", "target", "type", F.when(F.col("p") == 0, F.lit(float("inf"))).otherwise(F.round(-F.log10("p"), 6)).alias("minus_log10"))


@query(
    f"""WITH {CALLS_SQL}, d AS (SELECT DISTINCT min_coverage AS n, "rVAF" FROM calls), x AS (SELECT *, ceil(n * "rVAF")::BIGINT AS k FROM d)
    SELECT n AS min_coverage, "rVAF", round(CASE WHEN k <= 0 THEN CAST(1 AS DOUBLE) WHEN k > n THEN CAST(0 AS DOUBLE) ELSE least(CAST(1 AS DOUBLE),
        list_sum(list_transform(range(k, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(CAST(0.01 AS DOUBLE)) + (n - i) * ln(CAST(0.99 AS DOUBLE)))))) END, 9) AS tail FROM x"""
)
def binomial_tails(spark, sf_dir):
    from ..functions.special import binomial_sf_col

    rows = bridge.calls(spark, sf_dir).select("min_coverage", "rVAF").distinct()
    return rows.select("min_coverage", "rVAF", binomial_sf_col(F.ceil(F.col("min_coverage") * F.col("rVAF")).cast("long"), F.col("min_coverage"), F.lit(0.01)).alias("tail")).withColumn("tail", F.round("tail", 9))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
